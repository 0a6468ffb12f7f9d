import base64
import gzip
import hashlib
import io
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucidframe.llm import html_extract, language_id, warc_zip


@pytest.mark.parametrize("big", [False, True])
def test_package_reader(monkeypatch, big):
    if big:  # force the ZIP64 records
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    sink = io.BytesIO()
    writer = warc_zip.PackageWriter(sink)
    raws = [warc_zip.record(i, f"http://h/{i} x", b"p" * i, warc_zip.payload_digest(b"p" * i), None, False) for i in range(200)]
    for i, r in enumerate(raws):
        writer.add(r, str(i), "d")
    writer.close()
    data = sink.getvalue()
    asked = []

    def fetch(at, n):
        asked.append((at, n))
        return data[at : at + n]

    reader = warc_zip.PackageReader(fetch, len(data))
    assert set(reader.members) == {warc_zip.DATA, warc_zip.INDEX} and list(reader.records()) == raws
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
        assert gzip.decompress(z.read(warc_zip.DATA)) == b"".join(raws)
    fields, http, payload = warc_zip.parse_record(raws[7])
    assert (fields["WARC-Type"], http["Content-Length"], payload) == ("response", "7", b"p" * 7)


def test_broken_packages():
    for raw in (b"", b"no zip at all" * 20):
        with pytest.raises(ValueError):
            warc_zip.PackageReader(lambda at, n: raw[at : at + n], len(raw))


def test_round_trip(spark):
    rows = [(1, "http://a/ b", "x"), (2, None, "x"), (3, "u\n", "y" * 300_000), (4, "u", None), (5, "u", ""), (None, "u", "x"), (7, "ü", "é\r\n\r\n"), (2, "again", "x")]
    rows += [(100 + i, "h", "hot") for i in range(50)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string")
    got = warc_zip.round_trip(df).collect()
    assert len(got) == len(rows)
    keep = {}
    for i, _, h in rows:
        if i is not None:
            keep[h or ""] = max(i, keep.get(h or "", i))
    want = Counter()
    for i, _, h in rows:
        p = (h or "").encode()
        revisit = i != keep[h or ""]
        want[i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", keep[h or ""] if revisit else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert warc_zip.round_trip(df.limit(0)).count() == 0
    small = warc_zip.round_trip(df, min_bytes=2)
    assert {r.record_type for r in small.collect() if r.payload_bytes < 2} == {"response"}


PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{{}}</style></head><body class="no-sidebar"><nav><ul><li><a href="/">Home</a></ul></nav><header>Site</header>
<div class="cookie-notice">We use cookies</div><article><h1>A &amp; B</h1><p><b>One <i>t</i>wo<br>three<p>a&nbsp;b &lt;x&gt;<!-- no --><div class="ad">buy</div><form><input>send</form>{body}<script>var a="</article>";</script>
<section id="comments"><article>comment</article></section></article><aside>related</aside><footer>&copy; x</footer></body></html>"""


def test_extraction_by_markup(spark):
    rows = [(1, "http://h/1", PAGE.format(body="<ul><li>l1<li>l2</ul>5 < 6")), (2, "http://h/2", PAGE.format(body="")), (3, None, None), (4, "x", ""), (5, "http://h/5", "<p>cut off <a hre"), (5, "http://h/5", "<p>cut off <a hre"), (6, "http://h/6", "just text &#x41;"), (7, "http://i/", "<article>" + "<p>word " * 20_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_extract.main_text(df).collect()), key=lambda r: r[0])
    texts = ["A & B One two three a b <x> l1 l2 5 < 6", "A & B One two three a b <x>", "", "", "cut off", "cut off", "just text A", " ".join(["word"] * 20_000)]
    assert [r[2] for r in got] == texts and [r[3] for r in got] == [len(t) for t in texts] and [r[1] for r in got] == [u for _, u, _ in rows]
    assert html_extract.main_text(df.limit(0)).count() == 0


def test_extraction_by_repeats(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "HOST", 400)
    monkeypatch.setattr(html_extract, "CHUNK", 400)  # several suffix arrays for a host
    menu = "<div><p>Home News Sport Weather Contact Login Help</p></div>"
    rows = [(i, "http://h/" + str(i), f"<body>{menu}<div><p>Story {i} tells of things that happened {i} days ago</p></div><div>All rights reserved by us, forever and ever</div></body>") for i in range(30)]
    story = "The very same story with many words was told on two of the pages here"
    rows += [(i, f"http://h/{i}", f"<body>{menu}<p>{story}</p><p>number {i}</p></body>") for i in (40, 41)]
    rows += [(50, "http://h/50", rows[0][2]), (60, "http://other/", f"<body>{menu}<p>own</p></body>")]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} tells of things that happened {i} days ago" for i in range(30))
    assert got[40] == f"{story} number 40" and got[41] == f"{story} number 41"
    assert got[50] == got[0] and got[60] == "Home News Sport Weather Contact Login Help own"


TEXT = {
    "en": "the house of the king and the people that were with him in the old town", "de": "das haus des königs und die leute die mit ihm in der alten stadt waren",
    "fr": "la maison du roi et les gens qui étaient avec lui dans la vieille ville", "es": "la casa del rey y la gente que estaba con él en la vieja ciudad",
}


def test_languages_held_out(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        lang = ("en", "de", "fr", "es")[i % 4]
        words = TEXT[lang].split()
        rows.append((i, " ".join(rng.choice(words, 12)), None, "hot" if i % 3 else f"site{i % 4}.example"))
    rows += [(900, None, "en", "hot"), (901, "", "en", "hot"), (902, "12 34 !!", "en", "hot"), (903, "the", None, None), (904, "zxqj vkwx qqzx wvkj xxqz kzvw qjxk zzkq " * 40, None, None), (905, "the house " * 100_000, "xx", "hot")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, host int")
    known = [(f"p{i}", " ".join(rng.choice(TEXT[x].split(), 12)), x) for i in range(100) for x in TEXT]
    options = dict(declared=F.col("lang"), host=F.col("source"), labelled=spark.createDataFrame(known, "id string, text string, label string"))
    got = {r.doc_id: r for r in language_id.identify(df, **options).collect()}
    assert len(got) == len(rows)
    assert np.mean([got[i].language == ("en", "de", "fr", "es")[i % 4] for i in range(400)]) > 0.95
    assert all(not got[i].kept and got[i].language is None for i in (900, 901, 902, 904))
    assert got[903].language == "en" and got[905].language == "en"
    kept = language_id.drop_unidentified(df, **options)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_languages_without_labels_or_rows(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXT.values())], "doc_id long, text string")
    got = {r.doc_id: r.language for r in language_id.identify(df).collect()}
    assert [got[i] for i in range(4)] == list(TEXT)
    assert language_id.identify(df.limit(0)).count() == 0


def test_declaration_and_host_decide_short_texts(spark):
    rows = [(i, "le chat et la maison", "fr", "site.fr") for i in range(50)] + [(100, "la", None, "site.fr"), (101, "la", "es", "x.es"), (102, "la", "es-MX", "x.es")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.language for r in language_id.identify(df, declared=F.col("lang"), host=F.col("source")).collect()}
    assert got[100] == "fr" and got[101] == "es" and got[102] == "es"


def page(i, lang, host, text):
    return (i, f"http://{host}/{i}", f"<html{f' lang={lang}' if lang else ''}><body><article><p>{text}</p></article></body></html>")


def test_each_evidence_changes_a_decision(spark):
    """Pages whose text says nothing by itself, with one kind of evidence each; without it the decision is another."""
    vague = "la"  # Spanish and French alike
    rows = [page(i, "fr", "site.fr", "le chat et la maison") for i in range(30)] + [page(100 + i, "es", "blog.org", "el gato y la casa") for i in range(30)]
    rows += [page(200 + i, "en", "big.com", "the house of the king") for i in range(200)]
    cases = {900: ("es", "other.net"), 901: ("fr", "other.net"), 902: (None, "new.fr"), 903: (None, "new.mx"), 904: (None, "blog.org"), 905: (None, "site.fr")}
    rows += [page(i, lang, host, vague) for i, (lang, host) in cases.items()]
    got = {r.page_id: r.language for r in language_id.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    assert (got[900], got[901]) == ("es", "fr")  # the markup's declaration alone
    assert (got[902], got[903]) == ("fr", "es")  # the address suffix alone
    assert (got[904], got[905]) == ("es", "fr")  # the host's prior; blog.org's suffix means no language
    words = language_id.identify(spark.createDataFrame([(1, "the house and the king"), (2, "el hombre que estaba con los gatos y las casas del pueblo en la ciudad")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.language for r in words} == {1: "en", 2: "es"}  # the text alone


def test_markup_declarations(spark):
    cases = {'<!DOCTYPE html><html lang="de-AT">': "de-AT", "<HTML class=x LANG=fr>": "fr", "<html\n xml:lang='en' lang='es'>": "en", "<html><p lang=en>": None, "": None, None: None}
    df = spark.createDataFrame([(h,) for h in cases], "html string")
    assert [r[0] for r in df.select(language_id.markup_language(F.col("html"))).collect()] == list(cases.values())


def test_repeated_rows_and_ties(spark):
    rows = [(1, "la", None), (1, "la", None), (2, "la", None), (None, "the house", "en")]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), declared=F.col("lang")).collect()
    assert len(got) == 4 and len({(r.language, r.confidence) for r in got if r.doc_id in (1, 2)}) == 1
