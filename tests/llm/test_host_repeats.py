"""The host's repeats against a finder that compares every run of every page, and what markup alone must not delete."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lucidframe.llm import html_extract as H


def units(found):
    """Lists of (block, word) places: a long block, or neighbouring short ones together."""
    out, short = [], False
    for b, words in enumerate(found):
        if len(words) >= H.RUN or not short:
            out.append([])
        short = len(words) < H.RUN
        out[-1] += [(b, k, w) for k, w in enumerate(words)] + [(b, None, None)]
    return [u[:-1] for u in out]


def brute(pages):
    """Main texts of (url, html) pages of one host by counting every run of RUN words in its place."""
    read = [H.candidates(H.blocks(h)) for h in pages]
    kinds = defaultdict(dict)  # pages with equal candidates count once
    for article, found in read:
        kinds[article].setdefault(tuple(map(tuple, found)), found)
    known = {}
    for article, distinct in kinds.items():
        held = defaultdict(set)
        for key, found in distinct.items():
            own = units(found)
            for i, u in enumerate(own):
                place = ("start", i) if i <= len(own) - 1 - i else ("end", len(own) - 1 - i)
                for at in range(len(u) - H.RUN + 1):
                    held[place, tuple(w for _, _, w in u[at : at + H.RUN])].add(key)
        enough = sum(1 for f in distinct.values() if sum(len(w) + 1 for w in f) > H.RUN)
        known[article] = {x for x, who in held.items() if len(who) >= (max(5, enough // 2 + 1) if article else min(5, max(2, enough)))}
    texts = []
    for article, found in read:
        gone, own = set(), units(found)
        for i, u in enumerate(own):
            place = ("start", i) if i <= len(own) - 1 - i else ("end", len(own) - 1 - i)
            for at in range(len(u) - H.RUN + 1):
                if (place, tuple(w for _, _, w in u[at : at + H.RUN])) in known[article]:
                    gone |= {(b, k) for b, k, _ in u[at : at + H.RUN]}
        kept = []
        for b, words in enumerate(found):
            flags = [(b, k) in gone for k in range(len(words))]
            if all(flags):
                continue
            k = 0
            while k < len(words):  # covered stretches shorter than a run stay
                end = k
                while end < len(words) and flags[end] == flags[k]:
                    end += 1
                kept += words[k:end] if not flags[k] or end - k < H.RUN else []
                k = end
        copied = article and 2 * len(gone) > sum(len(words) + 1 for words in found)
        texts.append(" ".join(w for words in found for w in words) if copied else " ".join(kept))
    return texts


def site(rng, n):
    """Pages with and without articles: menus, notices and footers without any telling markup, shared quotes, copies."""
    word = lambda: f"w{rng.randrange(400)}"
    menu = [" ".join(f"m{s}x{k}" for k in range(9)) for s in range(3)]
    legal = "All of this text belongs to the owner of the site and to nobody else"
    quote = " ".join(f"q{k}" for k in range(60))
    pages = []
    for i in range(n):
        story = [" ".join(word() for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 6))]
        if rng.random() < 0.2:
            story.insert(rng.randrange(len(story) + 1), quote)
        if rng.random() < 0.1 and pages:
            pages.append(rng.choice(pages).replace("<body", f"<body data-n={i}"))
            continue
        body = "".join(f"<p>{x}</p>" for x in story)
        top = f"<div>{menu[i % 3]}</div>" if rng.random() < 0.9 else f"<ul><li>{'</li><li>'.join(menu[i % 3].split())}</li></ul>"
        if rng.random() < 0.5:
            pages.append(f"<body>{top}<article><p>Read this on paper or on any screen you like</p>{body}<p>{legal}</p></article></body>")
        else:
            pages.append(f"<body>{top}{body}<div>{legal} {word() if rng.random() < 0.3 else ''}</div></body>")
    return pages


@pytest.mark.parametrize("chunk", [H.CHUNK, 6000, 300])
def test_decisions_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(H, "HOST", chunk)
    monkeypatch.setattr(H, "CHUNK", chunk)  # one suffix array for a host, one for a place, several for a place
    rng = random.Random(7)
    hosts = {f"h{n}.example": site(rng, n) for n in (1, 2, 3, 4, 9, 60)}
    rows = [(url, h) for host, pages in hosts.items() for url, h in ((f"http://{host}/{k}", h) for k, h in enumerate(pages))]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in H.main_text(df).collect()}
    want = [t for pages in hosts.values() for t in brute(pages)]
    assert [got[i] for i in range(len(rows))] == want
    plain = [" ".join(w for words in H.candidates(H.blocks(h))[1] for w in words) for _, h in rows]
    assert sum(a != b for a, b in zip(want, plain)) > 30
    assert sum(a != b and "<article" in h for a, b, (_, h) in zip(want, plain, rows)) > 10  # the suffix arrays decide in articles too


def test_suffix_order_equals_sorting():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 4, 300).astype(np.uint32)
    at = np.arange(0, 290)
    order, new = H.suffix_order(codes, at)
    ahead = [tuple(codes[i : i + H.RUN].tolist()) for i in at[order]]
    assert ahead == sorted(ahead) and new.tolist() == [True] + [a != b for a, b in zip(ahead, ahead[1:])]


def test_codes_survive_packing():
    codes = np.array([0, 1, 255, 256, 65_537, 0xFFFFFF], np.uint32)
    assert H._unpacked(H._packed(codes)).tolist() == codes.tolist()


def test_places_are_sorted_in_slices(monkeypatch):
    monkeypatch.setattr(H, "SORTED", 50)
    rng = random.Random(3)
    rows = []
    for k in range(20):
        codes, starts, places = H.stream([[f"w{rng.randrange(5)}" for _ in range(rng.randrange(1, 20))] for _ in range(6)])
        rows.append((k, starts.astype(np.int32).tobytes(), places.astype(np.int32).tobytes(), H._packed(codes)))
    table = pa.table(dict(zip(("same", "starts", "places", "codes"), map(list, zip(*rows)))))
    streams = H.Streams(table)
    cut = list(streams.slices())
    assert len(cut) > 3
    seen = np.concatenate([at for at, _ in cut])
    assert len(np.unique(seen)) == len(seen) == sum(max(0, e - a - H.RUN) for a, e in zip(streams.unit_at, streams.unit_end))
    place = [set(streams.unit_place[u].tolist()) for _, u in cut]
    assert all(not a & b for k, a in enumerate(place) for b in place[k + 1 :])


def test_a_passage_that_many_articles_share_stays(spark):
    shared = " ".join(f"passage{k}" for k in range(60))
    rows = [(i, f"http://h/{i}", f"<article><h1>Story {i}</h1><p>{shared if i % 3 == 0 else ''}</p><p>{' '.join(f'w{i}x{k}' for k in range(80))}</p></article>") for i in range(90)]
    got = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all((shared in got[i]) == (i % 3 == 0) for i in range(90))


def test_copies_of_an_article_stay_whole(spark):
    story = " ".join(f"word{k}" for k in range(200))
    rows = [(i, f"http://h/{i}", f"<article><h1>Title</h1><p>{story} edit{i}</p></article>") for i in range(40)]
    got = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {story} edit{i}" for i in range(40)}


@pytest.mark.parametrize("label", ['class="entry-header"', 'class="social-policy"', 'id="notice-period"', 'class="comments-on-art"'])
def test_names_that_only_hold_a_telling_word_delete_nothing(label):
    assert H.blocks(f"<article><p {label}>kept</p></article>") == [("article", "kept")]


@pytest.mark.parametrize("label", ['class="ad"', 'class="ad-slot-3"', 'id="comments"', 'class="x cookie-notice"', 'class="share-buttons"', 'class="related-articles"', 'role="navigation"'])
def test_names_that_tell(label):
    assert H.blocks(f"<article><div {label}>gone</div><p>kept</p></article>") == [("chrome", "gone"), ("article", "kept")]


def test_many_unclosed_tags_take_linear_time():
    n = 40_000
    page = "<div>" * n + "word" + "</section>" * n
    assert H.blocks(page) == [("plain", "word")]


def test_long_page_and_odd_columns(spark):
    rows = [(1, "http://h/1", "<p>" + "many words here </p><p>" * 60_000, 7, "x"), (2, None, None, 8, "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, spans int, host string")
    got = {r.page_id: r.n_chars for r in H.main_text(df).collect()}
    assert got == {1: 60_000 * 16 - 1, 2: 0}
