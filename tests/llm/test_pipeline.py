import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
from lucidframe.llm import pieces
from lucidframe.llm.queries import tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text.lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def stay(rows, percent):
    """Ids that are the smallest of their component, by comparing all pairs; and the similarities of the links."""
    sets = {r[0]: shingles(r[1]) for r in rows}
    ids, low, links = sorted(sets), {i: i for i in sets}, []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            union = len(sets[a] | sets[b])
            if 100 * common >= percent * union:
                links.append(common / union)
                x, y = sorted((low[a], low[b]))
                low = {i: x if c == y else c for i, c in low.items()}
    return {i for i, c in low.items() if i == c}, links


def documents():
    """English texts and copies of each that end in other words: similarities of 0.72 to 0.95."""
    rng = random.Random(8)
    vocabulary = "the of and house king old town people were with him that they said when morning river long way home winter after long road to his her mother father".split()
    rows = []
    for b in range(24):
        base = [rng.choice(vocabulary) + rng.choice(["", "s", "ing", "ed"]) for _ in range(104)]
        rows.append((10 * b, " ".join(base)))
        for k, other in enumerate((3, 8, 10, 11, 16)[: 1 + b % 5]):
            rows.append((10 * b + 1 + k, " ".join(base[: 104 - other] + [rng.choice(vocabulary) + "ly" for _ in range(other)])))
    return [(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows]


def pages(spark, path):
    rows = [(i, f"http://h/{i}", f"<html lang=en><body><article><p>{t}</p></article></body></html>") for i, t, *_ in documents()[::9]]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")


def targets(words):
    names = sorted(words)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, held = 1.5 * sum(words.values()), {}
    while True:
        free = [s for s in names if s not in held]
        level = (goal - sum(held.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * words[s]]
        if not over:
            return goal, held | {s: level * weight[s] for s in free}
        held |= {s: 2.0 * words[s] for s in over}


def mixed(rows):
    """Ids in the order of service: copies by virtual finish time, cut at the budget."""
    size = {i: len(WORD.findall(t)) for i, t, *_ in rows}
    words = Counter()
    for i, _, _, source, _ in rows:
        words[source] += size[i]
    goal, target = targets(words)
    queue = []
    for rank, source in enumerate(sorted(words)):
        own = sorted((r[0] for r in rows if r[3] == source), key=lambda i: hashlib.md5(f"mix|{i}".encode()).hexdigest())
        for copy in (0, 1):
            end = copy * words[source]
            for i in own:
                end += size[i]
                queue.append((end / target[source], rank, end, i))
    served, total = [], 0
    for *_, i in sorted(queue):
        total += size[i]
        if total > goal:
            break
        served.append(i)
    return served


def test_run_equals_a_second_implementation_of_its_stages(spark, tmp_path):
    """Exact copies, near copies, the queue and the tokens anew, in plain Python and with the library; junk has no language."""
    rows = documents()
    extra = [(9000, rows[0][1], "en", "s0", 1), (9001, rows[0][1], None, "s1", 2), (9002, None, "en", "s0", 0), (9003, "", "en", "s1", 0), (9004, "12 34 !!", "en", "s2", 8)]
    spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    pages(spark, tmp_path)
    known = [r for r in rows + extra if r[1] and re.search("[a-z]", r[1])]
    last = {}
    for r in known:
        last[r[1]] = max(r, last.get(r[1], r))
    left = stay(last.values(), 80)[0]
    by_id = {r[0]: r for r in last.values()}
    assert 9001 in by_id and rows[0][0] not in by_id and len(left) < len(by_id) < len(known)
    served = mixed([by_id[i] for i in left])
    library = pieces.Vocabulary(tokenizer_file()).library
    want = Counter()
    for i in served:
        ids = library.encode(by_id[i][1])
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == want
    kept = spark.createDataFrame([by_id[i] for i in sorted(left)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.mix_sources(spark, kept, "").collect()] == served  # in the order of service
    empty = tmp_path / "empty"
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{empty}/documents.parquet")
    pages(spark, empty)
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_pipeline_drops_near_copies_from_08_on(spark, tmp_path):
    rows = documents()
    want, links = stay(rows, 80)
    assert sum(0.8 <= x < 0.85 for x in links) >= 10 and want != stay(rows, 85)[0]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()} == want
