import random
import re

import numpy as np

from lucidframe.llm import components, line_dedup, minhash, vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 200)] + [(7, 7)]
    got = {r.vertex: r.component for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = groups({x for e in links for x in e}, links)
    assert all(got.get(n, n) == c for n, c in want.items())
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    return sets, groups(ids, links)


def corpus(rng, n_base=25):
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for b in range(n_base):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 260))]
        for _ in range(rng.randrange(1, 9)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(" ".join(words))
    # A hot group: one text and many light edits of it, some of which are linked only to each other.
    base = [rng.choice(vocabulary) for _ in range(300)]
    for k in range(60):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 5])):
            words[rng.randrange(300)] = f"x{rng.randrange(9)}"
        rows.append(" ".join(words))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_minhash_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)  # buckets are searched in many blocks
    rows = corpus(random.Random(11))
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one two"), (n + 4, "ONE  two"), (n + 5, "é Ä"), (n + 6, "É Ä"), (n + 7, "ö " * 30), (n + 8, "z" * 3_000_000 + " a b c d")]
    sets, want = brute(rows)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, low string, component int")
    got = {r.doc_id: r for r in minhash.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    for i in got:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), want[i], want[i] == i)
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in want.items() if i == c)


def test_hubs_are_split_in_components(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB", 20)
    rng = random.Random(9)
    links = [(1, i) for i in range(2, 150)] + [(500, i) for i in range(300, 420)] + [(rng.randrange(600, 900), rng.randrange(600, 900)) for _ in range(150)] + [(149, 300)]
    got = {r.vertex: r.component for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = groups({x for e in links for x in e}, links)
    assert all(got.get(n, n) == c for n, c in want.items())


def test_minhash_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "q"), (9, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, 1, False), (None, None, True), (9, 9, True)], key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0 and minhash.drop_near_duplicates(df.limit(0)).count() == 0
    assert sorted(((r.doc_id, r.text) for r in minhash.drop_near_duplicates(df).collect()), key=str) == sorted([(1, "a b c d e f"), (None, "q"), (9, None)], key=str)


def test_repeated_ids_lose_no_text(spark):
    same, other = "a b c d e f g h", "quite another text that has words of its own"
    rows = [(1, same, 1), (5, same, 2), (5, other, 3), (None, same, 4), (None, "", 5), (None, "", 6), (5, "third text here", 7)]
    df = spark.createDataFrame(rows, "doc_id int, text string, __lf_row int")
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r["__lf_row"] for r in kept.collect()) == [1, 3, 5, 6, 7]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (5, 1, False), (5, 5, True), (None, 1, False), (None, None, True), (None, None, True), (5, 5, True)], key=str)


def test_ids_may_be_texts(spark):
    rows = [("b", "a b c d e f"), ("a", "a b c d e f"), ("c", "q r s")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted(tuple(r) for r in minhash.near_duplicates(df).collect()) == [("a", 2, "a", True), ("b", 2, "a", False), ("c", 1, "c", True)]
    assert sorted(r.doc_id for r in minhash.drop_near_duplicates(df).collect()) == ["a", "c"]


def test_sizes_at_the_threshold_meet(spark):
    """Sets of 17 and 20 of which one holds the other: similarity 0.85, in whatever size classes they fall."""
    rows = []
    for k, (small, large) in enumerate([(17, 20), (34, 40), (85, 100), (170, 200)]):
        words = [f"g{k}w{i}" for i in range(large + 4)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(words[: small + 4]))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[10 * k + 1] == 10 * k for k in range(4))


def test_long_texts_are_hashed_in_slices(monkeypatch):
    text = np.frombuffer((" ".join(f"Word{i % 97}" for i in range(5000))).encode(), np.uint8)
    whole = minhash.word_hashes(text)
    monkeypatch.setattr(minhash, "SLICE", 100)
    assert (minhash.word_hashes(text) == whole).all()


def brute_vectors(rows, cosine=0.9):
    fine = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(fine)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(fine[a]) == len(fine[b]) and fine[a] @ fine[b] / np.sqrt(fine[a] @ fine[a]) / np.sqrt(fine[b] @ fine[b]) >= cosine]
    count = {i: 0 for i, _ in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return links, count, groups([i for i, _ in rows], links)


def test_vector_forest_recall(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LEAF", 64)
    monkeypatch.setattr(vectors, "BLOCK", 40)
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(600)]
    for i in range(600, 900):  # near the threshold on both sides
        rows.append((i, (np.array(rows[i - 600][1]) + rng.standard_normal(16) * rng.uniform(0.2, 0.6)).tolist()))
    centre = rng.standard_normal(16)
    rows += [(i, (centre + 0.05 * rng.standard_normal(16)).tolist()) for i in range(900, 1000)]
    rows += [(i, rows[0][1]) for i in range(1000, 1040)]
    links, count, _ = brute_vectors(rows)
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    found = sum(r.n_links for r in got.values())
    assert found <= 2 * len(links) and found >= 0.97 * 2 * len(links)
    assert all(got[i].n_links <= count[i] for i in got)


def scattered(n, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(n // 2)]
    return rows + [(n // 2 + i, (np.array(rows[i][1]) + rng.standard_normal(16) * 0.25).tolist()) for i in range(n // 2)]


def test_leaves_stay_small_as_the_table_grows(spark, monkeypatch):
    """Trees of a small sample alone would compare a vector with four times as many others on four times the rows."""
    for name, value in (("SAMPLE", 150), ("LEAF", 60), ("CROWDED", 120)):
        monkeypatch.setattr(vectors, name, value)
    compared, recall = {}, {}
    for n in (1000, 4000):
        rows = scattered(n, n)
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        classes = vectors._classes(df, "vec_id", "embedding")[1]
        sizes = [r[0] for r in vectors.leaves_of(classes, vectors.TREES).groupBy("leaf").count().select("count").collect()]
        compared[n] = sum(x * x for x in sizes) / n
        links, count, _ = brute_vectors(rows)
        got = {r.vec_id: r.n_links for r in vectors.near_duplicates(df).collect()}
        assert all(got[i] <= count[i] for i in got)
        recall[n] = sum(got.values()) / (2 * len(links))
    assert compared[4000] < 1.5 * compared[1000], compared
    assert min(recall.values()) > 0.9, recall


def test_vector_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "x", 2), (2, [1.0, 0.0], "y", 3)], "vec_id long, embedding array<double>, code string, low int")
    assert {r.vec_id: r.component_id for r in vectors.near_duplicates(df).collect()} == {1: 1, 2: 1}


def test_vectors_without_links(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [-0.0, 1.0]), (11, [0.0, 1.0]), (12, [1e200, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 9))
    assert got[7] == (2, 7, True) and got[8] == (2, 7, False) and got[12] == (2, 7, False) and got[10] == (1, 10, True) and got[11] == (1, 10, False)
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    twice = spark.createDataFrame([(1, [1.0]), (1, [1.0]), (None, [1.0])], "vec_id long, embedding array<float>")
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(twice).collect()), key=str) == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1)], key=str)


def brute_lines(rows, run=3):
    """Delete what lies in a window of `run` lines that came earlier."""
    seen, gone = {}, {}
    cut = {i: [(k, x.strip(" \t\n\v\f\r")) for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\v\f\r")] for i, t in rows}
    for i, _ in sorted(rows):
        lines = cut[i]
        for s in range(len(lines) - run + 1):
            key = tuple(x for _, x in lines[s : s + run])
            if key not in seen:
                seen[key] = (i, s)
                continue
            first, start = seen[key]
            for p in range(max(s, start + run) if first == i else s, s + run):
                gone.setdefault(i, set()).add(lines[p][0])
    return {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone.get(i, ())) if i in gone else t for i, t in rows}


def test_line_runs_equal_brute_force(spark):
    rng = random.Random(2)
    passage = [f"shared {k}" for k in range(9)]
    rows = []
    for i in range(120):
        lines = [rng.choice([f"l{rng.randrange(30)}", "same", "", "  "]) for _ in range(rng.randrange(0, 14))]
        if rng.random() < 0.5:
            a = rng.randrange(7)
            lines[len(lines) // 2 : len(lines) // 2] = passage[a : a + rng.randrange(2, 9)]
        rows.append((i, "\n".join(lines)))
    rows += [(500, None), (501, ""), (502, "a\n" * 8), (503, "\t shared 0 \n\nshared 1\r\nshared 2")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string")
    want = brute_lines(rows)
    cleaned = line_dedup.drop_lines(df)
    assert cleaned.columns == df.columns
    assert {r.doc_id: r.text for r in cleaned.collect()} == want
    assert any(want[i] != t for i, t in rows)
    marked = {r.doc_id: r for r in line_dedup.mark_lines(df).collect()}
    assert all(marked[i].clean_chars == len(want[i] or "") for i, _ in rows)
    assert line_dedup.mark_lines(df.limit(0)).count() == 0
