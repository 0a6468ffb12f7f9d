import random
import time

from lucidframe.llm import line_dedup


def brute(rows):
    """Delete what lies in an earlier window of three lines, or of fewer with more than 50 words or 300 letters."""
    gone = {i: set() for i, _ in rows}
    cut = {i: t.split("\n") for i, t in rows}
    for run in (1, 2, 3):
        seen = {}
        for i, _ in sorted(rows):
            for s in range(len(cut[i]) - run + 1):
                lines = cut[i][s : s + run]
                words = " ".join(lines).split()
                if run < 3 and len(words) <= 50 and sum(map(len, words)) <= 300:
                    continue
                first, start = seen.setdefault(tuple(lines), (i, s))
                if (first, start) != (i, s):
                    gone[i].update(range(max(s, start + run) if first == i else s, s + run))
    return {i: "\n".join(x for k, x in enumerate(cut[i]) if k not in gone[i]) for i, _ in rows}


def test_long_runs_of_fewer_lines_go(spark):
    rng = random.Random(3)
    pool = [" ".join(f"w{k}x{j}" for j in range(n)) for k, n in enumerate([51, 80, 50, 30, 30, 26, 25, 4, 3])] + ["字" * 301, "字" * 300]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"own {i} {k}" for k in range(rng.randrange(1, 9)))) for i in range(80)]
    rows += [(90, pool[0]), (91, f"{pool[3]}\n{pool[4]}"), (92, f"{pool[3]}\n{pool[4]}"), (93, "\n".join([pool[1]] * 4))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert want[90] == want[92] == "" and {r.doc_id: r.text for r in line_dedup.drop_lines(df).collect()} == want
    few = {r.doc_id: r.text for r in line_dedup.drop_lines(df, long=False).collect()}
    assert few[90] == pool[0] and few[92] == rows[-2][1]


def test_texts_of_many_lines_take_time_in_proportion(spark):
    took = {}
    for n in (1000, 50_000, 200_000):
        text = "\n".join(f"line {k} of many" for k in range(n))
        df = spark.createDataFrame([(1, text), (2, text + "\nlast"), (3, "own")], "doc_id long, text string")
        started = time.perf_counter()
        got = {r.doc_id: r.text for r in line_dedup.drop_lines(df).collect()}
        took[n] = time.perf_counter() - started
        assert got == {1: text, 2: "last", 3: "own"}
    assert took[200_000] < 10 * took[50_000]


def test_repeated_and_null_ids_and_any_column_names(spark):
    text = "a\nb\nc\nd"
    rows = [(1, text, 1, "x"), (1, text, 2, "x"), (None, text, 3, "x"), (None, "own\nb", 4, "x"), (1, "p\nq\nr\n" + text, 5, "x")]
    df = spark.createDataFrame(rows, "doc_id int, text string, row int, __lf_gone string")
    cleaned = line_dedup.drop_lines(df)
    assert cleaned.columns == df.columns
    got = {r.row: r.text for r in cleaned.collect()}
    assert got[3] == "" and got[4] == "own\nb"  # a null id comes after all others
    whole = [t for k, t in got.items() if k in (1, 2, 5) and t.endswith(text)]
    assert len(whole) == 1 and got[5].startswith("p\nq\nr")  # one row with the id keeps the run
    assert line_dedup.mark_lines(df).count() == 5
