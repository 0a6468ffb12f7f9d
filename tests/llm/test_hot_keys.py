"""Lookups whose facts are too many to broadcast, with keys that a third of all rows hold."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lucidframe.llm import common, line_dedup, warc_zip


@pytest.fixture
def tight(monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(common, "HEAVY", 10)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_no_task_meets_a_hot_key(spark, tight, monkeypatch, how):
    n = 3000
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 30 == 1, None).when(F.col("id") % 7 == 1, F.concat(F.lit("alone"), "id")).otherwise(F.concat(F.lit("k"), (F.col("id") / 4).cast("int")))
    rows = common.materialize(spark.range(n).select("id", key.alias("key"), F.lit("p").alias("payload")).repartition(12), "rows")
    facts = common.materialize(rows.where("key IS NOT NULL").groupBy("key").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1"), "facts")
    assert facts.count() > common.BROADCAST_ROWS
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = common.looked_up(rows, facts, ["key"], "n", how).withColumn("task", F.spark_partition_id()).collect()
        plain = rows.join(facts.drop("n"), "key", how).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    of = lambda got: Counter((r["id"], r["key"], r["keep"], r["payload"]) for r in got)
    assert of(found) == of(plain) and (how == "inner" or len(found) == n)
    largest = lambda got: max(Counter(r.task for r in got).values())
    assert largest(plain) >= n // 3 and largest(found) <= n // 6


def test_packages_and_lines_beyond_the_broadcast(spark, tight):
    pages = [(i, f"http://h/{i}", "hot" if i % 3 == 0 else f"twice {i // 4}" if i % 4 < 3 else f"own {i}") for i in range(240)] + [(500, None, None), (501, None, "")]
    df = spark.createDataFrame(pages, "`page.id` long, url string, html string")
    got = {r.page_id: r.refers_to for r in warc_zip.round_trip(df, id_col="page.id", min_bytes=1).collect()}
    last = {}
    for i, _, h in pages:
        last[h] = max(i, last.get(h, i))
    assert got == {i: None if not h or last[h] == i else last[h] for i, _, h in pages}
    passages = [f"a{k}\nb{k}\nc{k}\nd{k}" for k in range(60)]
    docs = [(i, "\n".join(["license one\nlicense two\nlicense three"] * (i % 3 == 0) + [passages[i % 60], f"own {i}"])) for i in range(180)]
    want = {i: f"{t}" if i < 60 and (i == 0 or i % 3) else f"{passages[i]}\nown {i}" if i < 60 else f"own {i}" for i, t in docs}
    cleaned = line_dedup.drop_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in cleaned.collect()} == want
