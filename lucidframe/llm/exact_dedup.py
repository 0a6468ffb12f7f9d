"""Exact dedup by a heavy-hitter split, in DataFrame operations only.

A Misra-Gries sketch (Spark's `approx_top_k`, a frequent-items sketch that merges across tasks) names the digests that
may be frequent. Their rows are counted exactly with map-side partial sums, and the verified winners, at most
`HEAVY` rows, are broadcast: the rows of a digest that a third of the table shares never meet in one task. All other
digests take one ordinary shuffle.

Defined results: a null text counts as empty, so null and empty texts form one group; the row with the largest id
stays; rows with a null id lose to any other and, among themselves, all count as the one that stays (`flag_copies`)
or one of them stays (`drop_copies`); repeated rows are counted each, and one of them stays. An empty table gives an empty
result. Only the id and text columns are read by `flag_copies`; `drop_copies` returns all columns, whatever they are called.
It moves digests and row numbers only: the losers among frequent digests go by the broadcast winners, the others in one anti-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lucidframe.llm.common import bounded_broadcast, empty_text, has_columns, materialize, numbered, unused

#: Digests that may be handled as frequent, and counters of the sketch. A digest with more than
#: rows / (0.75 * TRACKED) rows can't be missed by the sketch.
HEAVY, TRACKED = 256, 4096


def heavy_winners(keyed: DataFrame, key: str, id_col: str) -> DataFrame:
    """(key, keep_id, group_size) of the frequent keys, exact, at most HEAVY rows."""
    sketch = keyed.agg(F.expr(f"approx_top_k(`{key}`, {HEAVY}, {TRACKED})").alias("top"))
    names = sketch.select(F.explode("top").alias("x")).where("x.count > 1").select(F.col("x.item").alias(key))
    exact = keyed.join(F.broadcast(names), key, "left_semi").groupBy(key)
    return materialize(exact.agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "winners")


def flag_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256."""
    has_columns(df, id_col, text_col)
    digest = F.sha2(empty_text(F.col(f"`{text_col}`")), 256).alias("text_sha256")
    keyed = materialize(df.select(F.col(f"`{id_col}`").alias("doc_id"), digest), "digests")
    heavy = heavy_winners(keyed, "text_sha256", "doc_id")
    frequent = keyed.join(F.broadcast(heavy), "text_sha256")
    same = Window.partitionBy("text_sha256")
    rest = keyed.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti").select(
        "*", F.max("doc_id").over(same).alias("keep_id"), F.count(F.lit(1)).over(same).alias("group_size")
    )
    return frequent.unionByName(rest).select(
        F.col("doc_id").alias(id_col), "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. Texts are read twice, for their digests, and shuffled only if the losers are too many to broadcast."""
    has_columns(df, id_col, text_col)
    columns = df.columns
    df, number = numbered(df, id_col)
    digest = F.sha2(empty_text(F.col(f"`{text_col}`")), 256)
    place = F.struct(F.col(f"`{id_col}`").alias("id"), F.col(f"`{number}`").alias("number"))  # a null id is less than any other
    narrow = materialize(df.select(digest.alias("digest"), place.alias("place")), "digests")
    heavy = heavy_winners(narrow, "digest", "place").select("digest", F.col("keep_id.number").alias("stays"))
    rest = narrow.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    winners = rest.groupBy("digest").agg(F.max("place").alias("best"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    losers = rest.join(winners, "digest").where("place.number <> best.number").select("place.number")
    key, stays, gone = unused(df, "__lf_digest"), unused(df, "__lf_stays"), unused(df, "__lf_gone")
    left = df.withColumn(key, digest).join(F.broadcast(heavy.toDF(key, stays)), key, "left").where(F.col(stays).isNull() | (F.col(stays) == F.col(f"`{number}`")))
    losers = bounded_broadcast(materialize(losers.toDF(gone), "losers"))
    return left.join(losers, F.col(f"`{number}`") == F.col(gone), "left_anti").select(*[F.col(f"`{c}`") for c in columns])
