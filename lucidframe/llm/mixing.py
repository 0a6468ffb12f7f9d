"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source is a flow. Its documents stand in a shuffled order (md5 of seed and id), repeated once it is used up, and
a copy's virtual finish time is the source's words up to its end divided by the source's target. All copies are
range-sorted by virtual finish time, words are summed up over the ranges, and the queue is cut where the sum exceeds
the budget, the sum of the targets. At time 1 every source has taken its target but for the document that its target
falls into, so what fits the budget by then is always served. The cut names the last copy served of each source, and a
document is taken as often as its copies end no later.

The prefix sums of a source don't need it in one task: its documents are dealt by their shuffled place into buckets of about
BUCKET rows, at most BUCKETS of them, sums are made within buckets and buckets are added up from one row each. The queue
moves four numbers for each copy; whole texts are read once for their sizes, and `mix` then shuffles them in one join and
one range sort.

Defined results: a null text has size 0 and is never taken; a null source is a source of its own, after all others; a
source without words, or a table without any, has target 0 and takes nothing; repeated rows are documents of their own; a
text longer than its source's target may be left out; an empty table gives an empty result. `schedule` reads only the id,
source and text columns; `mix` returns all columns, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucidframe.llm.common import WORD, bounded_broadcast, global_rank, has_columns, materialize, numbered, running_sum, shuffled_key, unused

#: Weights by the sources' rank, the budget as a share of all words, most copies of a document.
WEIGHTS, BUDGET, REPEATS = (5, 2, 1), 1.5, 2
#: Rows of a source that one window sorts together, about, and most buckets of a source.
BUCKET, BUCKETS = 4096, 65_536
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, budget=BUDGET, repeats=REPEATS) -> tuple[DataFrame, float]:
    """(source, rank, rows, words, target) for (source, size) rows, shares by weight held at `repeats` times a source's words; and the budget."""
    totals = sized.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("words"))
    ranked = global_rank(totals, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("rank", F.lit(len(weights))).cast("int") + 1)
    table = materialize(ranked.withColumn("weight", weight).withColumn("cap", F.col("words") * float(repeats)), "sources")
    goal = float((table.agg(F.sum("words")).first()[0] or 0) * budget)
    # The level at which shares stop rising: each round holds the sources that the last level overfills.
    level, last = 0.0, None
    while level != last:
        over = F.col("cap") < F.lit(level) * F.col("weight")
        held, free = table.agg(F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight")))).first()
        last, level = level, max(level, (goal - (held or 0.0)) / free) if free else level
    return table.select("source", "rank", "rows", "words", F.least("cap", F.lit(level) * F.col("weight")).alias("target")), goal


def _placed(rows: DataFrame, weights, budget, repeats) -> tuple[DataFrame, float]:
    """(number, size, rank, words, target, before) for (number, source, size, key) rows, before the words of the source's earlier documents; and the budget."""
    rows = materialize(rows, "sizes")
    sources, goal = source_targets(rows.select("source", "size"), weights, budget, repeats)
    sources = bounded_broadcast(materialize(sources.withColumnRenamed("source", "name"), "targets"))
    buckets = F.least(F.lit(BUCKETS), F.greatest(F.lit(1), F.ceil(F.col("rows") / BUCKET)))
    unit = F.conv(F.substring("key", 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))

    def dealt(some: DataFrame) -> DataFrame:
        return some.join(sources, F.col("source").eqNullSafe(F.col("name"))).withColumn("bucket", F.floor(unit * buckets))

    sums = dealt(rows.select("source", "size", "key")).groupBy("rank", "bucket").agg(F.sum("size").alias("sum"))
    ahead = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows
    offsets = sums.select("rank", "bucket", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("offset"))
    offsets = bounded_broadcast(materialize(offsets, "offsets"))
    own = Window.partitionBy("rank", "bucket").orderBy("key", "number", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(own), F.lit(0)) + F.col("offset")
    placed = dealt(rows).join(offsets, ["rank", "bucket"]).select("number", "size", "rank", "words", "target", before.alias("before"))
    return materialize(placed, "placed"), goal


def _served(placed: DataFrame, goal: float, repeats: int) -> DataFrame:
    """(rank, last): the words of each source up to the end of the last copy that the queue serves within the budget."""
    end = F.col("before") + F.col("size") + F.col("words") * F.col("copy")
    copies = placed.where("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).select("rank", "size", end.alias("end"), (end / F.col("target")).alias("finish"))
    queue = running_sum(copies, [F.col("finish"), F.col("rank"), F.col("end")], F.col("size"), "sum")
    return bounded_broadcast(materialize(queue.where(F.col("sum") <= goal).groupBy("rank").agg(F.max("end").alias("last")), "cut"))


def _schedule(df: DataFrame, number: str, id_col: str, source_col: str, text_col: str, weights, budget, repeats: int, seed: str) -> DataFrame:
    """(number, size, rank, words, target, before, copies): each row and how often the queue serves it."""
    rows = df.select(F.col(f"`{number}`").alias("number"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"), shuffled_key(seed, F.col(f"`{id_col}`")).alias("key"))
    placed, goal = _placed(rows, weights, budget, repeats)
    joined = placed.join(_served(placed, goal, repeats), "rank", "left")
    end = F.col("before") + F.col("size")
    times = sum((F.coalesce(end + F.col("words") * k <= F.col("last"), F.lit(False)).cast("int") for k in range(repeats)), F.lit(0))
    return joined.withColumn("copies", F.when(F.col("size") > 0, times).otherwise(0))


def schedule(df: DataFrame, id_col="doc_id", source_col="source", text_col="text", *, weights=WEIGHTS, budget=BUDGET, repeats=REPEATS, seed=SEED) -> DataFrame:
    """One row for each document: id, size, source_size, target (of its source), taken, copies, virtual_finish (of its first copy)."""
    has_columns(df, id_col, source_col, text_col)
    rows = _schedule(df, id_col, id_col, source_col, text_col, weights, budget, repeats, seed)
    finish = F.try_divide((F.col("before") + F.col("size")).cast("double"), F.col("target"))
    return rows.select(
        F.col("number").alias(id_col), "size", F.col("words").alias("source_size"), "target",
        (F.col("size") * F.col("copies")).alias("taken"), "copies", finish.alias("virtual_finish"),
    )


def mix(df: DataFrame, id_col="doc_id", source_col="source", text_col="text", *, weights=WEIGHTS, budget=BUDGET, repeats=REPEATS, seed=SEED) -> DataFrame:
    """The mix itself: whole rows, repeated as often as they are taken, range-sorted by virtual finish time."""
    has_columns(df, id_col, source_col, text_col)
    columns = df.columns
    df, number = numbered(df, id_col)
    taken = _schedule(df, number, id_col, source_col, text_col, weights, budget, repeats, seed).where("copies > 0")
    end = F.col("before") + F.col("size")
    times = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: F.struct(((end + F.col("words") * k) / F.col("target")).alias("finish"), F.col("rank"), (end + F.col("words") * k).alias("end")))
    key, turn = unused(df, "__lf_number"), unused(df, "__lf_turn")
    taken = materialize(taken.select(F.col("number").alias(key), times.alias(turn)), "taken")
    joined = df.join(taken.hint("shuffle_hash"), F.col(f"`{number}`") == F.col(key))  # texts are not sorted for the join
    served = joined.select(*[F.col(f"`{c}`") for c in columns], F.explode(turn).alias(turn))
    return served.orderBy(turn).select(*[F.col(f"`{c}`") for c in columns])
