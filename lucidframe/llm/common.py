"""What the corpus operators share: the shared scratch folder, size-checked broadcasts, ranks, hashes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only below these; both are counted on the written table first.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20
#: A key is heavy if more than one in so many rows holds it.
HEAVY = 10_000

#: Words of a text: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir or setCheckpointDir; one of our own only where neither is set and all runs in one process, as in tests."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and context._jsc.sc().getCheckpointDir().isDefined():
        root = context._jsc.sc().getCheckpointDir().get()
    if not root:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = context.applicationId
        if app not in _roots:
            _roots[app] = tempfile.mkdtemp(prefix="lucidframe-")
            atexit.register(shutil.rmtree, _roots[app], ignore_errors=True)
        root = _roots[app]
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared root; removed when the driver's Python ends."""
    path = f"{shared_root(spark)}/lucidframe/{label}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back: computed once, lineage cut, safe to lose executors."""
    return written(df, label)[0]


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The same, and the folder, for tables that are discarded once a later one holds their content."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a written table that no frame needs any more."""
    _remove(spark, path)


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of at most 1,024 rows, unless the session asks for other ones: 10,000 long texts don't fit beside a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, "1024")


def fits_broadcast(df: DataFrame) -> bool:
    """Whether a written frame's counted rows and bytes are small."""
    flexible = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    width = sum(flexible, F.lit(16 * len(df.columns)))
    rows, used = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and used <= BROADCAST_BYTES


def bounded_broadcast(df: DataFrame) -> DataFrame:
    """Mark a written frame for broadcast if it is small; else leave the join to shuffle."""
    return F.broadcast(df) if fits_broadcast(df) else df


def looked_up(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, how: str = "left") -> DataFrame:
    """Rows joined, inner or left, with a written frame of one row for each key, whose `weight` is how many rows hold the key.

    Small facts are broadcast. Of larger ones the heavy keys are, those that more than one in HEAVY rows hold, which are fewer than HEAVY; so a
    heavy key's rows stay where they are, and no key that is shuffled holds more than one in HEAVY rows. Rows without a key aren't shuffled either.
    """
    plain = facts.drop(weight)
    if fits_broadcast(plain):
        return rows.join(F.broadcast(plain), keys, how)
    total = facts.agg(F.sum(weight)).first()[0]
    heavy = F.col(weight) * HEAVY > total
    hot = bounded_broadcast(materialize(facts.where(heavy).drop(weight), "heavy"))
    nothing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    held = rows.where(~nothing)
    parts = [held.join(hot, keys), held.join(hot.select(*keys), keys, "left_anti").join(facts.where(~heavy).drop(weight), keys, how)]
    if how == "left":
        parts.append(rows.where(nothing).withColumns({c: F.lit(None).cast(kind) for c, kind in plain.dtypes if c not in keys}))
    return reduce(DataFrame.unionByName, parts)


def running_sum(df: DataFrame, order: list[Column], size: Column, name: str) -> DataFrame:
    """The sum of `size` up to each row in a total order, without one task seeing all rows: range partitions, then an offset for each."""
    part, held = unused(df, "__lf_part"), unused(df, "__lf_held")
    ranged = materialize(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranged")
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(part).agg(F.sum(size).alias(held))  # a row for each range partition
    offsets = offsets.withColumn(held, F.coalesce(F.sum(held).over(ahead), F.lit(0)))
    within = F.sum(size).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn(name, within).join(F.broadcast(offsets), part).withColumn(name, F.col(name) + F.col(held)).drop(part, held)


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """0-based rank in a total order."""
    return running_sum(df, order, F.lit(1).cast("long"), name).withColumn(name, F.col(name) - 1)


def numbered(df: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """The frame and the column that numbers its rows: the ids, if they are unique whole numbers; else numbers written with the rows."""
    ids = F.col(f"`{id_col}`")
    if df.schema[id_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        counts = df.select(ids.cast("long").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        if counts.where("n > 1 OR id IS NULL").isEmpty():
            return df, id_col
    name = unused(df, "__lf_row")
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def shuffled_unit(seed: str, *columns: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5 of the columns: a shuffle that any engine can repeat."""
    return F.conv(F.substring(shuffled_key(seed, *columns), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def shuffled_key(seed: str, *columns: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))


def empty_text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def seeds64(n: int, seed: int, odd: bool = False) -> np.ndarray:
    """n fixed 64-bit numbers from a seed."""
    x = mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15))
    return x | np.uint64(1) if odd else x


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def has_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
