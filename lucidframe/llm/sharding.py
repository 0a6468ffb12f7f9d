"""Sharding by a permutation-filled lookup table.

Every shard has a preference order of the slots of a prime-sized table: slot (start + k * step) mod size, start and step
from an md5 of its name. The shards take turns, in order of weighted turns served; the shard whose turn it is claims the
first slot of its order that is still free, until the table is full. The table, at most `SLOTS` rows whatever the data,
is broadcast, and a row's place is one look at slot `md5(id) mod size`. If a shard comes or goes, few other slots move.

Defined results: a null id is placed like an empty string; equal ids share a shard; an empty table gives an empty
result; `place` reads only the id column, `assign` keeps all columns, whatever they are called, and adds `slot` and `shard`;
if the rows have columns of these names it raises an error, and other names must be given.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidframe.llm.common import has_columns, unused

#: Size of the table, a prime far above the number of shards.
SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str] = SHARDS, slots: int = SLOTS, weights: Mapping[str, float] | None = None) -> np.ndarray:
    """Index of the owning shard for each slot."""
    shards = list(shards)
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct names, at least one and no more than there are slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime")
    weight = [float((weights or {}).get(s, 1.0)) for s in shards]
    if min(weight) < 0 or max(weight) <= 0:
        raise ValueError("weights must not be negative, and one must be positive")
    start = [_number(f"start|{s}") % slots for s in shards]
    step = [_number(f"step|{s}") % (slots - 1) + 1 for s in shards]
    owner = np.full(slots, -1, dtype=np.int32)
    at, credit, left, top = list(start), [0.0] * len(shards), slots, max(weight)
    while left:
        for i, w in enumerate(weight):
            credit[i] += w / top
            if credit[i] < 1.0 or not left:
                continue
            credit[i] -= 1.0
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            owner[at[i]] = i
            left -= 1
    return owner


def table_frame(spark: SparkSession, shards: Sequence[str] = SHARDS, slots: int = SLOTS, weights: Mapping[str, float] | None = None) -> DataFrame:
    owner = lookup_table(shards, slots, weights)
    return spark.createDataFrame(pa.table({"__lf_slot": pa.array(np.arange(slots), pa.int64()), "__lf_shard": pa.array([shards[i] for i in owner], pa.string())}))


def assign(df: DataFrame, id_col: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS, weights=None, slot_name: str = "slot", shard_name: str = "shard") -> DataFrame:
    """All rows with their slot and shard."""
    has_columns(df, id_col)
    clash = {slot_name.lower(), shard_name.lower()} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"the rows have columns called {', '.join(sorted(clash))}; give slot_name and shard_name")
    key = F.conv(F.substring(F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    at, slot, shard = (unused(df, n) for n in ("__lf_at", "__lf_slot", "__lf_shard"))
    table = table_frame(df.sparkSession, shards, slots, weights).toDF(slot, shard)
    placed = df.withColumn(at, F.pmod(key, F.lit(slots))).join(F.broadcast(table), F.col(at) == F.col(slot))
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], F.col(slot).alias(slot_name), F.col(shard).alias(shard_name))


def place(df: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """id, slot and shard of each row."""
    return assign(df.select(F.col(f"`{id_col}`")), id_col, **how)


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", files: int = 1, shard_name: str = "shard", **how) -> None:
    """Parquet folders by shard, each written by `files` tasks; rows within a file stand in id order."""
    slot, file = unused(df, "__lf_slot_of"), unused(df, "__lf_file")
    rows = assign(df, id_col, slot_name=slot, shard_name=shard_name, **how).withColumn(file, F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(files)))
    rows = rows.repartition(shard_name, file).sortWithinPartitions(shard_name, F.col(f"`{id_col}`"))
    rows.drop(file, slot).write.partitionBy(shard_name).parquet(path)
