"""Near-duplicate documents by MinHash, banding, verification on full shingle sets and star-contracted components.

1. Each text becomes its set of distinct five-word shingles (64-bit fingerprints of word fingerprints, made from the
   text's bytes with numpy). `BANDS * ROWS` universal hash minima are kept, one byte of each as a signature, and one
   64-bit key for each band.
2. Documents with equal sets are one class, represented by its smallest id: copies never meet as pairs.
3. Classes that share a band key are candidates. In each bucket all others are paired with the smallest member; buckets
   whose members then lie in different components are searched on (5). Pairs whose signatures can't reach the
   threshold are left out.
4. Candidate pairs are verified on their full sets: 100 * |A and B| >= percent * |A or B|.
5. Verified links are contracted by large-star and small-star. Buckets that then hold more than one component are
   searched block against block: signatures are compared within a task, and members with a plausible partner in
   another component are compared there on their full sets; a spanning forest of what holds comes out. Blocks hold members
   of one class of set sizes, and only classes whose sizes allow the threshold meet. So no link is lost by the
   stars, no group is expanded into all its pairs, and no task holds more than two blocks of a bucket.

A pair at the threshold of 0.85 misses all bands with probability (1 - 0.85 ** 4) ** 20 = 4e-7, one at 0.8 with 3e-5.

Defined results: null or empty texts, and texts of white space only, have the empty set and are linked with nothing; a
text of fewer than five words has one shingle, all its words; repeated rows fall into one class; an empty table gives an
empty result. Ids that are null, repeated or no whole numbers are no trouble, as rows are then numbered: a component is
named by its smallest id that isn't null, or by null. `near_duplicates` reads only the id and text columns and returns the
id under its name; `drop_near_duplicates` returns all columns, whatever they are called, of exactly one row of each
component, the one with the smallest id (null ids last; any of equal ones), and of all rows without shingles.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidframe.llm.common import bounded_broadcast, empty_text, has_columns, materialize, mix64, numbered, seeds64, small_batches, unused
from lucidframe.llm.components import connected_components
from lucidframe.shipping import ship

WORDS, BANDS, ROWS, PERCENT = 5, 20, 4, 85
#: Bytes of text that are hashed together; shingles of a text that are minimised together.
SLICE, STRIP = 1 << 17, 1 << 10
#: Members of a bucket's block in the search for links between components, and shingles that they hold together, about.
BLOCK, HELD = 512, 4 << 20
_POWER = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_A = seeds64(BANDS * ROWS, 1, odd=True)
_B = seeds64(BANDS * ROWS, 2)
_KEYS = seeds64(WORDS, 3, odd=True)
_BAND = seeds64(ROWS, 4, odd=True)
_PLACE = seeds64(BANDS, 5)  # keys of different bands differ, so a key alone names a bucket


def _word_hashes_slice(raw: np.ndarray, powers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of a stretch of bytes and the places of their first bytes."""
    inside = ~_SPACE[raw]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return np.empty(0, np.uint64), first
    length = last - first
    kept = raw[inside]
    starts = np.concatenate(([0], np.cumsum(length)[:-1]))
    place = np.arange(len(kept)) - np.repeat(starts, length)
    longest = int(length.max())
    if longest > len(powers):
        powers = _powers(longest)
    with np.errstate(over="ignore"):
        terms = (_LOWER[kept].astype(np.uint64) + np.uint64(1)) * powers[place]
        total = np.add.reduceat(terms, starts)
    return mix64(total ^ (length.astype(np.uint64) << np.uint64(40))), first


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _POWER), dtype=np.uint64)


_SHORT = _powers(256)


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """Fingerprints of the words of one text's bytes, long texts in slices cut at white space."""
    if len(raw) <= SLICE:
        return _word_hashes_slice(raw, _SHORT)[0]
    out, at = [], 0
    while at < len(raw):
        end = min(at + SLICE, len(raw))
        while end < len(raw) and not _SPACE[raw[end]]:
            step = np.flatnonzero(_SPACE[raw[end : end + SLICE]])
            end = min(end + (int(step[0]) if len(step) else SLICE), len(raw))
        out.append(_word_hashes_slice(raw[at:end], _SHORT)[0])
        at = end
    return np.concatenate(out)


def shingle_set(words: np.ndarray, width: int = WORDS) -> np.ndarray:
    """Sorted distinct fingerprints of runs of `width` words; of all words where there are fewer."""
    if not len(words):
        return words
    n = min(width, len(words))
    with np.errstate(over="ignore"):
        total = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            total += mix64(words[k : len(words) - n + 1 + k] + _KEYS[k % WORDS] * np.uint64(k // WORDS + 1)) * _KEYS[k % WORDS]
    return np.unique(mix64(total + np.uint64(n)))


def text_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The shingle set of each text of a column, from its UTF-8 bytes without making strings."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        # Texts that fit a slice together are hashed together, with a space between.
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        lo, hi = offsets[at], offsets[end]
        if hi - lo > SLICE:
            yield shingle_set(word_hashes(raw[lo:hi]))
            at = end
            continue
        sizes = np.diff(offsets[at : end + 1])
        joined = np.full(int(hi - lo) + len(sizes), 32, np.uint8)
        shift = np.repeat(np.arange(len(sizes)), sizes)
        joined[np.arange(int(hi - lo)) + shift] = raw[lo:hi]
        hashes, first = _word_hashes_slice(joined, _SHORT)
        bounds = np.searchsorted(first, (offsets[at : end + 1] - lo) + np.arange(len(sizes) + 1))
        for k in range(len(sizes)):
            yield shingle_set(hashes[bounds[k] : bounds[k + 1]])
        at = end


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each universal hash over a set."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(shingles), STRIP):
            part = shingles[k : k + STRIP]
            least = np.minimum(least, (_A[:, None] * part[None, :] + _B[:, None]).min(axis=1))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((mix64(least.reshape(BANDS, ROWS)) * _BAND).sum(axis=1, dtype=np.uint64) + _PLACE)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 2048):
            part = batch.slice(start, 2048)
            sizes, digests, bands, marks = [], [], [], []
            for s in text_sets(part.column(1)):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                if len(s):
                    least = minima(s)
                    bands.append(band_keys(least).view(np.int64))
                    marks.append((mix64(least) >> np.uint64(56)).astype(np.uint8).tobytes())
                else:
                    bands.append(None)
                    marks.append(None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                ["id", "n", "digest", "bands", "marks"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.view(np.int64) for s in text_sets(part.column(1))], pa.list_(pa.int64()))], ["id", "shingles"])


def _least_match(percent: int) -> int:
    """Equal signature bytes that a pair at the threshold has, less six standard deviations."""
    n, p = BANDS * ROWS, percent / 100
    return max(0, int(n * p - 6 * (n * p * (1 - p)) ** 0.5))


def _plausible(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the threshold and whose signatures make it possible."""
    smaller, larger = F.least("an", "bn"), F.greatest("an", "bn")
    return pairs.where((smaller * 100 >= larger * percent) & (F.expr(f"{_same_bytes('am', 'bm')} >= {_least_match(percent)}")))


def _same_bytes(a: str, b: str) -> str:
    return f"aggregate(sequence(1, {BANDS * ROWS}), 0, (s, i) -> s + if(substr({a}, i, 1) = substr({b}, i, 1), 1, 0))"


def _full_sets(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the texts asked for, made anew from the whole texts."""
    ids = bounded_broadcast(materialize(ids, "wanted"))
    return materialize(texts.join(ids, "id", "left_semi").mapInArrow(_sets, "id bigint, shingles array<bigint>"), "sets")


def _verify(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of (a, b) pairs, those that hold on full sets. `texts`: (id, text) of the classes."""
    sets = _full_sets(texts, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    return both.where(common.cast("long") * 100 >= union.cast("long") * percent).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _hits(table: pa.Table, percent: int):
    """Of two blocks of a bucket: the plausible pairs of members in different components that meet here first."""
    n, comp, side = (table.column(c).to_numpy() for c in ("n", "component", "side"))
    marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
    bands = np.stack(table.column("bands").to_numpy(zero_copy_only=False)) if len(n) else np.empty((0, BANDS), np.int64)
    need = _least_match(percent)
    here = int(np.flatnonzero(bands[0] == table.column("key")[0].as_py())[0]) if len(n) else 0
    alone = len(n) and table.column("first")[0] == table.column("second")[0]
    one, two = (np.arange(len(n)),) * 2 if alone else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    for start in range(0, len(one), 64):
        rows = one[start : start + 64]
        same = np.zeros((len(rows), len(two)), np.int16)
        for k in range(BANDS * ROWS):
            same += marks[rows, k][:, None] == marks[two, k][None, :]
        small, large = np.minimum(n[rows][:, None], n[two][None, :]), np.maximum(n[rows][:, None], n[two][None, :])
        hits = (same >= need) & (small * 100 >= large * percent) & (comp[rows][:, None] != comp[two][None, :])
        for k in range(here):  # a pair is looked at in the first band it shares
            hits &= bands[rows, k][:, None] != bands[two, k][None, :]
        if one is two:
            hits &= rows[:, None] < two[None, :]
        i, j = np.nonzero(hits)
        yield rows[i], two[j]


def _flag(percent: int):
    """The members of two blocks that have a plausible partner in another component."""

    def run(table: pa.Table) -> pa.Table:
        hit = np.zeros(table.num_rows, bool)
        for i, j in _hits(table, percent):
            hit[i] = hit[j] = True
        return table.filter(pa.array(hit))

    return run


def _confirm(percent: int):
    """A spanning forest of the links between components that hold on full sets, within two blocks."""

    def run(table: pa.Table) -> pa.Table:
        ids, comp = table.column("id").to_numpy(), table.column("component").to_numpy()
        sets = [np.asarray(x) for x in table.column("shingles").to_numpy(zero_copy_only=False)]
        root = {int(c): int(c) for c in comp}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for rows, others in _hits(table, percent):
            for i, j in zip(rows, others):
                x, y = find(int(comp[i])), find(int(comp[j]))
                if x == y:
                    continue
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if common * 100 >= (len(sets[i]) + len(sets[j]) - common) * percent:
                    root[max(x, y)] = min(x, y)
                    out.append((int(ids[i]), int(ids[j])))
        return pa.table({"u": pa.array([x[0] for x in out], pa.int64()), "v": pa.array([x[1] for x in out], pa.int64())})

    return run


_MEMBER = "key bigint, first bigint, second bigint, side int, id bigint, n bigint, marks binary, bands array<bigint>, component bigint"
_PAIR_OF_BLOCKS = ("key", "first", "second")


def _blocks(members: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Members (key, id, n, component) of buckets with several components, dealt into blocks and sent to every pair of blocks that needs them.

    A block is a number of its class of sizes and of its place in it. Sizes of a pair that can hold fall into one class or neighbours.
    """
    ratio = max(math.log(100 / percent) * 1.0001, 1e-9)
    members = members.withColumn("class", F.floor(F.log("n") / ratio))
    mixed = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    sizes = members.groupBy("key", "class").agg(F.count(F.lit(1)).alias("rows"), F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / HELD)).cast("long").alias("blocks"))
    sizes = materialize(sizes.join(mixed, "key", "left_semi"), "mixed")
    near = sizes.select("key", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class"), F.col("class").alias("near"), F.col("blocks").alias("held"))
    meets = materialize(sizes.join(near, ["key", "class"]), "meetings")
    sent = meets.agg(F.coalesce(F.sum(F.col("rows") * F.col("held")), F.lit(0))).first()[0]
    rows = members.select("key", "class", "id", "component").join(meets.drop("rows"), ["key", "class"])
    number = lambda kind, place: F.shiftleft(kind.cast("long"), 24) + place
    rows = rows.withColumn("own", number(F.col("class"), F.pmod(F.xxhash64("id"), F.col("blocks"))))
    rows = rows.join(own.select("id", "n", "marks", "bands"), "id")
    rows = rows.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("held") - 1))).withColumn("other", number(F.col("near"), F.col("place")))
    first, second = F.least("own", "other"), F.greatest("own", "other")
    dealt = rows.select("key", first.alias("first"), second.alias("second"), (F.col("own") != first).cast("int").alias("side"), "id", "n", "marks", "bands", "component")
    # The comparisons of a row take far longer than its bytes suggest, so there are more tasks than its bytes ask for.
    return dealt.repartition(max(2 * dealt.sparkSession.sparkContext.defaultParallelism, sent // 4096), *_PAIR_OF_BLOCKS)


def similar_components(texts: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """For (id, text) rows, ids unique and not null: (id, n, low) of all rows, low the id of its class, and (vertex, component) of linked classes."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    signed = materialize(texts.mapInArrow(_signatures, "id bigint, n bigint, digest binary, bands array<bigint>, marks binary"), "signatures")
    # One class for each set, named by its smallest id. Only classes of several rows need a join.
    filled = signed.where("n > 0").groupBy("digest")
    classes = materialize(filled.agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"), F.min_by(F.struct("n", "bands", "marks"), "id").alias("x")).select("id", "digest", "rows", "x.*"), "classes")
    several = classes.where("rows > 1").select("digest", F.col("id").alias("low"))
    labelled = signed.select("id", "n", "digest").join(several, "digest", "left").select("id", "n", F.coalesce("low", "id").alias("low"))
    own = classes.select("id", "n", "marks", "bands")
    # Buckets move ids only; sizes and signatures are fetched for what is left.
    spread = own.select("id", F.explode("bands").alias("key"))
    crowded = spread.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("a")).where("rows > 1").select("key", "a")
    members = materialize(spread.join(materialize(crowded, "buckets"), "key"), "members")
    stars = members.where("id <> a").select("a", F.col("id").alias("b")).distinct()
    stars = stars.join(own.select(F.col("id").alias("b"), F.col("n").alias("bn"), F.col("marks").alias("bm")), "b")
    stars = stars.join(own.select(F.col("id").alias("a"), F.col("n").alias("an"), F.col("marks").alias("am")), "a")
    pairs = materialize(_plausible(stars, percent).select("a", "b"), "pairs")
    links = materialize(_verify(pairs, texts, percent), "verified")
    labels = connected_components(links)
    named = members.select("key", "id").join(own.select("id", "n"), "id").join(labels, F.col("id") == F.col("vertex"), "left")
    named = materialize(named.select("key", "id", "n", F.coalesce("component", "id").alias("component")), "named")
    flagged = materialize(_blocks(named, own, percent).groupBy(*_PAIR_OF_BLOCKS).applyInArrow(_flag(percent), _MEMBER), "flagged")
    if not flagged.isEmpty():
        sets = _full_sets(texts, flagged.select("id").distinct())
        found = flagged.join(sets, "id").groupBy(*_PAIR_OF_BLOCKS).applyInArrow(_confirm(percent), "u bigint, v bigint")
        labels = connected_components(materialize(links.unionByName(found), "verified"))
    return labelled, labels


def _labelled(df: DataFrame, number: str, text_col: str, percent: int) -> DataFrame:
    """(number, n, component) of all rows."""
    rows, labels = similar_components(df.select(F.col(f"`{number}`").cast("long").alias("id"), empty_text(F.col(f"`{text_col}`")).alias("text")), percent)
    joined = rows.join(labels, F.col("low") == F.col("vertex"), "left")
    return joined.select(F.col("id").alias("number"), "n", F.coalesce("component", "low").alias("component"))


def _first_rows(df: DataFrame, number: str, id_col: str, labelled: DataFrame) -> DataFrame:
    """(component, first: its row with the smallest id, none: whether that is null) of the components of several rows."""
    ids = df.select(F.col(f"`{number}`").alias("number"), F.col(f"`{id_col}`").alias("id"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "number")
    found = labelled.join(ids, "number").groupBy("component").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return bounded_broadcast(materialize(found.select(F.col("component").alias("of"), F.col("first.number").alias("first"), F.col("first.id").alias("name")), "components"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row for each input row: id, n_shingles, component_id, kept."""
    has_columns(df, id_col, text_col)
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    narrow, number = numbered(df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), id_col)
    labelled = _labelled(narrow, number, text_col, percent)
    if number == id_col:
        name, component = F.col("number").cast(df.schema[id_col].dataType), F.col("component").cast(df.schema[id_col].dataType)
    else:
        labelled = materialize(labelled, "labelled")
        first = _first_rows(narrow, number, id_col, labelled)
        ids = narrow.select(F.col(f"`{number}`").alias("number"), F.col(f"`{id_col}`").alias("id"))
        labelled = labelled.join(ids, "number").join(first, F.col("component") == F.col("of"), "left")
        name, component = F.col("id"), F.when(F.col("of").isNull(), F.col("id")).otherwise(F.col("name"))
    return labelled.select(name.alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), name.eqNullSafe(component).alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows that stay, with all their columns: one for each component, and all without shingles."""
    has_columns(df, id_col, text_col)
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    columns = df.columns
    df, number = numbered(df, id_col)
    labelled = _labelled(df, number, text_col, percent)
    if number == id_col:
        gone = labelled.where("number <> component").select("number")
    else:
        labelled = materialize(labelled, "labelled")
        first = _first_rows(df, number, id_col, labelled)
        gone = labelled.join(first, F.col("component") == F.col("of")).where("number <> first").select("number")
    name = unused(df, "__lf_gone")
    gone = bounded_broadcast(materialize(gone.withColumnRenamed("number", name), "dropped"))
    return df.join(gone, F.col(f"`{number}`") == F.col(name), "left_anti").select(*[F.col(f"`{c}`") for c in columns])
