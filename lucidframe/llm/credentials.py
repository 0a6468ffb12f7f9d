"""Secret scans: plain patterns, and credentials whose parts lie in several places, linked by an interval join.

Plain findings (`assign`, `access`, `hex`) stand for themselves and are always reported. Weak candidates say too little alone:

* `identifier`: a user, login, account or client id that is assigned a value of 3 characters or more
* `secret`: a password or key assigned a value too short for a plain finding (4 or more), one under a name that plain findings don't
  know, or a run of 32 or more base-64 characters with capitals, small letters and digits
* `endpoint`: an address with a scheme, an assigned host or server, an IPv4 address with a port

Each is a part of a credential by its role. Parts are intervals of a text; one is linked to another if a secret meets an identifier or an
endpoint in the same scope (scopes end at blank lines and at section headers in brackets) with at most `REACH` characters between
the two. The link is an interval join: the place where the left part ends and the place where the right one begins are cut
into bins of REACH characters, and bins are joined by row, scope and bin, so no text's parts meet as a whole: a bin holds no more of
them than REACH characters can. Plain findings are parts too: `access` as an identifier; `assign`, and hex of 32 or more with a
letter, as a secret. A weak candidate is reported if it is linked, else not.

Texts are read once, in Arrow batches, as UTF-8; spans count code points, their ends are exclusive. Only spans are written and joined.

Defined results: a null text counts as empty and has no findings; repeated and null ids are scanned row by row; plain findings of a
kind don't overlap, those of several kinds may, and a weak candidate that overlaps a plain finding is dropped; capital letters A-Z
count as small ones in names, no other letters do; an empty table gives an empty result. `scan` reads only the id and text columns;
`redact` returns all columns, whatever they are called.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucidframe.llm.common import bounded_broadcast, empty_text, has_columns, materialize, numbered, small_batches, unused
from lucidframe.shipping import ship

#: Characters between two parts of a credential, at most, and the width of a bin of the join.
REACH = 240
#: Kinds in the order in which findings of one place are listed; the first three are plain.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
PLAIN = 3
IDENTIFIER, SECRET, ENDPOINT = 1, 2, 4

# The patterns of plain findings, on bytes; names are matched in a copy with small letters.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ASSIGN_HINTS = (b"passw", b"secret", b"token", b"api")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
LEAST_VALUE, LEAST_ACCESS = 12, 18

_SIGN = re.compile(rb"[:=]")
_NAMES = re.compile(
    rb"""(?:(?P<i>user(?:_?name)?|login|account|client_?id|access_?key_?id|uid|e-?mail)|(?P<s>pwd|pass|passphrase|private_?key|auth_?key|access_?key|credentials?)"""
    rb"""|(?P<e>host(?:name)?|server|endpoint|database|db_?url|base_?url))["']?\x20{0,8}\Z"""
)
_VALUE = re.compile(rb"""\x20{0,8}["']?([^\s"'`,;<>(){}\[\]]+)""")
_SCHEME = re.compile(rb"[a-z][a-z0-9+.-]{1,15}\Z")
_ADDRESS = re.compile(rb"""[^\s"'`<>]{3,}""")
_NUMBERS = re.compile(rb"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}\Z")
_PORT = re.compile(rb"[0-9]{2,5}(?![0-9.])")
_MIXED = re.compile(rb"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}={0,2}")
_SCOPE = re.compile(rb"\n[ \t\r\f\v]*(?=\n)|\n(?=\[[^\]\n]{1,64}\])")


def plain(raw: bytes, low: bytes) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of a text's plain findings in bytes, and those of assignments with values too short for one."""
    found, short = [], []
    if any(hint in low for hint in ASSIGN_HINTS):
        for m in ASSIGN.finditer(low):
            size = m.end(2) - m.start(2)
            (found if size >= LEAST_VALUE else short).append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= LEAST_ACCESS] if b"AKIA" in raw else []
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(raw)]
    return sorted(found), short


def weak(raw: bytes, low: bytes, found: list[tuple[int, int, int]], short: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the weak candidates, if the text has complementary parts at all."""
    out = [(a, 4, b) for a, _, b in short if b - a >= 4]
    for m in _SIGN.finditer(raw):
        at = m.start()
        before = low[max(0, at - 40) : at]
        if raw.startswith(b"://", at):
            scheme, rest = _SCHEME.search(before), _ADDRESS.match(raw, at + 3)
            if scheme and rest:
                out.append((at - len(scheme[0]), 5, rest.end()))
            continue
        name = _NAMES.search(before)
        if name:
            value = _VALUE.match(raw, at + 1)
            if value and value.end() - value.start(1) >= 3 + (name.lastgroup == "s"):
                out.append((at - len(name[0]), {"i": 3, "s": 4, "e": 5}[name.lastgroup], value.end()))
            continue
        numbers, port = _NUMBERS.search(before), _PORT.match(raw, at + 1)
        if numbers and port:
            out.append((at - len(numbers[0]), 5, port.end()))
    others = any(k == 1 for _, k, _ in found) or any(k in (3, 5) for _, k, _ in out)
    if others:
        for m in _MIXED.finditer(raw):
            run = m[0]
            if re.search(rb"[a-z]", run) and re.search(rb"[A-Z]", run) and re.search(rb"[0-9]", run):
                out.append((m.start(), 4, m.end()))
    # What overlaps a plain finding is part of it; of weak ones that overlap the first stays.
    kept, reach, taken = [], 0, sorted(found)
    starts = [a for a, _, _ in taken]
    ends = np.maximum.accumulate([b for _, _, b in taken]).tolist() if taken else []
    for a, k, b in sorted(out):
        beside = bisect_right(starts, b - 1)
        if a >= reach and not (beside and ends[beside - 1] > a):
            kept.append((a, k, b))
            reach = b
    return kept


def role(raw: bytes, kind: int, start: int, end: int) -> int:
    """The role of a finding in a credential, 0 for none."""
    if kind == 2:
        return SECRET if end - start >= 32 and re.search(rb"[a-f]", raw[start:end]) else 0
    return (SECRET, IDENTIFIER, 0, IDENTIFIER, SECRET, ENDPOINT)[kind]


def candidates(raw: bytes) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, role, scope) of all that a text may hold, in code points, by start and kind; weak ones only if a link is possible."""
    low = raw.lower()  # of bytes: A-Z alone
    found, short = plain(raw, low)
    maybe = weak(raw, low, found, short)
    roles = 0
    for a, k, b in (*found, *maybe):
        roles |= role(raw, k, a, b)
    if not (roles & SECRET and roles & (IDENTIFIER | ENDPOINT)):
        maybe = []
    if not found and not maybe:
        return []
    scopes = [m.start() for m in _SCOPE.finditer(raw)] if maybe else []
    every = sorted((*found, *maybe))
    if raw.isascii():
        place = lambda b: b
    else:
        before = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
        place = lambda b: int(before[b])
    return [(place(a), k, place(b), role(raw, k, a, b), bisect_right(scopes, a)) for a, k, b in every]


_PART = pa.struct([("start", pa.int64()), ("place", pa.int32()), ("end", pa.int64()), ("role", pa.int32()), ("scope", pa.int64())])
_PART_SQL = "array<struct<start:bigint,place:int,end:bigint,role:int,scope:bigint>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        parts = [[dict(zip(("start", "place", "end", "role", "scope"), x)) for x in candidates(t.as_py())] for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(_PART))], ["id", "parts"])


def _parts(rows: DataFrame, id_type: T.DataType) -> DataFrame:
    """(id, row, parts) of (id, text) rows, written; row numbers the rows."""
    ship(rows.sparkSession)
    small_batches(rows.sparkSession)
    schema = T.StructType([T.StructField("id", id_type), T.StructField("parts", T._parse_datatype_string(_PART_SQL))])
    return materialize(rows.mapInArrow(_scan, schema).withColumn("row", F.monotonically_increasing_id()), "candidates")


def link(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """(row, scope, left, right) of linked parts, for (row, start, place, end, role, scope) rows: left and right are (start, place, end, role).

    The interval join: the end of the left part and the start of the right one lie in the same bin or in neighbouring ones.
    """
    part = F.struct("start", "place", "end", "role")
    left = parts.select("row", "scope", F.floor(F.col("end") / reach).alias("bin"), part.alias("left"))
    at = F.floor(F.col("start") / reach)
    right = parts.select("row", "scope", F.explode(F.array(at, at - 1)).alias("bin"), part.alias("right"))
    gap = F.col("right.start") - F.col("left.end")
    roles = F.col("left.role").bitwiseOR(F.col("right.role"))  # exactly one of the two is a secret
    return left.join(right, ["row", "scope", "bin"]).where(gap.between(0, reach) & (F.col("left.role") != F.col("right.role")) & (roles.bitwiseAND(SECRET) != 0)).select("row", "scope", "left", "right")


def _linked(found: DataFrame, reach: int) -> DataFrame:
    """(row, added): the weak candidates with a link."""
    some = found.where(F.exists("parts", lambda p: p["place"] >= PLAIN)).select("row", F.explode("parts").alias("p")).select("row", "p.*").where("role > 0")
    links = link(some, reach)
    sides = links.select("row", F.explode(F.array("left", "right")).alias("p")).where(F.col("p.place") >= PLAIN)
    return sides.groupBy("row").agg(F.collect_set(F.struct("p.start", "p.place", "p.end")).alias("added"))


def _findings(found: DataFrame, reach: int) -> DataFrame:
    """(row, id, findings: [(start, place, end)]) with the linked weak candidates, in order."""
    added = bounded_broadcast_of(_linked(found, reach)).withColumnRenamed("row", "of")
    own = F.transform(F.filter("parts", lambda p: p["place"] < PLAIN), lambda p: F.struct(p["start"].alias("start"), p["place"].alias("place"), p["end"].alias("end")))
    both = F.array_sort(F.concat(own, F.coalesce("added", F.array().cast("array<struct<start:bigint,place:int,end:bigint>>"))))
    return found.join(added, F.col("row") == F.col("of"), "left").select("row", "id", both.alias("findings"))


def bounded_broadcast_of(linked: DataFrame) -> DataFrame:
    """The linked candidates, written; broadcast if they are few and short, else joined by row."""
    written = materialize(linked, "linked")
    spans = written.agg(F.coalesce(F.sum(F.size("added")), F.lit(0))).first()[0]
    return bounded_broadcast(written) if spans <= 200_000 else written


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row for each input row: id and findings, an array of (kind, start, end) in order of start and kind."""
    has_columns(df, id_col, text_col)
    found = _parts(df.select(F.col(f"`{id_col}`").alias("id"), empty_text(F.col(f"`{text_col}`")).alias("text")), df.schema[id_col].dataType)
    named = F.transform("findings", lambda x: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), x["place"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return _findings(found, reach).select(F.col("id").alias(id_col), named.alias("findings"))


def listed(findings: Column) -> Column:
    """kind:start:end of findings, joined by commas."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, counts of the plain kinds, base_sha256 of the plain spans, all spans."""
    of = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("findings", lambda x: x["kind"].isin(*KINDS[:PLAIN]))
    counts = [of(k).alias(f"n_{k}") for k in KINDS[:PLAIN]]
    return scan(df, id_col, text_col).select(F.col(f"`{id_col}`"), *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """All rows and columns, each finding of the text replaced by its kind in angle brackets; findings that overlap become one."""
    has_columns(df, id_col, text_col)
    columns = df.columns
    df, number = numbered(df, id_col)
    rows = df.select(F.col(f"`{number}`").cast("long").alias("id"), empty_text(F.col(f"`{text_col}`")).alias("text"))
    found = _findings(_parts(rows, T.LongType()), reach).where(F.size("findings") > 0)
    row, spans = unused(df, "__lf_of"), unused(df, "__lf_spans")
    found = found.select(F.col("id").alias(row), F.col("findings").alias(spans))

    @F.pandas_udf("string")
    def masked(text: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([mask(t, k) for t, k in zip(text, known)], dtype=object)

    joined = df.join(found, F.col(f"`{number}`").cast("long") == F.col(row), "left")
    clean = masked(F.col(f"`{text_col}`").cast("string"), F.col(spans))
    return joined.select(*[(clean.alias(c) if c == text_col else F.col(f"`{c}`")) for c in columns])


def mask(text: str | None, known) -> str | None:
    if text is None or known is None:
        return text
    out, at = [], 0
    for x in known:
        if x["start"] >= at:
            out += [text[at : x["start"]], f"<{KINDS[x['place']]}>"]
        at = max(at, x["end"])
    return "".join((*out, text[at:]))
