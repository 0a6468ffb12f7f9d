"""Fill-in-middle: a text is cut into prefix, middle and suffix at word boundaries and put together in another order.

An Arrow-batched pandas UDF does the work: `regex` walks over the text once and its matches' ends are kept in a compact array of
4 bytes each (8 beyond 2^32 characters); the two cuts are two lookups in that array. What a document becomes depends only on its id, the
seed and its text, by a SHA-256 of seed and id: the first two numbers place the cuts, the third decides whether it is transformed, the
fourth in which order. So reruns, other partitionings and lost executors change nothing, and there is no shuffle.

Forms: `psm` is <P>prefix<S>suffix<M>middle, `spm` is <S>suffix<P>prefix<M>middle, `plain` is the text itself. The text can be rebuilt from
output and form, as texts that hold a mark stay plain, and no mark can arise where parts meet.

Defined results: a null text counts as empty; an empty text is plain, with no units; a null id is hashed as an empty one; repeated ids
with equal texts have equal results; white space at the end is a unit of its own, elsewhere it belongs to the word behind it; an
empty table gives an empty result. `transform` and `restore` return all columns, whatever they are called.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidframe.llm.common import empty_text, has_columns, small_batches, unused
from lucidframe.shipping import ship

#: A word with the white space before it, or white space at the end of the text.
UNIT = regex.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of documents that are transformed, and of those the percent in spm order.
RATE, SPM = 50, 80

_RESULT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def unit_ends(text: str) -> array:
    """Where each unit of a text ends."""
    return array("I" if len(text) < 1 << 32 else "Q", (m.end() for m in UNIT.finditer(text)))


def seeds(seed: int, doc_id: object) -> list[int]:
    """Four numbers of 32 bits from the seed and an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def cut(text: str, doc_id: object, seed: int, rate: int = RATE, spm: int = SPM) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, of the middle, output) of a text."""
    ends = unit_ends(text)
    n = len(ends)
    first, second, chosen, order = seeds(seed, doc_id)
    if not text or chosen % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((first % (n + 1), second % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def rebuilt(output: str, form: str) -> str:
    """The text from which an output was made."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    if not output.startswith(first):
        raise ValueError(f"not an output of form {form}")
    a, found, rest = output[len(first) :].partition(second)
    b, also, middle = rest.partition(MIDDLE)
    if not (found and also):
        raise ValueError(f"not an output of form {form}")
    prefix, suffix = (a, b) if form == "psm" else (b, a)
    return prefix + middle + suffix


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = RATE, spm: int = SPM, into: str = "fim") -> DataFrame:
    """All rows and columns, and a struct column: n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256."""
    has_columns(df, id_col, text_col)
    into_ = unused(df, into)
    if into_ != into:
        raise ValueError(f"there is a column {into} already")
    ship(df.sparkSession)
    small_batches(df.sparkSession)

    @F.pandas_udf(_RESULT)
    def run(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for i, text in zip(ids, texts):
            n, form, a, b, output = cut(text, i, seed, rate, spm)
            rows.append((n, form, a, b, output, _sha256(output), _sha256(rebuilt(output, form))))
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"])
        return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    # As text, ids are the same to Python whatever their type and whether some are null.
    return df.withColumn(into, run(F.col(f"`{id_col}`").cast("string"), empty_text(F.col(f"`{text_col}`"))))


def restore(df: DataFrame, output_col: str, form_col: str, text_col: str = "text") -> DataFrame:
    """All other columns, and the texts from which the outputs were made."""
    has_columns(df, output_col, form_col)
    ship(df.sparkSession)
    small_batches(df.sparkSession)

    @F.pandas_udf("string")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([None if o is None or f is None else rebuilt(o, f) for o, f in zip(outputs, forms)], dtype=object)

    return df.withColumn(text_col, run(F.col(f"`{output_col}`"), F.col(f"`{form_col}`")))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """One row for each input row: id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    narrow = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = transform(narrow, "id", "text", seed)
    return out.select(F.col("id").alias(id_col), *[F.col(f"fim.{c}") for c in ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")])
