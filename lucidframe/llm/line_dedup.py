"""Repeated runs of lines, found by winnowing and deleted where they come again.

A text is a sequence of lines; blank lines are kept and stand outside the sequence. A run of `RUN` equal lines that came
earlier in the table (in a smaller id, or higher up in the same text) is deleted; so is a shorter run of more than `WORDS` words
or `LETTERS` characters, such as a passage in one line. With long=False only runs of `RUN` lines are.

1. Every line gets a fingerprint. In each window of `RUN` lines the least fingerprint is selected (the rightmost of
   equals); any common run of `RUN` lines or more shares a selected fingerprint at the same place of the run. Texts
   of fewer lines have no such window. Long runs of fewer lines are windows of their own, all of them looked up (3).
2. Places are joined by their selected fingerprint, by counting it with map-side sums: one that stands in a single place
   starts no match.
3. Around each shared place every window that contains it is a possible match, and the windows on both sides extend it line
   by line in both ways: a window's fingerprint finds its first place in the table, again by map-side partial sums, so that
   a line or passage that a third of the table shares never meets in one task and no pairs are made.
4. Later windows are deleted. Where a run overlaps its own first place, only what lies behind that is.

Lines and windows are told apart by 128 bits. All steps take time in proportion to a text's lines, however many it has.

Defined results: a null text counts as empty and stays as it is; lines are equal if they are after trimming white space at
their ends; of repeated ids one row (which is unspecified) comes first, and equal rows lose their repeated runs like other
copies, all but one of them; a null id comes after all others; an empty table gives an empty result. `mark_lines` reads only the
id and text columns; `drop_lines` returns all columns, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucidframe.llm.common import WORD, bounded_broadcast, empty_text, has_columns, looked_up, materialize, numbered, unused

#: Lines of a run, and of the window from which a fingerprint is selected.
RUN = 3
#: A run of fewer lines counts if it has more words, or more characters that aren't white space, than these.
WORDS, LETTERS = 50, 300
BLANK = r"^\s*$"


def _lines(text: Column) -> Column:
    return F.split(empty_text(text), "\n", -1)


def _filled(text: Column, count_words: bool) -> Column:
    """(place, print, check, n) of the lines that aren't blank, and their words if asked for, as an array of structs: place is the line's index."""
    def line(x: Column, i: Column) -> Column:
        trimmed = F.regexp_replace(x, r"^\s+|\s+$", "")
        words = [F.regexp_count(x, F.lit(WORD)).alias("words")] if count_words else []
        return F.struct(i.alias("place"), F.xxhash64(trimmed).alias("print"), F.xxhash64(F.lit(1), trimmed).alias("check"), F.length(F.regexp_replace(x, r"\s+", "")).alias("n"), *words)

    return F.filter(F.transform(_lines(text), line), lambda x: x["n"] > 0)


def _windows(rows: DataFrame, starts: Column, run: int) -> DataFrame:
    """(row, none, id, start, window, twin): the windows of `run` lines at some starts, by 128 bits. The arrays are not carried along."""
    window = lambda i: F.struct(i.alias("start"), *[F.xxhash64(F.slice(c, i + 1, run)).alias(name) for c, name in (("prints", "window"), ("checks", "twin"))])
    return rows.select("row", "none", "id", F.explode(F.transform(starts, window)).alias("x")).select("row", "none", "id", "x.*")


def _later(windows: DataFrame, run: int) -> DataFrame:
    """(row, begin, end) of the windows of (row, none, id, start, window, twin) that came earlier."""
    windows = materialize(windows, "windows")
    firsts = windows.groupBy("window", "twin").agg(F.min(F.struct("none", "id", "row", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = materialize(firsts.select("window", "twin", "n", F.col("first.row").alias("first_row"), F.col("first.start").alias("first_start")), "first-windows")
    later = looked_up(windows, firsts, ["window", "twin"], "n", "inner").where("NOT (row = first_row AND start = first_start)")
    begin = F.when(F.col("row") == F.col("first_row"), F.greatest("start", F.col("first_start") + run)).otherwise(F.col("start"))
    return later.select("row", begin.alias("begin"), (F.col("start") + run).alias("end")).where("begin < end")


def long_windows(rows: DataFrame, run: int) -> DataFrame:
    """(row, begin, end) of later windows of `run` lines that are long in words or letters: arrays beside prints."""
    def total(sizes: str, i: Column) -> Column:
        return sum((F.get(sizes, i + k) for k in range(run)), F.lit(0))

    starts = F.filter(F.sequence(F.lit(0), F.size("prints") - run), lambda i: (total("words", i) > WORDS) | (total("letters", i) > LETTERS))
    return _later(_windows(rows.where(F.size("prints") >= run), starts, run), run)


def repeated_windows(rows: DataFrame, run: int = RUN) -> DataFrame:
    """(row, begin, end) for (row, none, id, prints, checks) rows: where in each text a window begins that came earlier, and from which line on it goes.

    row: a number of the row, unique; none, id: what orders rows; prints, checks: the fingerprints of its filled lines.
    """
    usable = rows.where(F.size("prints") >= run)
    # Winnowing: of each window the place of the least fingerprint, the rightmost of equals.
    picked = F.array_distinct(
        F.transform(
            F.sequence(F.lit(0), F.size("prints") - run),
            lambda i: -F.array_min(F.transform(F.sequence(F.lit(0), F.lit(run - 1)), lambda k: F.struct(F.get("prints", i + k).alias("print"), (-(i + k)).alias("back"))))["back"],
        )
    )
    places = usable.select("row", F.explode(F.transform(picked, lambda p: F.struct(F.get("prints", p).alias("print"), F.get("checks", p).alias("check"), p.alias("place")))).alias("x")).select("row", "x.*")
    shared = places.groupBy("print", "check").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hits = looked_up(places, materialize(shared, "shared-lines"), ["print", "check"], "n", "inner").groupBy("row").agg(F.collect_list("place").alias("hits"))
    found = usable.join(hits, "row")
    # Windows that contain a shared place: they extend a match to both sides.
    near = F.array_distinct(F.flatten(F.transform("hits", lambda p: F.sequence(F.greatest(F.lit(0), p - (run - 1)), F.least(p, F.size("prints") - run)))))
    return _later(_windows(found, near, run), run)


def _marked(df: DataFrame, number: str, id_col: str, text_col: str, run: int, long: bool) -> DataFrame:
    """(row, gone: indexes of deleted lines) for the rows that lose lines."""
    ids = F.col(f"`{id_col}`")
    rows = df.select(F.col(f"`{number}`").alias("row"), ids.isNull().alias("none"), ids.alias("id"), _filled(F.col(f"`{text_col}`"), long).alias("filled"))
    of = lambda name: F.transform("filled", lambda x: x[name])
    sizes = [of("words").alias("words"), of("n").alias("letters")] if long else []
    rows = materialize(rows.select("row", "none", "id", of("print").alias("prints"), of("check").alias("checks"), of("place").alias("places"), *sizes), "lines")
    later = repeated_windows(rows, run)
    for fewer in range(1, run) if long else ():
        later = later.unionByName(long_windows(rows, fewer))
    spans = later.groupBy("row").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["begin"], s["end"] - 1))))
    gone = rows.select("row", "places").join(spans, "row").select("row", "places", F.explode(F.array(covered)).alias("covered"))  # a column, worked out once
    return materialize(gone.select("row", F.transform("covered", lambda i: F.get("places", i)).alias("gone")), "repeated")


def _cleaned(df: DataFrame, number: str, id_col: str, text_col: str, run: int, long: bool) -> tuple[DataFrame, str, str]:
    """All rows with two columns more, whose names are returned: the indexes of the lines that go (null if none does), and the text without them."""
    row, gone, lines = (unused(df, f"__lf_{n}") for n in ("of", "gone", "lines"))
    marked = bounded_broadcast(_marked(df, number, id_col, text_col, run, long)).toDF(row, gone)
    text = F.col(f"`{text_col}`")
    joined = df.join(marked, F.col(f"`{number}`") == F.col(row), "left")
    # A column made by explode is worked out once a row, not once for each line that asks for it.
    joined = joined.select(*[F.col(f"`{c}`") for c in df.columns], gone, F.explode(F.array(F.when(F.col(gone).isNotNull(), _lines(text)))).alias(lines))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.get(F.col(lines), i))
    return joined.withColumn(lines, F.when(F.col(gone).isNull(), text).otherwise(F.array_join(kept, "\n"))), gone, lines


def mark_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, long: bool = True) -> DataFrame:
    """One row for each input row: id, n_lines (filled ones), n_removed, clean_sha256, clean_chars."""
    has_columns(df, id_col, text_col)
    df, number = numbered(df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias(text_col)), id_col)
    rows, gone, clean = _cleaned(df, number, id_col, text_col, run, long)
    clean = empty_text(F.col(clean))
    filled = F.size(F.filter(_lines(F.col(f"`{text_col}`")), lambda x: F.length(F.regexp_replace(x, r"\s+", "")) > 0))
    return rows.select(F.col(f"`{id_col}`"), filled.cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"), F.sha2(clean, 256).alias("clean_sha256"), F.length(clean).cast("long").alias("clean_chars"))


def drop_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, long: bool = True) -> DataFrame:
    """All rows and columns, the text without its later repeated runs."""
    has_columns(df, id_col, text_col)
    columns = df.columns
    df, number = numbered(df, id_col)
    rows, _, clean = _cleaned(df, number, id_col, text_col, run, long)
    return rows.select(*[(F.col(clean).alias(c) if c == text_col else F.col(f"`{c}`")) for c in columns])
