"""Data preparation: profiles, recipes learned from training rows, constant removal and dense encodings.

Everything is learned with a few aggregations over the training rows and applied as one projection, so Catalyst prunes,
fuses and pushes down as usual. Nothing of the evaluation rows is looked at except to find levels that weren't learned.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucidframe.contract import ContractError, predictor_kind
from lucidframe.functions.expr import col, is_missing, order_statistics, rate

# Names of identifier columns, numeric-like levels, and other names of the strategies.
ID_NAMES = (r"^id$", r"^id_", r"_id$", r"^identifier$", r"^row_?id$", r"^index$")
NUMERIC_LEVEL = r"^[+-]?[0-9]+(?:[.][0-9]+)?$"
STRATEGIES = {"keep": "keep", "drop_rows": "drop_rows", "drop_columns": "drop_columns", "impute": "impute", "remove_rows": "drop_rows", "remove_columns": "drop_columns"}
MAX_LEVELS = 10_000


def profile(df: DataFrame) -> DataFrame:
    """(position, column, kind, rows, missing, missing_rate) of every column in one pass."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(is_missing(df, c), 1)).alias(f"m{i}") for i, c in enumerate(df.columns)])
    items = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(k).alias("kind"), F.col("n").alias("rows"), F.col(f"m{i}").alias("missing")) for i, (c, k) in enumerate(df.dtypes)]
    return row.select(F.explode(F.array(*items)).alias("x")).select("x.*").withColumn("missing_rate", rate(F.col("missing"), F.col("rows")))


def id_columns(df: DataFrame, target: str) -> list[str]:
    return [c for c in df.columns if c != target and any(re.search(p, c.lower()) for p in ID_NAMES)]


def modes(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """The most frequent level of each column; of equals the first in level order."""
    if not columns:
        return {}
    items = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), col(c).cast("string").alias("x")) for i, c in enumerate(columns)]))
    counts = df.select(items.alias("v")).where("v.x IS NOT NULL").groupBy("v.i", "v.x").count()
    best = counts.groupBy("i").agg(F.min_by("x", F.struct(-F.col("count"), "x")).alias("x")).collect()  # partial sums, no sort of the levels
    found = {r["i"]: r["x"] for r in best}
    return {c: found.get(i) for i, c in enumerate(columns)}


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact medians (linear interpolation); missing values left out."""
    return {c: m[0] for c, m in order_statistics(df, {c: col(c) for c in columns}, (0.5,)).items()}


def levels_of(df: DataFrame, columns: list[str]) -> dict[str, tuple[str, ...]]:
    """Observed levels in byte order."""
    if not columns:
        return {}
    items = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), col(c).cast("string").alias("x")) for i, c in enumerate(columns)]))
    rows = df.select(items.alias("v")).where("v.x IS NOT NULL").distinct().select("v.i", "v.x").limit(MAX_LEVELS * len(columns) + 1).collect()
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in rows:
        out[columns[r["i"]]].append(r["x"])
    if any(len(x) > MAX_LEVELS for x in out.values()):
        raise ContractError(f"a categorical column has more than {MAX_LEVELS} levels")
    return {c: tuple(sorted(x, key=lambda s: s.encode())) for c, x in out.items()}


def constants(df: DataFrame, target: str) -> list[str]:
    """Predictors with fewer than two distinct values that aren't missing: equal least and greatest, in one pass."""
    names = [c for c in df.columns if c != target]
    if not names:
        return []
    shown = [F.when(~is_missing(df, c), col(c)) for c in names]
    row = df.agg(*[x for i, c in enumerate(shown) for x in (F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}"))]).first()
    return [c for i, c in enumerate(names) if row[f"a{i}"] is None or row[f"a{i}"] == row[f"b{i}"]]


def wholly_missing(df: DataFrame, target: str) -> list[str]:
    names = [c for c in df.columns if c != target]
    row = df.agg(*[F.count(F.when(~is_missing(df, c), 1)).alias(f"n{i}") for i, c in enumerate(names)]).first() if names else ()
    return [c for i, c in enumerate(names) if not row[i]]


def check_finite(df: DataFrame, target: str, allow_missing: bool = False) -> None:
    """Numeric predictors must be finite; nulls fail too unless allowed."""
    names = [c for c in df.columns if c != target and predictor_kind(df.schema[c].dataType) == "numeric"]
    if not names:
        return
    bad = [(F.abs(col(c).cast("double")) == float("inf")) if allow_missing else (is_missing(df, c) | (F.abs(col(c).cast("double")) == float("inf"))) for c in names]
    row = df.agg(*[F.count(F.when(b, 1)).alias(f"n{i}") for i, b in enumerate(bad)]).first()
    wrong = [c for i, c in enumerate(names) if row[i]]
    if wrong:
        raise ContractError(f"values that aren't finite in: {', '.join(wrong)}")


@dataclass(frozen=True)
class Recipe:
    """What training rows taught: applied to any rows as one projection."""

    target: str
    columns: tuple[str, ...]
    kinds: dict[str, str]
    removed_ids: tuple[str, ...] = ()
    removed_missing: tuple[str, ...] = ()
    removed_constant: tuple[str, ...] = ()
    missing: str = "keep"
    imputed: dict[str, float | str | None] = field(default_factory=dict)
    levels: dict[str, tuple[str, ...]] = field(default_factory=dict)
    ordered: dict[str, tuple[str, ...]] = field(default_factory=dict)
    numeric_like: tuple[str, ...] = ()
    novel: str = "error"
    fallback: dict[str, str | None] = field(default_factory=dict)

    def _value(self, name: str) -> Column:
        c, kind = col(name), self.kinds[name]
        if name == self.target:
            return c
        fill = self.imputed.get(name)
        if kind == "numeric":
            c = c.cast("double")
            return F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(fill)) if fill is not None else c
        text = c.cast("string")
        if fill is not None:
            text = F.coalesce(text, F.lit(fill))
        if name in self.ordered:
            return F.nullif(F.array_position(F.array(*[F.lit(x) for x in self.ordered[name]]), text), F.lit(0)).cast("double")
        if name in self.numeric_like:
            return text.try_cast("double")
        if kind == "logical" and name not in self.imputed:
            return c
        known = self.levels.get(name)
        if known is not None and self.novel == "mode":
            return F.when(text.isNull() | text.isin(*known), text).otherwise(F.lit(self.fallback.get(name)))
        return text

    def novel_counts(self, df: DataFrame) -> dict[str, int]:
        """Rows with a level that wasn't learned, by column."""
        names = [c for c in self.columns if c in self.levels and c != self.target and c not in self.ordered and c not in self.numeric_like]
        if not names:
            return {}
        row = df.agg(*[F.count(F.when(col(c).isNotNull() & ~col(c).cast("string").isin(*self.levels[c]), 1)).alias(f"n{i}") for i, c in enumerate(names)]).first()
        return {c: row[i] for i, c in enumerate(names) if row[i]}

    def apply(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """The learned columns, in learned order; `keep` names row identities to carry along."""
        absent = [c for c in self.columns if c not in df.columns]
        if absent:
            raise ContractError(f"missing columns: {', '.join(absent)}")
        if self.novel == "error" and (new := self.novel_counts(df)):
            raise ContractError(f"levels that training rows don't have in: {', '.join(new)}")
        if self.missing == "drop_rows":
            for c in self.columns:
                df = df.where(~is_missing(df, c))
        return df.select(*[col(k) for k in keep], *[self._value(c).alias(c) for c in self.columns])

    def without(self, names: list[str]) -> Recipe:
        return replace(self, columns=tuple(c for c in self.columns if c not in names), removed_constant=(*self.removed_constant, *names))


def learn_recipe(
    df: DataFrame, target: str, *, missing: str = "keep", threshold: float = 0.5, novel: str = "error", remove_ids: bool = False,
    ordered: dict[str, tuple[str, ...]] | None = None, numeric_like: bool = False, skip: tuple[str, ...] = (),
) -> Recipe:
    """Learn, in this order: identifiers, missing values, levels, ordered and numeric-like columns."""
    if missing not in STRATEGIES or novel not in ("error", "mode"):
        raise ContractError("unknown strategy")
    missing = STRATEGIES[missing]
    df = df.drop(*skip)
    ids = id_columns(df, target) if remove_ids else []
    df = df.drop(*ids)
    rates = {r["column"]: (r["missing"], r["missing_rate"] or 0.0) for r in profile(df).collect()}
    gone = [c for c in df.columns if c != target and rates[c][1] > threshold] if missing == "drop_columns" else []
    df = df.drop(*gone)
    if missing == "drop_rows":
        for c in df.columns:
            df = df.where(~is_missing(df, c))
    kinds = {f.name: predictor_kind(f.dataType) for f in df.schema}
    ordered = {c: tuple(x) for c, x in (ordered or {}).items() if c in df.columns}
    holes = [c for c in df.columns if c != target and rates[c][0] and missing == "impute"]
    numbers = [c for c in holes if kinds[c] == "numeric"]
    imputed: dict = medians(df, numbers) | modes(df, [c for c in holes if kinds[c] in ("categorical", "logical")])
    # An imputed boolean turns categorical, as its most frequent value is a string.
    text = [c for c in df.columns if c != target and (kinds[c] == "categorical" or c in imputed and kinds[c] == "logical")]
    levels = levels_of(df, text)
    like = tuple(c for c in text if numeric_like and c not in ordered and levels[c] and all(re.match(NUMERIC_LEVEL, x) for x in levels[c]))
    return Recipe(target, tuple(df.columns), kinds, tuple(ids), tuple(gone), (), missing, imputed, levels, ordered, like, novel, modes(df, text))


def prepare(df: DataFrame, target: str, **options) -> tuple[DataFrame, Recipe]:
    """Learn a recipe and apply it to the same rows."""
    recipe = learn_recipe(df, target, **options)
    return recipe.apply(df), recipe


#: The same rules serve an outside engine: nothing is prepared differently for it.
prepare_for_engine = prepare


@dataclass(frozen=True)
class Encoding:
    """A dense numeric encoding: names, expressions' parts, centres and scales."""

    features: tuple[str, ...]
    kinds: dict[str, str]
    levels: dict[str, tuple[str, ...]]
    contrast: str
    centre: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.columns()]

    def columns(self) -> list[tuple[str, Column]]:
        out: list[tuple[str, Column]] = []
        for f in self.features:
            if self.kinds[f] == "categorical":
                shown = self.levels[f] if self.contrast == "one_hot" else self.levels[f][1:]
                out += [(f"{f}={x}", (col(f).cast("string") == x).cast("double")) for x in shown]
            else:
                raw = col(f).cast("double")
                out.append((f, (raw - self.centre[f]) / self.scale[f] if f in self.centre else raw))
        return out

    def check_types(self, df: DataFrame) -> None:
        """Columns that are there and of the kinds learned, from the schema alone."""
        absent = [f for f in self.features if f not in df.columns]
        if absent:
            raise ContractError(f"missing columns: {', '.join(absent)}")
        for f in self.features:
            kind = predictor_kind(df.schema[f].dataType)
            if kind != self.kinds[f]:
                raise ContractError(f"{f} was {self.kinds[f]} and is {kind}")

    def guard(self, df: DataFrame) -> DataFrame:
        """The rows, of which reading a level that wasn't learned fails the query: no pass of its own is needed."""
        self.check_types(df)
        for f in self.features:
            if self.kinds[f] == "categorical":
                new = col(f).isNotNull() & ~col(f).cast("string").isin(*self.levels[f])
                df = df.withColumn(f, F.when(new, F.raise_error(F.lit(f"levels that weren't learned in: {f}")).cast(df.schema[f].dataType)).otherwise(col(f)))
        return df

    def check(self, df: DataFrame) -> None:
        self.check_types(df)
        names = [f for f in self.features if self.kinds[f] == "categorical"]
        if names:
            row = df.agg(*[F.count(F.when(col(f).isNotNull() & ~col(f).cast("string").isin(*self.levels[f]), 1)).alias(f"n{i}") for i, f in enumerate(names)]).first()
            new = [f for i, f in enumerate(names) if row[i]]
            if new:
                raise ContractError(f"levels that weren't learned in: {', '.join(new)}")

    def transform(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        return df.select(*[col(k) for k in keep], *[c.alias(n) for n, c in self.columns()])

    def assemble(self, df: DataFrame, output: str = "features") -> DataFrame:
        """All columns and one vector column."""
        parts = [f"__x{i}" for i in range(len(self.names))]
        wide = self.guard(df).withColumns({p: c for p, (_, c) in zip(parts, self.columns())})
        return VectorAssembler(inputCols=parts, outputCol=output, handleInvalid="error").transform(wide).drop(*parts)

    def array(self) -> Column:
        return F.array(*[c for _, c in self.columns()]) if self.features else F.array().cast("array<double>")


def learn_encoding(df: DataFrame, features: list[str], contrast: str = "treatment", standardize: bool = False) -> Encoding:
    """Levels of strings, and for numbers the mean and deviation if asked for. A deviation of zero counts as one."""
    if contrast not in ("treatment", "one_hot"):
        raise ContractError("contrast must be treatment or one_hot")
    kinds = {f: predictor_kind(df.schema[f].dataType) for f in features}
    wrong = [f for f in features if kinds[f] == "unsupported"]
    if wrong:
        raise ContractError(f"types that can't be encoded: {', '.join(wrong)}")
    numbers = [f for f in features if kinds[f] == "numeric"] if standardize else []
    centre, scale = {}, {}
    if numbers:
        row = df.agg(*[x for i, f in enumerate(numbers) for x in (F.avg(col(f).cast("double")).alias(f"a{i}"), F.stddev_samp(col(f).cast("double")).alias(f"s{i}"))]).first()
        for i, f in enumerate(numbers):
            centre[f], scale[f] = row[f"a{i}"] or 0.0, row[f"s{i}"] or 1.0
    return Encoding(tuple(features), kinds, levels_of(df, [f for f in features if kinds[f] == "categorical"]), contrast, centre, scale)
