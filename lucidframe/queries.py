"""The engine's registered queries and their SQL, over whole tables.

Scores are fixed expressions, so that any engine can replay them; doubles are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lucidframe.contract import BINARY, MULTICLASS, REGRESSION, Task, detect_kind
from lucidframe.functions.expr import col, hash_key, rounded, row_sums
from lucidframe.functions.stats import t_quantile
from lucidframe.models import fit, forest, grams, neural, registry, trees, tuning
from lucidframe.operators import compare, diagnostics, explain, metrics, prep, selection, split
from lucidframe.plans import workflow
from lucidframe.shipping import ship
from lucidframe.sources.tables import dataset

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = lambda spark, folder: rounded(f(spark, folder))
        if sql:
            ORACLES[name] = sql.strip()
        return f

    return register


# Frames with a row identity, an outcome and features

REG = Task(REGRESSION, "y")
TOXIC = Task(BINARY, "toxic", ("0", "1"), "1")
FLAG = Task(MULTICLASS, "l_returnflag", ("A", "N", "R"))

LINE_ID = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as bigint), cast(round(l_extendedprice * 100) as bigint))"
LINES_SQL = f"""lines AS (SELECT {LINE_ID} AS row_id, l_extendedprice / 1000.0 AS y, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem)"""
DOCS_SQL = """docs AS (SELECT d.doc_id AS row_id, l.toxic AS y, d.n_chars, d.lang, d.source, 1.0 / (1.0 + exp(-(-2.0 + d.n_chars / 5000.0 - CASE WHEN d.lang = 'en' THEN 0.5 ELSE 0.0 END))) AS score
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def lines(spark: SparkSession, folder: str) -> DataFrame:
    t = dataset(spark, folder, "lineitem")
    return t.select(F.expr(LINE_ID).alias("row_id"), (F.col("l_extendedprice") / 1000.0).alias("y"), "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def price(c: Callable[[str], Column]) -> Column:
    return c("l_quantity") * 1.5 - c("l_discount") * 20.0 + c("l_tax") * 10.0 + F.when(c("l_returnflag") == "N", 0.5).otherwise(0.0)


PRICE = "l_quantity * 1.5 - l_discount * 20.0 + l_tax * 10.0 + CASE WHEN l_returnflag = 'N' THEN 0.5 ELSE 0.0 END"
price_scorer = explain.expression_scorer(price)


def scored_docs(spark: SparkSession, folder: str) -> DataFrame:
    d, l = dataset(spark, folder, "documents"), dataset(spark, folder, "labels")
    z = F.lit(-2.0) + F.col("n_chars") / 5000.0 - F.when(F.col("lang") == "en", 0.5).otherwise(0.0)
    rows = d.select("doc_id", "n_chars", "lang", "source").join(l, "doc_id")
    return rows.select(F.col("doc_id").alias("row_id"), F.col("toxic").alias("y"), "n_chars", "lang", "source", (1.0 / (1.0 + F.exp(-z))).alias("score"))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    return dataset(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars").join(dataset(spark, folder, "labels"), "doc_id", "left")


LABELLED_SQL = "labelled AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
#: The half of a table whose shuffle key starts with a digit below eight.
EARLY = "substr(md5('7|half|' || {}), 1, 1) < '8'"


def early(key: str) -> Column:
    return F.substring(hash_key(7, "half", F.col(key)), 1, 1) < "8"


# Preparation


@query("profile_missing", f"""
WITH {LABELLED_SQL}, n AS (SELECT count(*) AS rows, {', '.join(f"count(*) - count({c}) AS {c}" for c in ('doc_id', 'lang', 'source', 'n_chars', 'quality', 'toxic'))} FROM labelled)
""" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", rows, {c} AS missing, round({c} / rows::DOUBLE, 6) AS missing_rate FROM n" for c in ("doc_id", "lang", "source", "n_chars", "quality", "toxic")))
def profile_missing(spark, folder):
    return prep.profile(labelled(spark, folder)).select("column", "rows", "missing", "missing_rate")


@query("missingness_shift", f"""
WITH {LABELLED_SQL}, t AS (SELECT * FROM labelled WHERE lang <> 'es' OR quality IS NOT NULL AND {EARLY.format('doc_id')}), e AS (SELECT * FROM labelled WHERE NOT ({EARLY.format('doc_id')}))
""" + " UNION ALL ".join(f"""SELECT '{c}' AS "column", a AS training_missing, round(a / n::DOUBLE, 6) AS training_rate, b AS evaluation_missing, round(b / m::DOUBLE, 6) AS evaluation_rate, round(b / m::DOUBLE - a / n::DOUBLE, 6) AS shift,
  abs(round(b / m::DOUBLE - a / n::DOUBLE, 12)) >= 0.05 AS flagged, true AS used
FROM (SELECT count(*) AS n, count(*) - count({c}) AS a FROM t), (SELECT count(*) AS m, count(*) - count({c}) AS b FROM e)""" for c in ("doc_id", "lang", "source", "n_chars", "quality")))
def missingness_shift(spark, folder):
    rows = labelled(spark, folder)
    training = rows.where((F.col("lang") != "es") | F.col("quality").isNotNull() & early("doc_id"))
    return diagnostics.missingness_shift(training, rows.where(~early("doc_id")), "toxic")


@query("detect_task", """
WITH c(name, kind, n) AS (
  SELECT 'labels.toxic', 'number', count(DISTINCT toxic) FROM labels UNION ALL SELECT 'lineitem.l_returnflag', 'text', count(DISTINCT l_returnflag) FROM lineitem
  UNION ALL SELECT 'lineitem.l_linestatus', 'text', count(DISTINCT l_linestatus) FROM lineitem UNION ALL SELECT 'lineitem.l_quantity', 'number', count(DISTINCT l_quantity) FROM lineitem)
SELECT name, CASE WHEN n = 2 THEN 'binary' WHEN kind = 'number' THEN 'regression' ELSE 'multiclass' END AS task FROM c""")
def detect_task(spark, folder):
    found = [(f"{t}.{c}", detect_kind(dataset(spark, folder, t), c)) for t, c in (("labels", "toxic"), ("lineitem", "l_returnflag"), ("lineitem", "l_linestatus"), ("lineitem", "l_quantity"))]
    return spark.createDataFrame(found, "name string, task string")


@query("holdout_regression", """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('123|split|' || o_orderkey)) AS i, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, i <= greatest(2, least(n - 2, round_even(n * 0.2, 0))) AS held_out FROM r""")
def holdout_regression(spark, folder):
    return split.holdout(dataset(spark, folder, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", "held_out")


@query("holdout_stratified", """
WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5('123|split|' || doc_id)) AS i, count(*) OVER (PARTITION BY toxic) AS n FROM labels)
SELECT doc_id, toxic, i <= greatest(1, least(n - 1, round_even(n * 0.2, 0))) AS held_out FROM r""")
def holdout_stratified(spark, folder):
    return split.holdout(dataset(spark, folder, "labels").select("doc_id", "toxic"), "doc_id", stratum="toxic").select("doc_id", "toxic", "held_out")


@query("vfold_assign", """
SELECT doc_id, toxic, CAST((row_number() OVER (PARTITION BY toxic ORDER BY md5('123|fold|' || doc_id)) - 1) % 5 + 1 AS INT) AS fold FROM labels""")
def vfold_assign(spark, folder):
    return split.folds(dataset(spark, folder, "labels").select("doc_id", "toxic"), "doc_id", 5, stratum="toxic").select("doc_id", "toxic", "fold")


@query("overlap_check", f"""
WITH x AS (SELECT {EARLY.format('l_orderkey')} AS training, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem),
  t AS (SELECT DISTINCT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM x WHERE training)
SELECT (SELECT count(*) FROM x WHERE NOT training) AS evaluation_rows, count(*) AS overlapping
FROM x WHERE NOT training AND EXISTS (SELECT 1 FROM t WHERE t.l_quantity = x.l_quantity AND t.l_discount = x.l_discount AND t.l_tax = x.l_tax AND t.l_returnflag = x.l_returnflag AND t.l_linestatus = x.l_linestatus)""")
def overlap_check(spark, folder):
    t = dataset(spark, folder, "lineitem")
    names = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    evaluation = t.where(~early("l_orderkey")).select(*names)
    found = split.overlap(t.where(early("l_orderkey")).select(*names), evaluation).agg(F.count(F.lit(1)).alias("overlapping"))
    return evaluation.agg(F.count(F.lit(1)).alias("evaluation_rows")).crossJoin(found)


@query("impute_apply", f"""
WITH {LABELLED_SQL}, t AS (SELECT * FROM labelled WHERE {EARLY.format('doc_id')})
SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars, coalesce(CAST(quality AS DOUBLE), (SELECT quantile_cont(quality, 0.5) FROM t)) AS quality, lang, toxic FROM labelled WHERE NOT ({EARLY.format('doc_id')})""")
def impute_apply(spark, folder):
    rows = labelled(spark, folder).select("doc_id", "n_chars", "quality", "lang", "toxic")
    recipe = prep.learn_recipe(rows.where(early("doc_id")), "toxic", missing="impute", novel="mode", skip=("doc_id",))
    return recipe.apply(rows.where(~early("doc_id")), keep=("doc_id",))


@query("novel_level_map", """
WITH t AS (SELECT * FROM customer WHERE c_mktsegment <> 'MACHINERY'), m AS (SELECT c_mktsegment FROM t GROUP BY 1 ORDER BY count(*) DESC, c_mktsegment LIMIT 1)
SELECT c_custkey, CASE WHEN c_mktsegment IN (SELECT c_mktsegment FROM t) THEN c_mktsegment ELSE (SELECT c_mktsegment FROM m) END AS c_mktsegment, c_acctbal FROM customer""")
def novel_level_map(spark, folder):
    rows = dataset(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    recipe = prep.learn_recipe(rows.where("c_mktsegment <> 'MACHINERY'"), "c_acctbal", novel="mode", skip=("c_custkey",))
    return recipe.apply(rows, keep=("c_custkey",))


@query("constant_drop", """
WITH c(name, n) AS (SELECT 'p_size', count(DISTINCT p_size) FROM part UNION ALL SELECT 'p_brand', count(DISTINCT p_brand) FROM part UNION ALL SELECT 'currency', 1 UNION ALL SELECT 'empty', 0)
SELECT name, n < 2 AS removed FROM c""")
def constant_drop(spark, folder):
    rows = dataset(spark, folder, "part").select("p_retailprice", "p_size", "p_brand", F.lit("USD").alias("currency"), F.lit(None).cast("double").alias("empty"))
    gone = prep.constants(rows, "p_retailprice")
    return spark.createDataFrame([(c, c in gone) for c in rows.columns if c != "p_retailprice"], "name string, removed boolean")


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("one_hot_encode", "SELECT c_custkey, c_acctbal, " + ", ".join(f"CAST(c_mktsegment = '{s}' AS DOUBLE) AS \"c_mktsegment={s}\"" for s in SEGMENTS) + " FROM customer")
def one_hot_encode(spark, folder):
    rows = dataset(spark, folder, "customer")
    return prep.learn_encoding(rows, ["c_acctbal", "c_mktsegment"], "one_hot").transform(rows, keep=("c_custkey",))


@query("standardize", """
WITH s AS (SELECT avg(p_size) AS a, stddev_samp(p_size) AS b, avg(p_retailprice) AS c, stddev_samp(p_retailprice) AS d FROM part)
SELECT p_partkey, round((p_size - a) / b, 6) AS p_size, round((p_retailprice - c) / d, 6) AS p_retailprice FROM part, s""")
def standardize(spark, folder):
    rows = dataset(spark, folder, "part")
    return prep.learn_encoding(rows, ["p_size", "p_retailprice"], standardize=True).transform(rows, keep=("p_partkey",))


# Metrics and diagnostics


@query("metrics_regression", f"""
WITH {LINES_SQL}, s AS (SELECT y, {PRICE} AS p FROM lines)
SELECT count(*) AS n, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae, round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(y)), 6) AS r_squared FROM s""")
def metrics_regression(spark, folder):
    return metrics.evaluate(price_scorer(lines(spark, folder)), REG)


CLAMPED = "least(greatest(score, 1e-15), 1 - 1e-15)"
AUC_SQL = "(sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y))"


@query("metrics_binary", f"""
WITH {DOCS_SQL}, s AS (SELECT y, {CLAMPED} AS p, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM docs)
SELECT count(*) AS n, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier_score, round(avg(CAST((p >= 0.5) = (y = 1) AS DOUBLE)), 6) AS accuracy,
  round((avg(CAST(p >= 0.5 AS DOUBLE)) FILTER (y = 1) + avg(CAST(p < 0.5 AS DOUBLE)) FILTER (y = 0)) / 2, 6) AS balanced_accuracy, round({AUC_SQL}, 6) AS roc_auc FROM s""")
def metrics_binary(spark, folder):
    return metrics.evaluate(scored_docs(spark, folder), TOXIC)


@query("auc", f"""
WITH {DOCS_SQL}, s AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM docs)
SELECT CAST(sum(y) AS BIGINT) AS positives, CAST(sum(1 - y) AS BIGINT) AS negatives, round({AUC_SQL}, 6) AS roc_auc FROM s""")
def auc(spark, folder):
    return metrics.auc(scored_docs(spark, folder), "y", "score")


LOGITS = {"A": "0.02 * l_quantity", "N": "1.0 + l_discount", "R": "0.8 - l_tax * 5.0"}
SOFTMAX_SQL = f"""e AS (SELECT *, exp({LOGITS['A']}) AS ea, exp({LOGITS['N']}) AS en, exp({LOGITS['R']}) AS er FROM lines),
  s AS (SELECT *, ea / (ea + en + er) AS pa, en / (ea + en + er) AS pn, er / (ea + en + er) AS pr FROM e),
  m AS (SELECT *, CASE WHEN pa >= pn AND pa >= pr THEN 'A' WHEN pn >= pr THEN 'N' ELSE 'R' END AS said, CASE l_returnflag WHEN 'A' THEN pa WHEN 'N' THEN pn ELSE pr END AS own FROM s)"""


def softmax(df: DataFrame, shift: float = 0.0, name: str = "score") -> DataFrame:
    powers = [F.exp(F.expr(x) + (shift if k == "R" else 0.0)) for k, x in LOGITS.items()]
    total = powers[0] + powers[1] + powers[2]
    return df.withColumn(name, F.array(*[p / total for p in powers]))


def flags(spark, folder) -> DataFrame:
    return softmax(lines(spark, folder)).withColumn("y", F.array_position(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("l_returnflag")).cast("int") - 1)


@query("metrics_multiclass", f"""
WITH {LINES_SQL}, {SOFTMAX_SQL}
SELECT count(*) AS n, round(avg(-ln(least(greatest(own, 1e-15), 1 - 1e-15))), 6) AS log_loss, round(avg(pa * pa + pn * pn + pr * pr - own * own + (own - 1) * (own - 1)), 6) AS brier_score,
  round(avg(CAST(said = l_returnflag AS DOUBLE)), 6) AS accuracy,
  round((avg(CAST(said = 'A' AS DOUBLE)) FILTER (l_returnflag = 'A') + avg(CAST(said = 'N' AS DOUBLE)) FILTER (l_returnflag = 'N') + avg(CAST(said = 'R' AS DOUBLE)) FILTER (l_returnflag = 'R')) / 3, 6) AS macro_recall FROM m""")
def metrics_multiclass(spark, folder):
    return metrics.evaluate(flags(spark, folder), FLAG)


@query("confusion", f"""
WITH {LINES_SQL}, {SOFTMAX_SQL}, o AS (SELECT DISTINCT l_returnflag AS observed FROM m), p AS (SELECT DISTINCT said AS predicted FROM m)
SELECT observed, predicted, (SELECT count(*) FROM m WHERE l_returnflag = observed AND said = predicted) AS n FROM o, p""")
def confusion(spark, folder):
    return metrics.confusion(metrics.prediction_table(flags(spark, folder), FLAG), "observed", "predicted")


@query("error_summary", f"""
WITH {LINES_SQL}, s AS (SELECT {PRICE} - y AS e FROM lines)
SELECT round(avg(e), 6) AS mean_error, round(quantile_cont(abs(e), 0.5), 6) AS median_absolute_error, round(quantile_cont(abs(e), 0.9), 6) AS p90_absolute_error FROM s""")
def error_summary(spark, folder):
    return metrics.error_summary(price_scorer(lines(spark, folder)), "y", "score")


@query("calibration", f"""
WITH {DOCS_SQL}, r AS (SELECT y, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r, count(*) OVER () AS n FROM docs),
  g AS (SELECT y, score, least(5, ceil(r / n * 5)) AS g FROM r), d AS (SELECT y, score, dense_rank() OVER (ORDER BY g) AS "group" FROM g)
SELECT "group", count(*) AS n, round(avg(score), 6) AS mean_probability, round(avg(y), 6) AS observed_rate, round(abs(avg(score) - avg(y)), 6) AS gap FROM d GROUP BY "group\"""")
def calibration(spark, folder):
    return diagnostics.calibration(scored_docs(spark, folder), TOXIC)


@query("thresholds", f"""
WITH {DOCS_SQL}, t AS (SELECT unnest([{', '.join(map(str, diagnostics.THRESHOLDS))}])::DOUBLE AS threshold),
  c AS (SELECT threshold, count(*) FILTER (score >= threshold AND y = 1) AS tp, count(*) FILTER (score >= threshold AND y = 0) AS fp, count(*) FILTER (score < threshold AND y = 0) AS tn, count(*) FILTER (score < threshold AND y = 1) AS fn FROM docs, t GROUP BY threshold),
  m AS (SELECT *, tp / nullif(tp + fn, 0)::DOUBLE AS se, tn / nullif(tn + fp, 0)::DOUBLE AS sp, tp / nullif(tp + fp, 0)::DOUBLE AS pr, (fp * 1.0 + fn * 2.0)::DOUBLE / (tp + fp + tn + fn) AS cost FROM c)
SELECT threshold, tp, fp, tn, fn, round(se, 6) AS sensitivity, round(sp, 6) AS specificity, round(pr, 6) AS precision, round(tn / nullif(tn + fn, 0)::DOUBLE, 6) AS negative_predictive_value,
  round((tp + tn)::DOUBLE / (tp + fp + tn + fn), 6) AS accuracy, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE END, 6) AS f1, round(cost, 6) AS cost,
  round((se + sp) / 2, 6) AS balanced_accuracy, cost = min(cost) OVER () AS minimum_cost FROM m""")
def thresholds(spark, folder):
    return diagnostics.thresholds(scored_docs(spark, folder), false_negative_cost=2.0)


@query("subgroups", f"""
WITH {LINES_SQL}, s AS (SELECT coalesce(l_returnflag, '(missing)') AS "group", y, {PRICE} AS p FROM lines),
  g AS (SELECT "group", count(*) AS n, sqrt(avg((p - y) * (p - y))) AS rmse, avg(abs(p - y)) AS mae, 1 - sum((p - y) * (p - y)) / (var_pop(y) * count(y)) AS r_squared FROM s GROUP BY "group")
SELECT "group", n, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(r_squared, 6) AS r_squared, round(n / sum(n) OVER ()::DOUBLE, 6) AS share, n >= 10 AS enough_rows, round(abs(rmse - min(rmse) FILTER (n >= 10) OVER ()), 6) AS gap FROM g""")
def subgroups(spark, folder):
    return diagnostics.subgroups(price_scorer(lines(spark, folder)), REG, "l_returnflag")


@query("subgroups_binary", f"""
WITH {DOCS_SQL}, s AS (SELECT lang AS "group", y, {CLAMPED} AS p, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS r FROM docs),
  g AS (SELECT "group", count(*) AS n, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS log_loss, avg((p - y) * (p - y)) AS brier_score, avg(CAST((p >= 0.5) = (y = 1) AS DOUBLE)) AS accuracy,
    (avg(CAST(p >= 0.5 AS DOUBLE)) FILTER (y = 1) + avg(CAST(p < 0.5 AS DOUBLE)) FILTER (y = 0)) / 2 AS balanced_accuracy, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0) AS roc_auc FROM s GROUP BY "group")
SELECT "group", n, round(log_loss, 6) AS log_loss, round(brier_score, 6) AS brier_score, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy, round(roc_auc, 6) AS roc_auc,
  round(n / sum(n) OVER ()::DOUBLE, 6) AS share, n >= 10 AS enough_rows, round(abs(log_loss - min(log_loss) FILTER (n >= 10) OVER ()), 6) AS gap FROM g""")
def subgroups_binary(spark, folder):
    return diagnostics.subgroups(scored_docs(spark, folder), TOXIC, "lang")


# Several models


def three_prices(spark, folder) -> DataFrame:
    rows = lines(spark, folder)
    return rows.withColumns({"m1": price(col), "m2": F.col("l_quantity") * 1.4567 + 2.0123, "m3": F.col("l_quantity") * 1.5123 - F.col("l_discount") * 40.12})


THREE_SQL = f"three AS (SELECT *, {PRICE} AS m1, l_quantity * 1.4567 + 2.0123 AS m2, l_quantity * 1.5123 - l_discount * 40.12 AS m3 FROM lines)"


@query("ambiguity_regression", f"""
WITH {LINES_SQL}, {THREE_SQL}
SELECT row_id, round(least(m1, m2, m3), 6) AS minimum, round(greatest(m1, m2, m3), 6) AS maximum, round(greatest(m1, m2, m3) - least(m1, m2, m3), 6) AS range, round(list_stddev_samp([m1, m2, m3]), 6) AS sd FROM three""")
def ambiguity_regression(spark, folder):
    return diagnostics.regression_ambiguity(three_prices(spark, folder), ["m1", "m2", "m3"])


@query("ambiguity_class", f"""
WITH {LINES_SQL}, {SOFTMAX_SQL}, b AS (SELECT *, exp({LOGITS['R']} + 0.6) AS er2 FROM m),
  c AS (SELECT *, ea / (ea + en + er2) AS qa, en / (ea + en + er2) AS qn, er2 / (ea + en + er2) AS qr FROM b),
  d AS (SELECT *, CASE WHEN qa >= qn AND qa >= qr THEN 'A' WHEN qn >= qr THEN 'N' ELSE 'R' END AS said2 FROM c)
SELECT row_id, CASE WHEN said = said2 THEN said ELSE least(said, said2) || ', ' || greatest(said, said2) END AS classes, CASE WHEN said = said2 THEN 1 ELSE 2 END AS n_classes,
  round((abs(pa - qa) + abs(pn - qn) + abs(pr - qr)) / 2, 6) AS max_distance FROM d""")
def ambiguity_class(spark, folder):
    rows = softmax(softmax(lines(spark, folder), 0.0, "m1"), 0.6, "m2")
    return diagnostics.class_ambiguity(rows, ["m1", "m2"], FLAG.levels)


def _pair_sql(a: str, b: str) -> str:
    ranks = ", ".join(f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS r{x}" for x in (a, b))
    return f"""SELECT '{a}' AS model_a, '{b}' AS model_b, count(*) AS n, CAST(NULL AS DOUBLE) AS class_disagreement_rate, round(avg(abs({a} - {b})), 6) AS mean_prediction_distance, round(quantile_cont(abs({a} - {b}), 0.5), 6) AS median_prediction_distance,
  round(quantile_cont(abs({a} - {b}), 0.9), 6) AS p90_prediction_distance, round(max(abs({a} - {b})), 6) AS max_prediction_distance, round(corr(r{a}, r{b}), 6) AS prediction_rank_correlation FROM (SELECT *, {ranks} FROM three)"""


@query("prediction_pairs", f"WITH {LINES_SQL}, {THREE_SQL} " + " UNION ALL ".join(_pair_sql(a, b) for a, b in (("m1", "m2"), ("m1", "m3"), ("m2", "m3"))))
def prediction_pairs(spark, folder):
    return compare.prediction_pairs(three_prices(spark, folder), REG, ["m1", "m2", "m3"])


@query("pareto", """
WITH m AS (SELECT c_mktsegment AS model_id, avg(c_acctbal) AS rmse, CAST(count(DISTINCT c_nationkey) * 10 + count(*) % 7 AS DOUBLE) AS complexity FROM customer GROUP BY 1)
SELECT model_id, round(rmse, 6) AS rmse, complexity, NOT EXISTS (SELECT 1 FROM m q WHERE q.rmse <= m.rmse AND q.complexity <= m.complexity AND (q.rmse < m.rmse OR q.complexity < m.complexity)) AS pareto FROM m""")
def pareto(spark, folder):
    size = (F.count_distinct("c_nationkey") * 10 + F.count(F.lit(1)) % 7).cast("double")
    rows = dataset(spark, folder, "customer").groupBy(F.col("c_mktsegment").alias("model_id")).agg(F.avg("c_acctbal").alias("rmse"), size.alias("complexity"))
    return diagnostics.pareto_frame(rows, "rmse", "complexity")


# Associations


def _mean_rank(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query("association_num", f"""
WITH r AS (SELECT {_mean_rank('l_quantity')} AS a, {_mean_rank('l_extendedprice')} AS b FROM lineitem)
SELECT 'l_quantity' AS feature, 'l_extendedprice' AS other, count(*) AS n, round(abs(corr(a, b)), 6) AS association FROM r""")
def association_num(spark, folder):
    return explain.association(dataset(spark, folder, "lineitem"), "l_quantity", "l_extendedprice")


@query("association_mixed", """
WITH g AS (SELECT o_orderstatus, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY 1), t AS (SELECT sum(n * m) / sum(n) AS mean FROM g)
SELECT 'o_totalprice' AS feature, 'o_orderstatus' AS other, CAST(sum(n) AS BIGINT) AS n, round(sqrt(sum(n * (m - mean) * (m - mean)) / (sum(n * (m - mean) * (m - mean)) + sum(n * v))), 6) AS association FROM g, t""")
def association_mixed(spark, folder):
    return explain.association(dataset(spark, folder, "orders"), "o_totalprice", "o_orderstatus")


@query("association_cat", """
WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS o FROM orders GROUP BY 1, 2),
  x AS (SELECT *, sum(o) OVER (PARTITION BY a) AS ta, sum(o) OVER (PARTITION BY b) AS tb FROM c)
SELECT 'o_orderstatus' AS feature, 'o_orderpriority' AS other, CAST(sum(o) AS BIGINT) AS n, round(sqrt((sum(o * o / (ta * tb)::DOUBLE) - 1) / (least(count(DISTINCT a), count(DISTINCT b)) - 1)), 6) AS association FROM x""")
def association_cat(spark, folder):
    return explain.association(dataset(spark, folder, "orders"), "o_orderstatus", "o_orderpriority")


@query("dependence", f"""
WITH r AS (SELECT {_mean_rank('l_quantity')} AS a, {_mean_rank('l_extendedprice')} AS b, {_mean_rank('l_discount')} AS c FROM lineitem),
  p AS (SELECT abs(corr(a, b)) AS ab, abs(corr(a, c)) AS ac, abs(corr(b, c)) AS bc FROM r)
SELECT 'l_quantity' AS feature, CASE WHEN ab >= ac THEN 'l_extendedprice' ELSE 'l_discount' END AS most_associated, round(greatest(ab, ac), 6) AS max_association, greatest(ab, ac) >= 0.7 AS high_dependence FROM p
UNION ALL SELECT 'l_extendedprice', CASE WHEN ab >= bc THEN 'l_quantity' ELSE 'l_discount' END, round(greatest(ab, bc), 6), greatest(ab, bc) >= 0.7 FROM p
UNION ALL SELECT 'l_discount', CASE WHEN ac >= bc THEN 'l_quantity' ELSE 'l_extendedprice' END, round(greatest(ac, bc), 6), greatest(ac, bc) >= 0.7 FROM p""")
def dependence(spark, folder):
    names = ["l_quantity", "l_extendedprice", "l_discount"]
    return explain.dependence(dataset(spark, folder, "lineitem").select(*names), names)


# Importance and effects


def _dealt_sql(groups: dict[str, tuple[str, ...]], repeats: int, stratum: str | None = None, source: str = "lines") -> str:
    """Tables that deal columns anew: placed (the rows in their blocks), dealt (which row gives to which, for each feature and repeat)."""
    part = f"{stratum}, " if stratum else ""
    key = f"feature || '|' || repeat || '|' || {f'coalesce(CAST({stratum} AS VARCHAR), {chr(39)}NA{chr(39)})' if stratum else chr(39) * 2} || '|' || block"
    cubes = "pos + CAST('0x' || substr(h, 1, 7) AS BIGINT)"
    stages = []
    for k in range(explain.ROUNDS):
        more = f"CAST('0x' || substr(h, {8 + 7 * k}, 7) AS BIGINT)" if k + 1 < explain.ROUNDS else "0"
        stages.append(f"v{k + 1} AS (SELECT *, (v{k} * v{k} % {explain.PRIME}) * v{k} % {explain.PRIME} + {more} AS v{k + 1} FROM v{k})")
    return f"""keyed AS (
  SELECT *, md5('123|place|' || row_id) AS k, CAST('0x' || substr(md5('123|place|' || row_id), 1, 15) AS BIGINT) % CAST(ceil(count(*) OVER ({f'PARTITION BY {stratum}' if stratum else ''}) / {explain.DEALT}.0) AS BIGINT) AS block FROM {source}),
  placed AS (SELECT *, row_number() OVER (PARTITION BY {part}block ORDER BY k) - 1 AS pos FROM keyed),
  turn AS (SELECT unnest([{', '.join(repr(g) for g in groups)}]) AS feature), turns AS (SELECT feature, unnest(range(1, {repeats + 1})) AS repeat FROM turn),
  keys AS (SELECT {part}block, feature, repeat, md5('123|' || {key}) AS h FROM (SELECT DISTINCT {part}block FROM placed), turns),
  v0 AS (SELECT {part}block, feature, repeat, pos, {cubes} AS v0, h FROM placed JOIN keys USING ({part}block)), {', '.join(stages)},
  dealt AS (SELECT {part}block, feature, repeat, pos AS giver, row_number() OVER (PARTITION BY {part}block, feature, repeat ORDER BY v{explain.ROUNDS}) - 1 AS pos FROM v{explain.ROUNDS})"""


def _whole_sql(groups: dict[str, tuple[str, ...]], repeats: int, source: str = "lines") -> str:
    """As _dealt_sql, with all rows in one block: any row gives to any other. Cubes are taken modulo the least prime that allows it."""
    stages = []
    for k in range(explain.ROUNDS):
        more = f"CAST('0x' || substr(h, {8 + 7 * k}, 7) AS BIGINT)" if k + 1 < explain.ROUNDS else "0"
        stages.append(f"v{k + 1} AS (SELECT *, (v{k} * v{k} % p) * v{k} % p + {more} AS v{k + 1} FROM v{k})")
    return f"""placed AS (SELECT *, 0 AS block, row_number() OVER (ORDER BY md5('123|place|' || row_id)) - 1 AS pos FROM {source}),
  total AS (SELECT count(*) AS n FROM {source}), candidate AS (SELECT n, unnest(range(n, n + 2000)) AS q FROM total), divisor AS (SELECT unnest(range(2, CAST(sqrt(n + 2000) AS BIGINT) + 2)) AS d FROM total),
  modulus AS (SELECT CASE WHEN min(n) <= {explain.DEALT} THEN {explain.PRIME} ELSE min(q) END AS p FROM candidate WHERE q % 3 = 2 AND NOT EXISTS (SELECT 1 FROM divisor WHERE d * d <= q AND q % d = 0)),
  turn AS (SELECT unnest([{', '.join(repr(g) for g in groups)}]) AS feature), turns AS (SELECT feature, unnest(range(1, {repeats + 1})) AS repeat FROM turn),
  keys AS (SELECT feature, repeat, p, md5('123|' || feature || '|' || repeat || '||0') AS h FROM turns, modulus),
  v0 AS (SELECT feature, repeat, pos, p, pos + CAST('0x' || substr(h, 1, 7) AS BIGINT) AS v0, h FROM placed, keys), {', '.join(stages)},
  dealt AS (SELECT 0 AS block, feature, repeat, pos AS giver, row_number() OVER (PARTITION BY feature, repeat ORDER BY v{explain.ROUNDS}) - 1 AS pos FROM v{explain.ROUNDS})"""


def _importance_sql(groups: dict[str, tuple[str, ...]], repeats: int = 20, stratum: str | None = None, whole: bool = False) -> str:
    moved = lambda c: f"CASE WHEN feature IN ({', '.join(repr(g) for g, names in groups.items() if c in names)}) THEN b.{c} ELSE a.{c} END AS {c}" if any(c in n for n in groups.values()) else f"a.{c}"
    same = f" AND a.{stratum} IS NOT DISTINCT FROM d.{stratum} AND b.{stratum} IS NOT DISTINCT FROM d.{stratum}" if stratum else ""
    t = t_quantile(0.975, repeats - 1)
    return f"""
WITH {LINES_SQL}, {_whole_sql(groups, repeats) if whole else _dealt_sql(groups, repeats, stratum)},
  u AS (SELECT feature, repeat, a.y, {', '.join(moved(c) for c in ('l_quantity', 'l_discount', 'l_tax', 'l_returnflag'))}
    FROM dealt d JOIN placed a ON a.block = d.block AND a.pos = d.pos JOIN placed b ON b.block = d.block AND b.pos = d.giver{' WHERE true' + same if same else ''}),
  base AS (SELECT sqrt(avg(({PRICE} - y) * ({PRICE} - y))) AS b FROM lines),
  s AS (SELECT feature, repeat, sqrt(avg(({PRICE} - y) * ({PRICE} - y))) AS score FROM u GROUP BY feature, repeat)
SELECT feature, count(*) AS repeats, round(avg(score - b), 6) AS importance, round(avg(score), 6) AS permuted_score, round(max(b), 6) AS baseline_score,
  round(greatest(avg(CAST(score >= b AS DOUBLE)), avg(CAST(score <= b AS DOUBLE))), 6) AS sign_stability, round(stddev_samp(score - b) / sqrt(count(*)), 6) AS se,
  round(avg(score - b) - {t} * stddev_samp(score - b) / sqrt(count(*)), 6) AS conf_low, round(avg(score - b) + {t} * stddev_samp(score - b) / sqrt(count(*)), 6) AS conf_high
FROM s, base GROUP BY feature"""


FOUR = ("l_quantity", "l_discount", "l_tax", "l_returnflag")


@query("permutation_importance", _importance_sql({c: (c,) for c in FOUR}, whole=True))
def permutation_importance(spark, folder):
    return explain.permutation_importance(lines(spark, folder), price_scorer, REG, "rmse", FOUR)


@query("importance_grouped", _importance_sql({"money": ("l_discount", "l_tax"), "l_quantity": ("l_quantity",)}))
def importance_grouped(spark, folder):
    return explain.permutation_importance(lines(spark, folder), price_scorer, REG, "rmse", ["l_quantity", "l_discount", "l_tax"], groups={"money": ["l_discount", "l_tax"]}, blocks=True)


@query("importance_blocked", _importance_sql({"l_quantity": ("l_quantity",)}, stratum="l_returnflag"))
def importance_blocked(spark, folder):
    return explain.permutation_importance(lines(spark, folder), price_scorer, REG, "rmse", ["l_quantity"], within="l_returnflag", blocks=True)


def curve(c: Callable[[str], Column]) -> Column:
    return c("l_quantity") * c("l_quantity") / 50.0 + c("l_discount") * c("l_quantity") + F.when(c("l_returnflag") == "N", 0.5).otherwise(0.0)


CURVE = "{q} * {q} / 50.0 + l_discount * {q} + CASE WHEN {f} = 'N' THEN 0.5 ELSE 0.0 END"
SAMPLE_SQL = "sampled AS (SELECT * FROM lines ORDER BY md5('123|sample|' || row_id) LIMIT 1000)"


@query("pdp_numeric", f"""
WITH {LINES_SQL}, {SAMPLE_SQL}, q AS (SELECT quantile_cont(l_quantity, 0.05) AS lo, quantile_cont(l_quantity, 0.95) AS hi FROM sampled),
  g AS (SELECT i AS grid_index, lo + (hi - lo) * i / 9 AS value, (hi - lo) / 9 / 2 AS half FROM q, range(10) t(i)),
  s AS (SELECT grid_index, value, {CURVE.format(q='value', f='l_returnflag')} AS p, CAST(abs(l_quantity - value) <= half AS DOUBLE) AS near FROM sampled, g),
  a AS (SELECT grid_index, value, count(*) AS n, avg(p) AS effect, stddev_samp(p) / sqrt(count(*)) AS se, avg(near) AS share FROM s GROUP BY ALL)
SELECT grid_index, round(value, 6) AS value, n, round(effect, 6) AS effect, round(se, 6) AS se, round(effect - 1.959963984540054 * se, 6) AS conf_low, round(effect + 1.959963984540054 * se, 6) AS conf_high, round(share / max(share) OVER (), 6) AS support FROM a""")
def pdp_numeric(spark, folder):
    rows = split.reference_sample(lines(spark, folder), "row_id", 1000)
    grid = explain.numeric_grid(rows, "l_quantity", 10)
    return explain.partial_dependence(lines(spark, folder), explain.expression_scorer(curve), REG, "l_quantity", grid=grid).frame


@query("pdp_categorical", f"""
WITH {LINES_SQL}, {SAMPLE_SQL}, g AS (SELECT row_number() OVER (ORDER BY count(*) DESC, l_returnflag) - 1 AS grid_index, l_returnflag AS value FROM lines GROUP BY l_returnflag),
  s AS (SELECT grid_index, value, {CURVE.format(q='l_quantity', f='value')} AS p, CAST(l_returnflag = value AS DOUBLE) AS near FROM sampled, g),
  a AS (SELECT grid_index, value, count(*) AS n, avg(p) AS effect, stddev_samp(p) / sqrt(count(*)) AS se, avg(near) AS share FROM s GROUP BY ALL)
SELECT CAST(grid_index AS INT) AS grid_index, value, n, round(effect, 6) AS effect, round(se, 6) AS se, round(effect - 1.959963984540054 * se, 6) AS conf_low, round(effect + 1.959963984540054 * se, 6) AS conf_high, round(share / max(share) OVER (), 6) AS support FROM a""")
def pdp_categorical(spark, folder):
    rows = lines(spark, folder)
    return explain.partial_dependence(rows, explain.expression_scorer(curve), REG, "l_returnflag", grid=explain.categorical_grid(rows, "l_returnflag")).frame


@query("ale", f"""
WITH {LINES_SQL}, c AS (SELECT list_sort(list_distinct(quantile_cont(l_quantity, [i / 5.0 FOR i IN range(6)]))) AS cuts FROM lines) ,
  b AS (SELECT l.*, cuts, 1 + len(list_filter(cuts[2:len(cuts) - 1], lambda x: l_quantity >= x)) AS bin FROM lines l, c),
  d AS (SELECT bin, {CURVE.format(q='cuts[bin + 1]', f='l_returnflag')} - ({CURVE.format(q='cuts[bin]', f='l_returnflag')}) AS d FROM b),
  a AS (SELECT bin, count(*) AS n, avg(d) AS local, stddev_samp(d) / sqrt(count(*)) AS se FROM d GROUP BY bin),
  e AS (SELECT i AS bin, cuts[i] AS lower, cuts[i + 1] AS upper FROM c, range(1, 6) t(i) WHERE i < len(cuts)),
  f AS (SELECT e.bin, lower, upper, coalesce(n, 0) AS n, coalesce(local, 0) AS local, se FROM e LEFT JOIN a ON e.bin = a.bin),
  s AS (SELECT *, n / sum(n) OVER ()::DOUBLE AS weight, sum(local) OVER (ORDER BY bin) AS summed FROM f),
  r AS (SELECT *, sum(weight) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS behind, summed - sum(summed * weight) OVER () AS effect FROM s),
  v AS (SELECT a.bin, CASE WHEN count(*) = count(b.se) THEN sqrt(sum(power((CAST(b.bin <= a.bin AS DOUBLE) - b.behind) * b.se, 2))) END AS e FROM r a, r b GROUP BY a.bin)
SELECT CAST(r.bin AS INT) AS bin, round((lower + upper) / 2, 6) AS value, round(lower, 6) AS lower, round(upper, 6) AS upper, n, round(weight, 6) AS weight, round(local, 6) AS local, round(se, 6) AS local_se,
  round(effect, 6) AS effect, round(e, 6) AS se, round(effect - 1.959963984540054 * e, 6) AS conf_low, round(effect + 1.959963984540054 * e, 6) AS conf_high, round(n / max(n) OVER ()::DOUBLE, 6) AS support FROM r JOIN v ON r.bin = v.bin""")
def ale(spark, folder):
    return explain.ale(lines(spark, folder), explain.expression_scorer(curve), REG, "l_quantity", points=5).frame


@query("effect_pairs", """
WITH g AS (SELECT l_linestatus AS model_id, CAST(floor(l_quantity / 5) AS INT) AS grid_index, avg(l_extendedprice / 1000.0) AS effect, count(*) AS n FROM lineitem GROUP BY 1, 2),
  c AS (SELECT *, grid_index * 5.0::DOUBLE AS value, n / max(n) OVER (PARTITION BY model_id)::DOUBLE AS support FROM g),
  p AS (SELECT a.value, a.effect AS ea, b.effect AS eb FROM c a JOIN c b ON a.grid_index = b.grid_index AND a.model_id = 'F' AND b.model_id = 'O' WHERE a.support >= 0.1 AND b.support >= 0.1),
  d AS (SELECT *, ea - avg(ea) OVER () - eb + avg(eb) OVER () AS shape, ea - lag(ea) OVER (ORDER BY value) AS da, eb - lag(eb) OVER (ORDER BY value) AS db, rank() OVER (ORDER BY ea) AS ra, rank() OVER (ORDER BY eb) AS rb FROM p)
SELECT 'F' AS model_a, 'O' AS model_b, count(*) AS n_overlap, round(avg(abs(ea - eb)), 6) AS mean_absolute_level_gap, round(sqrt(avg(shape * shape)), 6) AS centered_shape_rmse, round(max(abs(ea - eb)), 6) AS max_absolute_gap,
  round(corr(ra, rb), 6) AS effect_rank_correlation, round(avg(CASE WHEN da IS NOT NULL THEN CAST(sign(da) = sign(db) AS DOUBLE) END), 6) AS direction_agreement FROM d""")
def effect_pairs(spark, folder):
    place = F.floor(F.col("l_quantity") / 5).cast("int")
    rows = dataset(spark, folder, "lineitem").groupBy(F.col("l_linestatus").alias("model_id"), place.alias("grid_index")).agg(F.avg(F.col("l_extendedprice") / 1000.0).alias("effect"), F.count(F.lit(1)).alias("n"))
    most = F.max("n").over(Window.partitionBy("model_id"))
    return compare.effect_pairs(rows.select("model_id", "grid_index", (F.col("grid_index") * 5.0).alias("value"), "effect", (F.col("n") / most).alias("support")))


@query("rank_agreement", f"""
WITH r AS (SELECT o_orderstatus, {_mean_rank('o_totalprice')} AS a, {_mean_rank('o_custkey')} AS b FROM orders)
SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r""")
def rank_agreement(spark, folder):
    return explain.spearman(dataset(spark, folder, "orders"), "o_totalprice", "o_custkey")


# Tuning statistics

@query("fold_uncertainty", """
WITH s AS (SELECT o_orderstatus AS configuration_id, month(o_orderdate) AS fold, CASE WHEN o_orderstatus <> 'P' OR month(o_orderdate) < 12 THEN stddev_pop(o_totalprice / 1000) END AS score, count(*) AS rows FROM orders GROUP BY 1, 2),
  w AS (SELECT *, rows / sum(rows) OVER (PARTITION BY configuration_id)::DOUBLE AS w FROM s),
  m AS (SELECT configuration_id, count(*) AS folds, count(score) AS scored, sum(w * score * score)::DOUBLE AS m, sum(w * w) AS ww FROM w GROUP BY 1),
  v AS (SELECT m.configuration_id, any_value(folds) AS folds, any_value(scored) AS scored, any_value(m) AS m, any_value(ww) AS ww, sum(w * (score * score - m) * (score * score - m)) / (1 - any_value(ww)) AS v FROM m JOIN w ON m.configuration_id = w.configuration_id GROUP BY 1)
SELECT configuration_id, folds, round(CASE WHEN folds = scored THEN sqrt(m) END, 6) AS cv_score, round(CASE WHEN folds = scored THEN sqrt(v) / (2 * sqrt(m)) END, 6) AS cv_sd, round(CASE WHEN folds = scored THEN sqrt(v) * sqrt(ww) / (2 * sqrt(m)) END, 6) AS cv_se FROM v""")
def fold_uncertainty(spark, folder):
    rows = dataset(spark, folder, "orders").groupBy(F.col("o_orderstatus").alias("configuration_id"), F.month("o_orderdate").alias("fold")).agg(F.stddev_pop(F.col("o_totalprice") / 1000).alias("score"), F.count(F.lit(1)).alias("rows"))
    failed = (F.col("configuration_id") == "P") & (F.col("fold") == 12)
    return selection.fold_uncertainty(rows.withColumn("score", F.when(~failed, F.col("score"))), "rmse")


CANDIDATES_SQL = """g AS (SELECT o_orderstatus || ' ' || o_orderpriority AS configuration_id, o_orderstatus AS family, count(*) AS n, stddev_pop(o_totalprice / 1000) AS cv_score FROM orders GROUP BY 1, 2),
  c AS (SELECT *, ascii(family) AS simplicity_rank, n::DOUBLE AS complexity_proxy, cv_score / sqrt(n) AS cv_se, row_number() OVER (ORDER BY configuration_id) AS plan_order FROM g)"""


@query("one_se_select", f"""
WITH {CANDIDATES_SQL},
  b AS (SELECT cv_score + cv_se AS l FROM c ORDER BY cv_score, plan_order LIMIT 1), e AS (SELECT * FROM c, b WHERE cv_score <= l),
  s AS (SELECT * FROM e WHERE simplicity_rank = (SELECT min(simplicity_rank) FROM e)), f AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY complexity_proxy, cv_score, configuration_id) AS r FROM s)
SELECT configuration_id, family, round(cv_score, 6) AS cv_score FROM f WHERE r = 1 ORDER BY cv_score, family, configuration_id LIMIT 1""")
def one_se_select(spark, folder):
    rows = dataset(spark, folder, "orders").groupBy(F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("configuration_id"), F.col("o_orderstatus").alias("family"))
    rows = rows.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(F.col("o_totalprice") / 1000).alias("cv_score"))
    order = F.row_number().over(Window.orderBy("configuration_id"))  # of a row for each configuration
    rows = rows.select("*", F.ascii("family").alias("simplicity_rank"), F.col("n").cast("double").alias("complexity_proxy"), (F.col("cv_score") / F.sqrt("n")).alias("cv_se"), order.alias("plan_order"))
    return selection.select_one_se(rows).select("configuration_id", "family", "cv_score")


# More of preparation, partitions and selection, over whole tables


@query("identifiers", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS name, {gone} AS removed, count(DISTINCT {c}) AS levels FROM events" for c, gone in (("event_id", "true"), ("user_id", "true"), ("event_type", "false"), ("value", "false"))) + ")")
def identifiers(spark, folder):
    rows = dataset(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    gone = prep.id_columns(rows, "target")
    counts = rows.agg(*[F.count_distinct(c).alias(c) for c in rows.columns])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(c in gone).alias("removed"), F.col(c).alias("levels")) for c in rows.columns])))


@query("drop_missing_rows", f"""
WITH {LABELLED_SQL} SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars, CAST(quality AS DOUBLE) AS quality, lang, toxic FROM labelled WHERE quality IS NOT NULL AND toxic IS NOT NULL AND n_chars IS NOT NULL AND lang IS NOT NULL""")
def drop_missing_rows(spark, folder):
    rows = labelled(spark, folder).select("doc_id", "n_chars", "quality", "lang", "toxic")
    return prep.learn_recipe(rows, "toxic", missing="remove_rows", skip=("doc_id",)).apply(rows, keep=("doc_id",))


@query("drop_missing_columns", f"""
WITH {LABELLED_SQL} SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars, lang, source FROM labelled""")
def drop_missing_columns(spark, folder):
    rows = labelled(spark, folder).select("doc_id", "n_chars", "quality", "toxic", "lang", "source")
    return prep.learn_recipe(rows, "source", missing="drop_columns", threshold=0.5, skip=("doc_id",)).apply(rows, keep=("doc_id",))


@query("supplied_folds", """
WITH f AS (SELECT o_orderpriority AS label, row_number() OVER (ORDER BY min(o_orderkey)) AS fold FROM orders GROUP BY 1)
SELECT o_orderkey, CAST(fold AS INT) AS fold FROM orders JOIN f ON label = o_orderpriority""")
def supplied_folds(spark, folder):
    return split.supplied_folds(dataset(spark, folder, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey").select("o_orderkey", "fold")


@query("quintile_strata", """
WITH q AS (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS c FROM orders)
SELECT o_orderkey, concat_ws('|', CAST(1 + len(list_filter(c, lambda x: o_totalprice > x)) AS VARCHAR), o_orderstatus) AS stratum FROM orders, q""")
def quintile_strata(spark, folder):
    rows = dataset(spark, folder, "orders")
    return rows.select("o_orderkey", split.strata_key(rows, ["o_totalprice", "o_orderstatus"]).alias("stratum"))


@query("calibration_error", f"""
WITH {DOCS_SQL}, r AS (SELECT y, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r, count(*) OVER () AS n FROM docs),
  g AS (SELECT count(*) AS n, abs(avg(score) - avg(y)) AS gap FROM r GROUP BY least(5, ceil(r / n * 5)))
SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS groups, round(sum(n * gap) / sum(n), 6) AS calibration_error, round(max(gap), 6) AS max_gap FROM g""")
def calibration_error(spark, folder):
    return diagnostics.calibration_error(diagnostics.calibration(scored_docs(spark, folder), TOXIC))


@query("ambiguity_summary", f"""
WITH {LINES_SQL}, {THREE_SQL}, r AS (SELECT greatest(m1, m2, m3) - least(m1, m2, m3) AS d FROM three)
SELECT count(*) AS n, round(quantile_cont(d, 0.5), 6) AS median_range, round(quantile_cont(d, 0.9), 6) AS p90_range, round(max(d), 6) AS max_range FROM r""")
def ambiguity_summary(spark, folder):
    return diagnostics.ambiguity_summary(diagnostics.regression_ambiguity(three_prices(spark, folder), ["m1", "m2", "m3"]), True)


@query("ambiguous_classes", f"""
WITH {LINES_SQL}, {SOFTMAX_SQL}, b AS (SELECT *, exp({LOGITS['R']} + 0.6) AS er2 FROM m),
  c AS (SELECT *, ea / (ea + en + er2) AS qa, en / (ea + en + er2) AS qn, er2 / (ea + en + er2) AS qr FROM b),
  d AS (SELECT CASE WHEN qa >= qn AND qa >= qr THEN 'A' WHEN qn >= qr THEN 'N' ELSE 'R' END <> said AS differ, (abs(pa - qa) + abs(pn - qn) + abs(pr - qr)) / 2 AS d FROM c)
SELECT count(*) AS n, round(avg(CAST(differ AS DOUBLE)), 6) AS disagreement_rate, round(avg(d), 6) AS mean_distance, round(max(d), 6) AS max_distance FROM d""")
def ambiguous_classes(spark, folder):
    return diagnostics.ambiguity_summary(ambiguity_class(spark, folder), False)


@query("prediction_agreement", f"""
WITH {LINES_SQL}, {THREE_SQL}, r AS (SELECT {', '.join(f"{_mean_rank(m)} AS r{m}, {m}" for m in ('m1', 'm2', 'm3'))} FROM three),
  p AS (SELECT unnest([m1, m2, m3]) AS p FROM three)
SELECT round((corr(rm1, rm2) + corr(rm1, rm3) + corr(rm2, rm3)) / 3, 6) AS score, round(avg(greatest(m1, m2, m3) - least(m1, m2, m3)) / (SELECT stddev_samp(p) FROM p), 6) AS ambiguity FROM r""")
def prediction_agreement(spark, folder):
    found = compare.prediction_agreement(three_prices(spark, folder), REG, ["m1", "m2", "m3"])
    return spark.createDataFrame([(found["score"], found["ambiguity"])], "score double, ambiguity double")


@query("prediction_rows", f"""
WITH {DOCS_SQL} SELECT row_id, CASE WHEN y = 1 THEN '1' ELSE '0' END AS observed, CASE WHEN score >= 0.5 THEN '1' ELSE '0' END AS predicted, round(score, 6) AS probability, (score >= 0.5) = (y = 1) AS correct FROM docs""")
def prediction_rows(spark, folder):
    return metrics.prediction_table(scored_docs(spark, folder), TOXIC)


@query("pareto_products", """
WITH m AS (SELECT p_brand AS model_id, avg(p_retailprice) AS rmse, CAST(max(p_size) AS DOUBLE) AS complexity FROM part GROUP BY 1)
SELECT model_id, round(rmse, 6) AS rmse, complexity, NOT EXISTS (SELECT 1 FROM m q WHERE q.rmse <= m.rmse AND q.complexity <= m.complexity AND (q.rmse < m.rmse OR q.complexity < m.complexity)) AS pareto FROM m""")
def pareto_products(spark, folder):
    rows = dataset(spark, folder, "part").groupBy(F.col("p_brand").alias("model_id")).agg(F.avg("p_retailprice").alias("rmse"), F.max("p_size").cast("double").alias("complexity"))
    return diagnostics.pareto_frame(rows, "rmse", "complexity")


def _priority_folds(spark, folder) -> DataFrame:
    rows = dataset(spark, folder, "orders")
    return rows.groupBy(F.col("o_orderstatus").alias("configuration_id"), F.dayofmonth("o_orderdate").alias("fold")).agg(F.stddev_pop(F.col("o_totalprice") / 1000).alias("score"), F.count(F.lit(1)).alias("rows"))


@query("fold_uncertainty_orders", """
WITH s AS (SELECT o_orderstatus AS configuration_id, day(o_orderdate) AS fold, stddev_pop(o_totalprice / 1000) AS score, count(*) AS rows FROM orders GROUP BY 1, 2),
  w AS (SELECT *, rows / sum(rows) OVER (PARTITION BY configuration_id)::DOUBLE AS w FROM s),
  m AS (SELECT configuration_id, count(*) AS folds, sum(w * score * score)::DOUBLE AS m, sum(w * w) AS ww FROM w GROUP BY 1),
  v AS (SELECT m.configuration_id, any_value(folds) AS folds, any_value(m) AS m, any_value(ww) AS ww, sum(w * (score * score - m) * (score * score - m)) / (1 - any_value(ww)) AS v FROM m JOIN w ON m.configuration_id = w.configuration_id GROUP BY 1)
SELECT configuration_id, folds, round(sqrt(m), 6) AS cv_score, round(sqrt(v) / (2 * sqrt(m)), 6) AS cv_sd, round(sqrt(v) * sqrt(ww) / (2 * sqrt(m)), 6) AS cv_se FROM v""")
def fold_uncertainty_orders(spark, folder):
    return selection.fold_uncertainty(_priority_folds(spark, folder), "rmse")


@query("baseline_classes", f"""
WITH t AS (SELECT l_returnflag AS f, count(*) / sum(count(*)) OVER ()::DOUBLE AS p FROM lineitem WHERE {EARLY.format('l_orderkey')} GROUP BY 1)
SELECT count(*) AS n, round(avg(-ln(p)), 6) AS log_loss, round(avg((SELECT sum(p * p) FROM t) - p * p + (1 - p) * (1 - p)), 6) AS brier_score,
  round(avg(CAST(l_returnflag = (SELECT f FROM t ORDER BY p DESC, f LIMIT 1) AS DOUBLE)), 6) AS accuracy, round(1 / 3.0::DOUBLE, 6) AS macro_recall
FROM lineitem JOIN t ON f = l_returnflag WHERE NOT ({EARLY.format('l_orderkey')})""")
def baseline_classes(spark, folder):
    rows = dataset(spark, folder, "lineitem")
    model = fit.baseline(rows.where(early("l_orderkey")), FLAG)
    return metrics.evaluate(model.score(rows.where(~early("l_orderkey"))).withColumn("y", FLAG.label()), FLAG)


@query("importance_logloss", f"""
WITH {DOCS_SQL}, {_dealt_sql({"lang": ("lang",)}, 20, source="docs")},
  u AS (SELECT repeat, a.y, a.n_chars, b.lang FROM dealt d JOIN placed a ON a.block = d.block AND a.pos = d.pos JOIN placed b ON b.block = d.block AND b.pos = d.giver),
  p AS (SELECT repeat, y, 1.0 / (1.0 + exp(-(-2.0 + n_chars / 5000.0 - CASE WHEN lang = 'en' THEN 0.5 ELSE 0.0 END))) AS score FROM u),
  s AS (SELECT repeat, avg(-(y * ln({CLAMPED}) + (1 - y) * ln(1 - {CLAMPED}))) AS score FROM p GROUP BY repeat),
  base AS (SELECT avg(-(y * ln({CLAMPED}) + (1 - y) * ln(1 - {CLAMPED}))) AS b FROM docs)
SELECT 'lang' AS feature, CAST(repeat AS INT) AS repeat, round(score, 6) AS score, round(b, 6) AS baseline, round(score - b, 6) AS delta FROM s, base""")
def importance_logloss(spark, folder):
    rows = scored_docs(spark, folder).drop("score")
    chance = lambda c: 1.0 / (1.0 + F.exp(-(F.lit(-2.0) + c("n_chars") / 5000.0 - F.when(c("lang") == "en", 0.5).otherwise(0.0))))
    return explain.permutation_scores(rows, explain.expression_scorer(chance), TOXIC, "logloss", {"lang": ["lang"]}, blocks=True)


@query("effects_of_two", f"""
WITH {LINES_SQL}, {SAMPLE_SQL}, g AS (SELECT 'l_linestatus' AS feature, row_number() OVER (ORDER BY count(*) DESC, l_linestatus) - 1 AS grid_index, l_linestatus AS value FROM sampled GROUP BY l_linestatus
  UNION ALL SELECT 'l_returnflag', row_number() OVER (ORDER BY count(*) DESC, l_returnflag) - 1, l_returnflag FROM sampled GROUP BY l_returnflag),
  s AS (SELECT feature, grid_index, value, {CURVE.format(q='l_quantity', f="CASE WHEN feature = 'l_returnflag' THEN value ELSE l_returnflag END")} AS p FROM sampled, g)
SELECT feature, CAST(grid_index AS INT) AS grid_index, value, round(avg(p), 6) AS effect FROM s GROUP BY ALL""")
def effects_of_two(spark, folder):
    rows = split.reference_sample(lines(spark, folder), "row_id", 1000)
    found = explain.partial_dependences(rows, explain.expression_scorer(curve), REG, ["l_returnflag", "l_linestatus"])
    parts = [e.frame.select(F.lit(f).alias("feature"), "grid_index", "value", "effect") for f, e in found.items()]
    return parts[0].unionByName(parts[1])


# Fitted models: the least-squares line has SQL, the others return their leaderboards


@query("leaderboard_linear", f"""
WITH x AS (SELECT {EARLY.format('l_orderkey')} AS training, l_extendedprice / 1000.0 AS y, l_quantity AS q FROM lineitem),
  t AS (SELECT regr_slope(y, q) AS b, regr_intercept(y, q) AS a, avg(y) AS m FROM x WHERE training),
  s AS (SELECT y, unnest(['main_model', 'baseline']) AS model_id, unnest([a + b * q, m]) AS p FROM x, t WHERE NOT training),
  g AS (SELECT model_id, count(*) AS n, sqrt(avg((p - y) * (p - y))) AS rmse, avg(abs(p - y)) AS mae, 1 - sum((p - y) * (p - y)) / (var_pop(y) * count(y)) AS r_squared FROM s GROUP BY model_id),
  r AS (SELECT *, CAST(rank() OVER (ORDER BY rmse) AS INT) AS "rank", max(CASE WHEN model_id = 'baseline' THEN rmse END) OVER () AS base FROM g)
SELECT model_id, n, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(r_squared, 6) + 0.0::DOUBLE AS r_squared, "rank", round((base - rmse) / base, 6) AS improvement,
  row_number() OVER (ORDER BY "rank", model_id) = 1 AS winner FROM r""")
def leaderboard_linear(spark, folder):
    rows = dataset(spark, folder, "lineitem").select("l_orderkey", (F.col("l_extendedprice") / 1000.0).alias("y"), "l_quantity")
    training, rest = rows.where(early("l_orderkey")), rows.where(~early("l_orderkey"))
    models = [fit.fit_learner(training, REG, "linear", {}, ["l_quantity"], model_id="main_model"), fit.baseline(training, REG)]
    return workflow.board(workflow.wide_scores(rest, models), REG, models).drop("family", "complexity")


def _board(training: DataFrame, rest: DataFrame, task: Task, family: str, parameters: dict, features: list[str]) -> DataFrame:
    models = [fit.fit_learner(training, task, family, parameters, features, model_id="main_model"), fit.baseline(training, task)]
    y = task.label().cast("double" if task.kind == REGRESSION else "int")
    return workflow.board(workflow.wide_scores(rest.withColumn("y", y), models), task, models)


@query("fit_logistic")
def fit_logistic(spark, folder):
    rows = scored_docs(spark, folder).drop("score").withColumn("toxic", F.col("y").cast("string"))
    return _board(rows.where(early("row_id")), rows.where(~early("row_id")), TOXIC, "linear", {}, ["n_chars", "lang"])


@query("fit_tree")
def fit_tree(spark, folder):
    rows = dataset(spark, folder, "lineitem")
    return _board(rows.where(early("l_orderkey")), rows.where(~early("l_orderkey")), FLAG, "tree", {"maxdepth": 4, "cp": 0.0, "minsplit": 20}, ["l_quantity", "l_discount", "l_linestatus"])


@query("fit_forest")
def fit_forest(spark, folder):
    rows = lines(spark, folder)
    settings = registry.FAMILIES["forest"].grid(0, 3, REGRESSION, 2)[0]
    return _board(rows.where(early("row_id")), rows.where(~early("row_id")), REG, "forest", settings, ["l_quantity", "l_discount", "l_tax"])


@query("fit_gbt")
def fit_gbt(spark, folder):
    rows = lines(spark, folder)
    settings = registry.FAMILIES["boosting"].grid(0, 3, REGRESSION, 2)[0]
    return _board(rows.where(early("row_id")), rows.where(~early("row_id")), REG, "boosting", settings, ["l_quantity", "l_discount", "l_tax"])


@query("tuned_core")
def tuned_core(spark, folder):
    rows = labelled(spark, folder).where("toxic IS NOT NULL").select(F.col("doc_id").alias("row_id"), "n_chars", "lang", F.col("toxic").cast("string").alias("toxic"))
    record = tuning.tune(rows, TOXIC, "row_id", registry.portfolio("core", TOXIC.kind), registry.BUDGETS["core"], options={"missing": "impute", "novel": "mode"})
    found = [(c["configuration_id"], c["family"], c["cv_score"], c["cv_se"], c["configuration_id"] == record.selected) for c in record.candidates]
    return spark.createDataFrame(found, "configuration_id string, family string, cv_score double, cv_se double, selected boolean")


# Learners by their parts, which SQL can replay


@query("cv_linear", """
WITH x AS (SELECT l_orderkey % 5 AS fold, l_extendedprice / 1000.0 AS y, l_quantity AS q FROM lineitem), f AS (SELECT DISTINCT fold FROM x),
  t AS (SELECT f.fold, regr_slope(y, q) AS b, regr_intercept(y, q) AS a FROM x JOIN f ON x.fold <> f.fold GROUP BY f.fold)
SELECT CAST(x.fold AS INT) AS fold, count(*) AS rows, round(any_value(a), 6) AS intercept, round(any_value(b), 6) AS slope, round(sqrt(avg((a + b * q - y) * (a + b * q - y))), 6) AS rmse FROM x JOIN t ON x.fold = t.fold GROUP BY x.fold""")
def cv_linear(spark, folder):
    rows = dataset(spark, folder, "lineitem")
    found = grams.grams(rows, F.array(F.col("l_quantity").cast("double")), F.col("l_extendedprice") / 1000.0, (F.col("l_orderkey") % 5).cast("int"))
    total, out = reduce(grams.Gram.__add__, found.values()), []
    for fold, held in found.items():
        intercept, beta = grams.least_squares(total - held)
        out.append((fold, int(held.n), intercept, float(beta[0]), (held.squared_error(intercept, beta) / held.n) ** 0.5))
    return spark.createDataFrame(out, "fold int, rows long, intercept double, slope double, rmse double")


@query("penalty_path", """
WITH x AS (SELECT l_quantity AS q, l_extendedprice / 1000.0 AS y FROM lineitem), m AS (SELECT avg(q) AS mq, avg(y) AS my, stddev_pop(q) AS s, covar_pop(q, y) / stddev_pop(q) AS c FROM x),
  p AS (SELECT i AS step, abs(c) / 0.5::DOUBLE * power(0.001, i / 79.0::DOUBLE) AS penalty, mq, my, s, c FROM m, range(80) t(i)),
  b AS (SELECT *, sign(c) * greatest(abs(c) - 0.5 * penalty, 0) / (1 + 0.5 * penalty) / s AS slope FROM p)
SELECT CAST(step AS INT) AS step, round(penalty, 6) AS penalty, round(my - slope * mq, 6) AS intercept, round(slope, 6) + 0.0::DOUBLE AS slope FROM b""")
def penalty_path(spark, folder):
    gram = grams.grams(dataset(spark, folder, "lineitem"), F.array(F.col("l_quantity").cast("double")), F.col("l_extendedprice") / 1000.0)[0]
    rows = [(i, penalty, intercept, float(beta[0])) for i, (penalty, intercept, beta) in enumerate(grams.elastic_net_path(gram, 0.5))]
    return spark.createDataFrame(rows, "step int, penalty double, intercept double, slope double")


@query("penalty_ends", """
WITH x AS (SELECT l_quantity AS q, l_discount AS d, l_extendedprice / 1000.0 AS y FROM lineitem),
  m AS (SELECT avg(q) AS mq, avg(d) AS md, avg(y) AS my, var_pop(q) AS qq, var_pop(d) AS dd, covar_pop(q, d) AS qd, covar_pop(q, y) AS qy, covar_pop(d, y) AS dy FROM x),
  b AS (SELECT *, (qy * dd - dy * qd) / (qq * dd - qd * qd) AS bq, (dy * qq - qy * qd) / (qq * dd - qd * qd) AS bd FROM m)
SELECT 'all zero' AS side, round(greatest(abs(qy) / sqrt(qq), abs(dy) / sqrt(dd)) / 0.5, 6) AS penalty, round(my, 6) AS intercept, 0.0::DOUBLE AS quantity, 0.0::DOUBLE AS discount FROM m
UNION ALL SELECT 'none', 0.0::DOUBLE, round(my - bq * mq - bd * md, 6), round(bq, 6), round(bd, 6) FROM b""")
def penalty_ends(spark, folder):
    gram = grams.grams(dataset(spark, folder, "lineitem"), F.array(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double")), F.col("l_extendedprice") / 1000.0)[0]
    ends = (("all zero", grams.elastic_net_path(gram, 0.5)[0]), ("none", grams.elastic_net_path(gram, 0.5, [0.0])[0]))
    return spark.createDataFrame([(side, float(p), a, float(b[0]), float(b[1])) for side, (p, a, b) in ends], "side string, penalty double, intercept double, quantity double, discount double")


#: Weights of a network of two inputs and two hidden units: biases and inputs of the hidden layer, then bias and weights of the output.
NET = (0.1, -0.2, 0.5, 0.3, -0.4, 0.7, 0.05, 0.9, -0.6)


@query("network_gradient", f"""
WITH x AS (SELECT l_quantity / 50.0 AS q, l_discount * 10.0 AS d, l_extendedprice / 100000.0 AS t FROM lineitem),
  h AS (SELECT *, 1 / (1 + exp(-({NET[0]} + {NET[2]} * q + {NET[4]} * d))) AS a, 1 / (1 + exp(-({NET[1]} + {NET[3]} * q + {NET[5]} * d))) AS b FROM x),
  o AS (SELECT *, {NET[6]} + {NET[7]} * a + {NET[8]} * b - t AS e FROM h), g AS (SELECT *, 2 * e AS f, 2 * e * {NET[7]} * a * (1 - a) AS ga, 2 * e * {NET[8]} * b * (1 - b) AS gb FROM o),
  s AS (SELECT [avg(e * e), avg(ga), avg(gb), avg(ga * q), avg(gb * q), avg(ga * d), avg(gb * d), avg(f), avg(f * a), avg(f * b)] AS v FROM g)
SELECT CAST(i AS INT) AS place, round(v[i + 1], 6) AS value FROM s, range(10) t(i)""")
def network_gradient(spark, folder):
    rows = dataset(spark, folder, "lineitem")
    x, y = F.array(F.col("l_quantity") / 50.0, F.col("l_discount") * 10.0), F.col("l_extendedprice") / 100000.0
    packed, n = neural.blocks(rows, x, y), rows.count()
    ship(spark)
    found = neural.evaluate(packed, neural.Net(2, 2, 1, REGRESSION, 0.0), np.array(NET)) / n
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(found)], "place int, value double")


@query("nearest_parts", f"""
WITH x AS (SELECT p_partkey, p_size AS y, CAST(p_retailprice AS DOUBLE) AS a, CAST(p_partkey % 977 AS DOUBLE) AS b, {EARLY.format('p_partkey')} AS training FROM part),
  m AS (SELECT avg(a) AS ma, stddev_samp(a) AS sa, avg(b) AS mb, stddev_samp(b) AS sb FROM x WHERE training),
  z AS (SELECT p_partkey, y, training, (a - ma) / sa AS a, (b - mb) / sb AS b FROM x, m),
  d AS (SELECT q.p_partkey, t.y, row_number() OVER (PARTITION BY q.p_partkey ORDER BY round(sqrt((q.a - t.a) * (q.a - t.a) + (q.b - t.b) * (q.b - t.b)), 10), t.y) AS r FROM z q, z t WHERE t.training AND NOT q.training)
SELECT p_partkey, round(avg(y), 6) AS score FROM d WHERE r <= 5 GROUP BY p_partkey""")
def nearest_parts(spark, folder):
    rows = dataset(spark, folder, "part").select("p_partkey", F.col("p_size").alias("y"), F.col("p_retailprice").cast("double").alias("a"), (F.col("p_partkey") % 977).cast("double").alias("b"))
    model = fit.fit_learner(rows.where(early("p_partkey")), REG, "neighbors", {"k": 5, "distance": 2.0, "kernel": "rectangular"}, ["a", "b"])
    return model.score(rows.where(~early("p_partkey"))).select("p_partkey", "score")


@query("boosting_split", f"""
WITH {LINES_SQL}, c AS (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_discount, l_tax])::DOUBLE AS v, y - (SELECT avg(y) FROM lines) AS d FROM lines),
  s AS (SELECT feature, v, sum(d) AS d, count(*) AS n FROM c GROUP BY 1, 2),
  r AS (SELECT feature, v, sum(d) OVER f AS dl, sum(n) OVER f AS nl, sum(d) OVER (PARTITION BY feature) AS da, sum(n) OVER (PARTITION BY feature) AS na FROM s WINDOW f AS (PARTITION BY feature ORDER BY v)),
  g AS (SELECT *, dl * dl / (nl + 1) + (da - dl) * (da - dl) / (na - nl + 1) AS gain FROM r WHERE nl < na)
SELECT feature, round(v, 6) AS cut, round(0.5 * dl / (nl + 1), 6) AS low_side, round(0.5 * (da - dl) / (na - nl + 1), 6) AS high_side FROM g ORDER BY gain DESC LIMIT 1""")
def boosting_split(spark, folder):
    settings = {"nrounds": 1, "eta": 0.5, "max_depth": 1, "min_child_weight": 1.0, "subsample": 1.0, "colsample_bytree": 1.0, "reg_alpha": 0.0, "reg_lambda": 1.0}
    names = ["l_quantity", "l_discount", "l_tax"]
    tree = fit.fit_learner(lines(spark, folder), REG, "boosting", settings, names).scorer.rounds[0][0]
    return spark.createDataFrame([(names[tree.column[0]], tree.cut[0], tree.value[tree.left[0]], tree.value[tree.right[0]])], "feature string, cut double, low_side double, high_side double")


def _best_cuts(source: str) -> str:
    """The best cut of each node by squared errors, from (node, feature, v, y)."""
    return f"""(WITH d AS (SELECT node, feature, v, y, y - avg(y) OVER (PARTITION BY node) AS d FROM {source}),
    s AS (SELECT node, feature, v, sum(y) AS y, sum(d) AS d, count(*) AS n FROM d GROUP BY 1, 2, 3),
    r AS (SELECT node, feature, v, sum(d) OVER f AS dl, sum(n) OVER f AS nl, sum(d) OVER a AS da, sum(n) OVER a AS na, sum(y) OVER a AS ya FROM s
      WINDOW f AS (PARTITION BY node, feature ORDER BY v), a AS (PARTITION BY node, feature))
  SELECT node, feature, v AS cut, ya / na AS mean FROM r WHERE nl < na QUALIFY row_number() OVER (PARTITION BY node ORDER BY dl * dl / nl + (da - dl) * (da - dl) / (na - nl) DESC, feature, v) = 1)"""


@query("forest_splits", f"""
WITH {LINES_SQL}, c AS (SELECT 0 AS node, unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_discount, l_tax])::DOUBLE AS v, y FROM lines),
  root AS {_best_cuts("c")},
  side AS (SELECT CASE WHEN CASE feature WHEN 'l_quantity' THEN l_quantity WHEN 'l_discount' THEN l_discount ELSE l_tax END <= cut THEN 1 ELSE 2 END AS node, l_quantity, l_discount, l_tax, y FROM lines, root),
  below AS (SELECT node, unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_discount, l_tax])::DOUBLE AS v, y FROM side), next AS {_best_cuts("below")}
SELECT node, feature, round(cut, 6) AS cut, round(mean, 6) AS mean FROM (SELECT * FROM root UNION ALL SELECT * FROM next)""")
def forest_splits(spark, folder):
    """The three upper splits of a tree that takes every row once and may split on every column."""
    names = ["l_quantity", "l_discount", "l_tax"]
    training = lines(spark, folder)
    scale = training.agg(F.avg("y"), F.stddev_pop("y")).first()
    settings = {"num.trees": 1, "mtry": 3, "min.node.size": 1000, "sample.fraction": 1.0, "splitrule": "default"}
    rows = trees.celled(training, {n: F.col(n).cast("double") for n in names}, (F.col("y") - scale[0]) / scale[1], REGRESSION, np.zeros(1), local=0)
    try:
        nodes = forest.plant(rows, forest.plan_of(rows, REGRESSION, 0, settings, 1, resample=False)).nodes
    finally:
        rows.release()
    found = [(i, names[nodes.column[k]], float(rows.cuts[nodes.column[k]][nodes.bin[k]]), float(nodes.value[k, 0]) * scale[1] + scale[0]) for i, k in enumerate((0, nodes.left[0], nodes.left[0] + 1))]
    return spark.createDataFrame(found, "node int, feature string, cut double, mean double")


@query("row_digest", """
WITH k AS (SELECT md5('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_nationkey":' || c_nationkey || '}') AS k FROM customer)
SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(k, 1, 15) AS BIGINT)) AS VARCHAR) AS low, CAST(sum(CAST('0x' || substr(k, 17, 15) AS BIGINT)) AS VARCHAR) AS high FROM k""")
def row_digest(spark, folder):
    return row_sums(dataset(spark, folder, "customer").select("c_nationkey", "c_custkey", "c_mktsegment")).select("rows", F.col("low").cast("string"), F.col("high").cast("string"))


@query("fit_additive")
def fit_additive(spark, folder):
    rows = lines(spark, folder)
    return _board(rows.where(early("row_id")), rows.where(~early("row_id")), REG, "additive", registry.FAMILIES["additive"].grid(0, 3, REGRESSION, 2)[0], ["l_quantity", "l_discount", "l_tax", "l_returnflag"])


@query("fit_mars")
def fit_mars(spark, folder):
    rows = lines(spark, folder)
    return _board(rows.where(early("row_id")), rows.where(~early("row_id")), REG, "mars", {"degree": 2, "nprune": 6}, ["l_quantity", "l_discount", "l_tax", "l_returnflag"])


@query("fit_neural")
def fit_neural(spark, folder):
    rows = scored_docs(spark, folder).drop("score").withColumn("toxic", F.col("y").cast("string"))
    return _board(rows.where(early("row_id")), rows.where(~early("row_id")), TOXIC, "neural", {"size": 2, "decay": 0.03}, ["n_chars", "lang"])
