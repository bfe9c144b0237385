"""Metrics and importance over scores given by a rule, choice of training rows and of scored rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from seriesloom import fixtures as fx
from seriesloom.catalog import query
from seriesloom.catalog.base import RAW_SQL, r, rs
from seriesloom.catalog.q_features import LABEL_SQL, labelled
from seriesloom.functions import scalars as S
from seriesloom.operators import metrics as ME
from seriesloom.operators import model as ML
from seriesloom.session import stored

_RULE = {"m1": "l_discount * 4 + l_tax", "0": "0.2 + abs(l_quantity - 25) / 50", "1": "l_tax * 6 + l_discount"}
_SCORED_SQL = f"""scored0 AS (
 SELECT year(l_shipdate) AS fold, CASE WHEN l_returnflag = 'R' THEN -1 WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS y,
  {', '.join(f'round({e}, 4) AS p_{t}' for t, e in _RULE.items())} FROM lineitem), scored AS (
 SELECT *, CASE WHEN p_1 >= p_0 AND p_1 >= p_m1 THEN 1 WHEN p_0 >= p_m1 THEN 0 ELSE -1 END AS yhat FROM scored0)"""


def _scored(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select(
        F.year("l_shipdate").alias("fold"),
        F.when(F.col("l_returnflag") == "R", -1).when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("y"),
        *[F.round(F.expr(e), 4).alias(f"p_{t}") for t, e in _RULE.items()])
    return rows.withColumn("yhat", F.expr("CASE WHEN p_1 >= p_0 AND p_1 >= p_m1 THEN 1 WHEN p_0 >= p_m1 THEN 0 ELSE -1 END"))


def _auc_sql(c, p):
    """Ranks of all rows, ties at their mean rank."""
    return f"""SELECT fold, {c} AS class, CASE WHEN sum(pos) > 0 AND sum(1 - pos) > 0 THEN
  (sum(pos * rank) - sum(pos) * (sum(pos) + 1) / 2.0) / (CAST(sum(pos) AS DOUBLE) * sum(1 - pos)) END AS auc FROM (
  SELECT fold, CAST(y = {c} AS INTEGER) AS pos,
   rank() OVER (PARTITION BY fold ORDER BY {p}) + (count(*) OVER (PARTITION BY fold, {p}) - 1) / 2.0 AS rank FROM scored) GROUP BY fold"""


_METRICS_SQL = f"""WITH {_SCORED_SQL}, aucs AS ({' UNION ALL '.join(_auc_sql(c, p) for c, p in ((-1, 'p_m1'), (0, 'p_0'), (1, 'p_1')))}),
 classes AS (SELECT DISTINCT y AS c FROM scored), rates AS (
 SELECT fold, c, count(*) FILTER (y = c) AS support, count(*) FILTER (yhat = c) AS said, count(*) FILTER (y = c AND yhat = c) AS hits
 FROM scored, classes GROUP BY fold, c)
 SELECT fold, CAST(sum(support) AS BIGINT) AS n, {rs('sum(CASE WHEN said > 0 THEN support * CAST(hits AS DOUBLE) / said ELSE 0 END) / sum(support)')} AS precision,
  {rs('CAST(sum(hits) AS DOUBLE) / sum(support)')} AS recall,
  {rs('(SELECT CASE WHEN count(auc) = 3 THEN avg(auc) END FROM aucs WHERE aucs.fold = rates.fold)')} AS auc FROM rates GROUP BY fold"""


def _metrics(spark, sf):
    return ME.fold_metrics(_scored(spark, sf), ["fold"], "y", "yhat", {-1: "p_m1", 0: "p_0", 1: "p_1"})


@query("fold_metrics", _METRICS_SQL)
def fold_metrics(spark, sf):
    return _metrics(spark, sf).select("fold", "n", *[r(c).alias(c) for c in ("precision", "recall", "auc")])


@query("mean_fold_metrics", f"""WITH m AS ({_METRICS_SQL}) SELECT {', '.join(f"{rs(f'avg({c})', 5)} AS mean_{c}" for c in ('precision', 'recall', 'auc'))} FROM m""")
def mean_fold_metrics(spark, sf):
    from seriesloom.operators.model import cv_means
    return cv_means(_metrics(spark, sf)).select(*[r(f"mean_{c}", 5).alias(f"mean_{c}") for c in ("precision", "recall", "auc")])


_FEATURES = {"quantity": "l_quantity / 50", "discount": "l_discount * 10", "tax": "l_tax * 10", "price": "l_extendedprice / 100000",
             "line": "CAST(l_linenumber AS DOUBLE)"}
_P = "1 / (1 + exp(1 - 2 * quantity + 1.5 * discount * tax - 0.5 * price))"
_ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_VARIANTS = ", ".join(f"('{f}')" for f in _FEATURES)
_IMPORTANCE_SQL = f"""WITH rows AS (
 SELECT {', '.join(_ROW)}, l_returnflag = 'R' AS y, CASE WHEN l_returnflag = 'R' THEN 3.0 ELSE 1.0 END AS weight,
  md5({" || ':' || ".join(f'CAST({k} AS VARCHAR)' for k in _ROW)} || ':42') AS hash, {', '.join(f'{e} AS {f}' for f, e in _FEATURES.items())} FROM lineitem),
 dealt AS (SELECT *, CAST('0x' || hash[1:8] AS BIGINT) % greatest(1, (SELECT count(*) FROM rows) // {ME.PARTNERS}) AS bucket FROM rows),
 placed AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY hash, {', '.join(_ROW)}) AS place, count(*) OVER (PARTITION BY bucket) AS n FROM dealt),
 paired AS (SELECT a.*, {', '.join(f'b.{f} AS o_{f}' for f in _FEATURES)} FROM placed a JOIN placed b ON b.bucket = a.bucket AND b.place = a.place % a.n + 1),
 varied AS (SELECT y, weight, v.feature, {', '.join(f"CASE WHEN v.feature = '{f}' THEN o_{f} ELSE {f} END AS {f}" for f in _FEATURES)}
  FROM paired, (VALUES (NULL), {_VARIANTS}) v(feature)),
 losses AS (SELECT feature, -sum(weight * ln(greatest(CASE WHEN y THEN {_P} ELSE 1 - {_P} END, 1e-15))) / sum(weight) AS loss FROM varied GROUP BY feature)
 SELECT feature, {rs('loss')} AS loss, {rs('(SELECT loss FROM losses WHERE feature IS NULL)')} AS base_loss,
  {rs('loss - (SELECT loss FROM losses WHERE feature IS NULL)')} AS worse FROM losses WHERE feature IS NOT NULL"""


@query("permutation_importance", _IMPORTANCE_SQL)
def permutation_importance(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select(*_ROW, (F.col("l_returnflag") == "R").alias("y"),
                                                  *[F.expr(e).alias(f) for f, e in _FEATURES.items()])

    def score(df):
        return df.withColumn("p_true", F.when(F.col("y"), F.expr(_P)).otherwise(1 - F.expr(_P)))

    found = ME.permutation_importance(rows, _ROW, list(_FEATURES), score,
                                      F.when(F.col("y"), 3.0).otherwise(1.0))
    return found.select("feature", *[r(c).alias(c) for c in ("loss", "base_loss", "worse")])


# --- which rows are scored and trained on ---------------------------------------------------

_UNTIL = dt.date(2000, 6, 30)
_GIVEN = {"1": "coalesce(floor_native - floor(floor_native), 0.5)", "0": "0.45", "m1": "coalesce(floor_usd - floor(floor_usd), 0.5)"}


@query("signals_given_scores", f"""WITH {RAW_SQL}, latest AS (SELECT collection_identifier, chain, max(date) AS date,
  {', '.join(f"first({c} ORDER BY date DESC, {c} DESC) FILTER ({c} IS NOT NULL) AS {c}" for c in ('slug', 'floor_native', 'floor_usd'))}
  FROM raw WHERE date <= DATE '{_UNTIL}' GROUP BY 1, 2), p AS (SELECT *, {', '.join(f'{e} AS p_{t}' for t, e in _GIVEN.items())} FROM latest)
 SELECT collection_identifier, chain, slug, date, CASE WHEN p_1 >= p_0 AND p_1 >= p_m1 THEN 'BUY' WHEN p_0 >= p_m1 THEN 'HOLD' ELSE 'SELL' END AS signal,
  round(greatest(p_1, p_0, p_m1), 6) AS confidence FROM p""")
def signals_given_scores(spark, sf):
    rows = ML.latest_rows(fx.raw_prices(spark, sf).select("collection_identifier", "chain", "slug", "date", "floor_native", "floor_usd"), _UNTIL)
    rows = ML.chosen_class(rows.withColumns({f"p_{t}": F.expr(e).cast("double") for t, e in _GIVEN.items()}))
    return rows.select("collection_identifier", "chain", "slug", "date", S.signal_text("predicted").alias("signal"),
                       F.round("confidence", 6).alias("confidence"))


_CUTOFF = dt.date(2000, 12, 31)


@query("training_rows_until", f"""WITH {LABEL_SQL}, chosen AS (
  SELECT label_binary AS label, CAST(DATE '1970-01-01' + day AS DATE) AS date FROM labelled WHERE label_binary IS NOT NULL AND day <= DATE '{_CUTOFF}' - DATE '1970-01-01'),
 days AS (SELECT date, count(*) AS n FROM chosen GROUP BY 1), sums AS (SELECT date, sum(n) OVER (ORDER BY date) AS upto, n FROM days),
 cut AS (SELECT min(date) AS d FROM sums WHERE upto > 0.9 * (SELECT count(*) FROM chosen) AND upto > n),
 flagged AS (SELECT *, date >= (SELECT d FROM cut) AS is_val FROM chosen),
 c AS (SELECT label, count(*) AS n FROM flagged WHERE NOT is_val GROUP BY 1)
 SELECT f.label, is_val, count(*) AS n, min(date) AS first_day, max(date) AS last_day,
  {rs('(SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * CAST(any_value(c.n) AS DOUBLE))')} AS weight
 FROM flagged f LEFT JOIN c ON c.label = f.label GROUP BY 1, 2""")
def training_rows_until(spark, sf):
    rows = labelled(spark, sf).filter(F.col("label_binary").isNotNull() & (F.col("date") <= F.lit(_CUTOFF)))
    # Count, cut, weights and the rows themselves each read them: labelled once.
    rows = stored(rows.select("collection_identifier", "chain", "date", "label_binary"), "labelled")
    chosen = ML.training_rows(rows, "label_binary", 0.9, 1 << 40)
    return chosen.groupBy(F.col("label_binary").alias("label"), "is_val").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day"), r(F.max("weight")).alias("weight"))
