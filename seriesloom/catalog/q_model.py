"""Model queries: fold bounds with SQL, the rest checked by row counts and by tests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from seriesloom import fixtures as fx
from seriesloom.catalog import query
from seriesloom.catalog.base import panel_sql
from seriesloom.catalog.q_features import full_panel
from seriesloom.operators import model as ML
from seriesloom.operators.labels import add_labels
from seriesloom.plans import reports as R
from seriesloom.session import stored

_FOLDS = f"""WITH {panel_sql('p_type')}, s AS (SELECT min(date) AS lo, max(date) AS hi FROM panel),
 step AS (SELECT lo, hi, greatest(30, (hi - lo - 180) // 5) AS st FROM s),
 f AS (SELECT CAST(i + 1 AS INTEGER) AS fold, CAST(lo + CAST(180 + i * st AS INTEGER) AS DATE) AS train_end,
  CAST(lo + CAST(180 + (i + 1) * st AS INTEGER) AS DATE) AS test_end, hi FROM step, range(5) r(i))
 SELECT *, CASE WHEN n_train >= 100 AND n_test >= 10 THEN 'used' ELSE 'few rows' END AS status FROM (
  SELECT fold, train_end, test_end, (SELECT count(*) FROM panel WHERE date <= train_end) AS n_train,
   (SELECT count(*) FROM panel WHERE date > train_end AND date <= test_end) AS n_test FROM f WHERE test_end <= hi)"""


@query("walk_forward_folds", _FOLDS)
def walk_forward_folds(spark, sf):
    return ML.fold_counts(fx.panel(spark, sf, "p_type").select("date"))


def _rows(spark, sf):
    return add_labels(full_panel(spark, sf, "p_type", min_days=60), 14, 0.10, 0.10)


@query("signals_binary")
def signals_binary(spark, sf):
    rows = stored(_rows(spark, sf), "labelled")
    return ML.score(ML.train_final(rows, ML.BINARY), rows)


@query("signals_three_way")
def signals_three_way(spark, sf):
    rows = stored(_rows(spark, sf), "labelled")
    return ML.score(ML.train_final(rows, ML.THREE, dt.date(2001, 1, 1)), rows, dt.date(2001, 6, 30))


@query("walk_forward_cv")
def walk_forward_cv(spark, sf):
    return ML.walk_forward_cv(stored(_rows(spark, sf), "labelled"), ML.BINARY, 5)


@query("cv_means")
def cv_means(spark, sf):
    return ML.cv_means(ML.walk_forward_cv(stored(_rows(spark, sf), "labelled"), ML.BINARY, 5))


@query("feature_importance")
def feature_importance(spark, sf):
    rows = stored(_rows(spark, sf), "labelled")
    return ML.importance(ML.train_final(rows, ML.BINARY), rows, ["collection_identifier", "chain", "date"])


@query("swapped_importance")
def swapped_importance(spark, sf):
    rows = stored(_rows(spark, sf), "labelled")
    return ML.swapped_importance(ML.train_final(rows, ML.BINARY), rows, ["collection_identifier", "chain", "date"])


_SIG = """sig AS (SELECT l_orderkey, l_linenumber, CAST(l_orderkey AS VARCHAR) AS collection_identifier, CAST(l_linenumber AS VARCHAR) AS chain,
 CASE WHEN l_tax < 0.03 THEN 'BUY' WHEN l_tax < 0.06 THEN 'HOLD' ELSE 'SELL' END AS signal, l_quantity / 50.0 AS confidence FROM lineitem)"""


def _signals(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    kind = F.when(F.col("l_tax") < 0.03, "BUY").when(F.col("l_tax") < 0.06, "HOLD").otherwise("SELL")
    return li.select(F.col("l_orderkey").cast("string").alias("collection_identifier"),
                     F.col("l_linenumber").cast("string").alias("chain"), kind.alias("signal"),
                     (F.col("l_quantity") / 50.0).alias("confidence"))


query("signal_report", f"WITH {_SIG} SELECT signal, confidence FROM sig WHERE signal = 'BUY' AND confidence >= 0.6 ORDER BY confidence DESC LIMIT 15")(
    lambda spark, sf: R.signal_report(_signals(spark, sf)).select("signal", "confidence"))
query("signals_confident_buy", f"WITH {_SIG} SELECT collection_identifier, chain, confidence FROM sig WHERE signal = 'BUY' AND confidence >= 0.6")(
    lambda spark, sf: R.confident_buys(_signals(spark, sf), 0.6).drop("signal"))
query("signal_totals", f"WITH {_SIG} SELECT count(*) AS tracked, count(*) FILTER (signal = 'BUY') AS buy, count(*) FILTER (signal = 'HOLD') AS hold, count(*) FILTER (signal = 'SELL') AS sell FROM sig")(
    lambda spark, sf: R.signal_totals(_signals(spark, sf)))
