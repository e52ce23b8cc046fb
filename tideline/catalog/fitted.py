"""Queries over fitted step functions, forests taken apart into tables, smoothing and models per key."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog.assessment import _HOLD, SUP
from tideline.catalog.learning import DEPTH, ITER, _alert, _binary_report, _parts, learning_table
from tideline.catalog.registry import query
from tideline.catalog.tables import (
    PANEL_SQL,
    PREDICTIONS_SQL,
    SPARSE_SQL,
    WEEKLY_SERIES,
    WEEKLY_SQL,
    predictions,
    sparse,
    supervised,
    weekly,
)
from tideline.operators import evaluation as V
from tideline.operators import models as M
from tideline.operators import splits as L
from tideline.operators import trees as T
from tideline.operators.isotonic import apply_isotonic, fit_isotonic
from tideline.operators.keyed_models import fit_linear_per_key, fit_logistic_per_key, logistic, score_per_key
from tideline.operators.quantile_forest import fit_quantile_forest
from tideline.operators.smoothing import fit_smoothing, smoothing_holdout
from tideline.session import cut_lineage
from tideline.sources.schema import select_features

# ---- isotonic regression -----------------------------------------------------

# A row's outcome is drawn by its keys, so that higher scores hold more ones; whole numbers decide.
_DRAWN = """drawn AS (
  SELECT site, p_alert, CASE WHEN (l_orderkey * 31 + l_linenumber * 17) % 97 < FLOOR(97 * p_alert) THEN 1 ELSE 0 END AS y,
         1 + l_linenumber % 2 AS w
  FROM predictions)"""

# The fitted value of a score: the largest, over starts up to it, of the least mean from there to any end from it on.
_FITTED = """points AS (
  SELECT site, p_alert AS x, SUM(w) AS w, SUM(w * y) AS s, ROW_NUMBER() OVER (PARTITION BY site ORDER BY p_alert) AS i
  FROM drawn GROUP BY site, p_alert),
sums AS (SELECT site, x, w, i, SUM(w) OVER c AS cw, SUM(s) OVER c AS cs, SUM(w) OVER c - w AS bw, SUM(s) OVER c - s AS bs
  FROM points WINDOW c AS (PARTITION BY site ORDER BY i)),
runs AS (SELECT a.site, a.i AS j, b.i AS k, CAST(b.cs - a.bs AS DOUBLE) / CAST(b.cw - a.bw AS DOUBLE) AS m
  FROM sums a JOIN sums b ON a.site = b.site AND a.i <= b.i),
lows AS (SELECT site, j, k AS i, MIN(m) OVER (PARTITION BY site, j ORDER BY k DESC) AS low FROM runs),
fitted AS (SELECT site, i, MAX(low) AS v FROM lows GROUP BY 1, 2),
blocks AS (SELECT site, MIN(x) AS lo, MAX(x) AS hi, v, SUM(w) AS w FROM fitted JOIN sums USING (site, i) GROUP BY site, v)"""

_ISO = (PREDICTIONS_SQL, _DRAWN, _FITTED)


def _drawn(spark, sf):
    ticket = F.pmod(F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17, F.lit(97))
    y = F.when(ticket < F.floor(97 * F.col("p_alert")), 1).otherwise(0)
    return predictions(spark, sf).select("site", "p_alert", y.alias("y"), (1 + F.col("l_linenumber") % 2).alias("w"))


@query("isotonic_blocks", "SELECT site, lo, hi, ROUND(v, 9) AS value, CAST(w AS DOUBLE) AS weight FROM blocks", _ISO)
def _isotonic_blocks(spark, sf):
    blocks = fit_isotonic(_drawn(spark, sf), "p_alert", "y", "w", by=["site"])
    return blocks.withColumn("value", F.round("value", 9))


@query(
    "isotonic_scores",
    """SELECT site, q, ROUND(CASE WHEN a.x IS NULL THEN b.v WHEN b.x IS NULL OR a.x = q THEN a.v
                                 ELSE a.v + (b.v - a.v) / (b.x - a.x) * (q - a.x) END, 9) AS calibrated
       FROM asked LEFT JOIN LATERAL (SELECT x, v FROM knots k WHERE k.site = asked.site AND x <= q ORDER BY x DESC, v DESC LIMIT 1) a ON TRUE
       LEFT JOIN LATERAL (SELECT x, v FROM knots k WHERE k.site = asked.site AND x > q ORDER BY x, v LIMIT 1) b ON TRUE""",
    (
        *_ISO,
        "knots AS (SELECT site, lo AS x, v FROM blocks UNION SELECT site, hi, v FROM blocks)",
        "asked AS (SELECT DISTINCT site, FLOOR(p_alert * 997) / 991 AS q FROM predictions)",
    ),
)
def _isotonic_scores(spark, sf):
    d = _drawn(spark, sf)
    blocks = fit_isotonic(d, "p_alert", "y", "w", by=["site"])
    asked = d.select("site", (F.floor(F.col("p_alert") * 997) / 991).alias("q")).distinct()
    scored = apply_isotonic(asked, blocks, "q", "c", by=["site"])
    return scored.select("site", "q", F.round("c", 9).alias("calibrated"))


# ---- attribution, dependence and interaction from node tables ----------------


@query(
    "attribution_adds_up",
    "SELECT COUNT(*) AS n, COUNT(*) AS n_equal FROM held WHERE split = 'test'",
    (*SUP, _HOLD),
)
def _adds_up(spark, sf):
    """Rows whose contributions and base are the prediction of a boosted model to nine digits."""
    d, feats = learning_table(spark, sf)
    train, test = _parts(d)
    model = M.fit_gbt_regressor(train, feats, "y_log", ITER, DEPTH)
    parts = T.attribute(model, test, feats, ["key", "week_start"]).groupBy("key", "week_start").agg(F.sum("contribution").alias("sum"))
    base = T.bases(T.leaf_paths(T.node_table(model))).select("base")
    scored = M.score(model, test, pred="p").select("key", "week_start", "p")
    met = scored.join(parts, ["key", "week_start"], "left").join(F.broadcast(base), how="left")
    off = F.abs(F.col("base") + F.coalesce("sum", F.lit(0.0)) - F.col("p"))
    return met.agg(F.count(F.lit(1)).alias("n"), F.count_if(off < 1e-9).alias("n_equal"))


@query("ml_attribution_by_class")
def _by_class(spark, sf):
    """Mean contribution to each stage's probability, over all test rows and over alert and other rows."""
    d, feats = learning_table(spark, sf)
    train, test = _parts(d)
    model = M.fit_forest(L.class_weights(train, "y3", name="w"), feats, "y3", weight="w", trees=100, depth=10)
    test = cut_lineage(test)
    split = T.mean_attribution(model, test, feats, by=["y_alert"])
    whole = T.mean_attribution(model, test, feats).withColumn("y_alert", F.lit(None).cast("int"))
    return split.unionByName(whole)


@query("ml_attribution_summary")
def _summary(spark, sf):
    """Mean and mean absolute contribution to the margin of the boosted alert model, by true class."""
    d, feats = learning_table(spark, sf)
    train, test = _parts(d)
    model = _alert(train, feats)
    each = T.attribute(model, test, feats, ["key", "week_start"]).join(test.select("key", "week_start", "y_alert"), ["key", "week_start"])
    sums = each.groupBy("y_alert", "feature").agg(F.sum("contribution").alias("s"), F.sum(F.abs("contribution")).alias("a"))
    sizes = test.groupBy(F.col("y_alert").alias("y")).agg(F.count(F.lit(1)).alias("rows"))
    met = sums.join(F.broadcast(sizes), F.col("y_alert").eqNullSafe(F.col("y")))
    return met.select("y_alert", "feature", (F.col("s") / F.col("rows")).alias("mean"), (F.col("a") / F.col("rows")).alias("mean_abs"))


@query("ml_partial_dependence_all_features")
def _dependence(spark, sf):
    """Twenty points of every feature, from one pass over the rows."""
    d, feats = learning_table(spark, sf)
    train, _ = _parts(d)
    model = M.fit_gbt_regressor(train, feats, "y_log", ITER, DEPTH)
    return T.partial_dependence(model, train, feats, T.even_grid(train, feats, points=20))


@query("ml_pair_interaction_of_paths")
def _interaction(spark, sf):
    d, feats = learning_table(spark, sf)
    train, test = _parts(d)
    model = M.fit_gbt_regressor(train, feats, "y_log", ITER, DEPTH)
    return T.interactions(model, test, feats, T.even_grid(train, feats, points=6), top=12)


@query("ml_quantile_forest_bands")
def _forest_bands(spark, sf):
    d, feats = learning_table(spark, sf)
    train, test = _parts(d)
    ids = ["key", "week_start"]
    bands = fit_quantile_forest(train, feats, "y_log", trees=100, depth=8, min_rows=20)(test, ids)
    return V.interval_metrics(bands.join(test.select(*ids, "y_log"), ids), "y_log", "q10", "q50", "q90")


# ---- smoothing ---------------------------------------------------------------

_FACTORS = (0.0, 0.05, 0.2, 0.5, 1.0)


@query(
    "smoothing_profile",
    """SELECT key, tag AS "at", factor, n, ROUND(q / p + mean, 3) AS start, ROUND(SQRT(GREATEST(r - q * q / p, 0) / n), 3) AS rmse,
              ROUND(a * (q / p) + b + mean, 3) AS forecast
       FROM walk JOIN (SELECT key, COUNT(*) AS n, AVG(v) AS mean FROM steps GROUP BY key) USING (key) WHERE i = n""",
    (
        PANEL_SQL,
        WEEKLY_SQL,
        "steps AS (SELECT key, ROW_NUMBER() OVER (PARTITION BY key ORDER BY week_start) AS i, top_max AS v, AVG(top_max) OVER (PARTITION BY key) AS m FROM weekly)",
        """walk AS (
         WITH RECURSIVE w AS (
           SELECT key, CAST(0 AS BIGINT) AS i, tag, factor, CAST(1 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS q, CAST(0 AS DOUBLE) AS r
           FROM (SELECT DISTINCT key FROM steps), (SELECT UNNEST([0, 1, 2, 3, 4]) AS tag, UNNEST([0, 0.05, 0.2, 0.5, 1]::DOUBLE[]) AS factor)
           UNION ALL
           SELECT w.key, s.i, tag, factor, (1 - factor) * a, b + factor * (s.v - s.m - b), p + a * a, q + a * (s.v - s.m - b), r + (s.v - s.m - b) * (s.v - s.m - b)
           FROM w JOIN steps s ON s.key = w.key AND s.i = w.i + 1)
         SELECT * FROM w)""",
    ),
)
def _profile(spark, sf):
    found = fit_smoothing(weekly(spark, sf), WEEKLY_SERIES, "top_max", _FACTORS)
    rmse = F.round(F.sqrt(F.col("error") / F.col("n")), 3).alias("rmse")
    return found.select("key", "at", "factor", "n", F.round("start", 3).alias("start"), rmse, F.round("forecast", 3).alias("forecast"))


@query("ml_smoothing_estimated")
def _estimated(spark, sf):
    """Hold-out errors of the fitted forecast and of the previous value per key."""
    return smoothing_holdout(weekly(spark, sf), WEEKLY_SERIES, "top_max")


# ---- one model per key -------------------------------------------------------


@query(
    "linear_model_per_key",
    """SELECT cust, COUNT(*) AS n, ROUND(regr_intercept(v, x), 2) AS intercept, ROUND(regr_slope(v, x), 5) AS slope
       FROM (SELECT cust, v, CAST(day - DATE '1995-01-01' AS DOUBLE) AS x FROM sparse) GROUP BY cust HAVING COUNT(DISTINCT x) > 1""",
    (SPARSE_SQL,),
)
def _linear(spark, sf):
    """A trend line per customer."""
    d = sparse(spark, sf).withColumn("x", F.datediff("day", F.to_date(F.lit("1995-01-01"))).cast("double"))
    models = fit_linear_per_key(d, "cust", ["x"], "v")
    single = d.groupBy("cust").agg(F.count_distinct("x").alias("days")).where("days > 1").select("cust")
    kept = models.join(single, "cust", "left_semi")
    return kept.select("cust", "n", F.round("intercept", 2).alias("intercept"), F.round("x", 5).alias("slope"))


@query("ml_logistic_per_key")
def _logistic(spark, sf):
    """Alert models of every key, fitted together, and their pooled test scores."""
    d, feats = learning_table(spark, sf)
    train, test = _parts(d)
    models = fit_logistic_per_key(train, "key", feats, "alert", penalty=1.0)
    return _binary_report(score_per_key(test, models, "key", feats, "p", logistic), "p")


# ---- feature selection -------------------------------------------------------


@query(
    "selected_features",
    """SELECT name AS feature, COUNT(v) AS n, MAX(v) AS largest
       FROM chosen UNPIVOT INCLUDE NULLS (v FOR name IN (COLUMNS(*))) WHERE name NOT LIKE '%std%' GROUP BY name""",
    (*SUP, "chosen AS (SELECT COLUMNS('^lw(4|2|1)_')::DOUBLE FROM supervised)"),
)
def _selected(spark, sf):
    """The features that rules on names and types choose, with what they hold."""
    d = supervised(spark, sf)
    names = select_features(d, prefixes=("lw4_", "lw2_", "lw1_"), without=["std"])
    cells = [F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), F.max(F.col(c).cast("double")).alias("largest")) for c in names]
    return d.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
