"""Splits, weights, sampling and evaluation queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog.registry import query
from tideline.catalog.series import SUPERVISED_SQL
from tideline.catalog.tables import (
    PANEL_SQL,
    PREDICTIONS_SQL,
    SPARSE,
    SPARSE_SQL,
    WEEKLY_SERIES,
    WEEKLY_SQL,
    panel,
    predictions,
    read,
    sparse,
    supervised,
    weekly,
)
from tideline.fixed_values import CLASS_BOOST
from tideline.functions.calendar import season_label
from tideline.operators import conformal as C
from tideline.operators import evaluation as V
from tideline.operators import splits as L
from tideline.operators import thresholds as Th
from tideline.operators.baselines import ses_baseline
from tideline.operators.models import argmax_class, average_probs, compose_probs, decide_two_stage

SUP = (PANEL_SQL, WEEKLY_SQL, SUPERVISED_SQL)

# ---- splits and weights ------------------------------------------------------

_HOLD = """held AS (
  SELECT *, CASE WHEN week_start <= (SELECT d FROM (SELECT week_start AS d, ROW_NUMBER() OVER (ORDER BY week_start) AS i, COUNT(*) OVER () AS n
                                                     FROM (SELECT DISTINCT week_start FROM supervised))
                                     WHERE i = GREATEST(CAST(FLOOR(n * (1.0::DOUBLE - 0.15::DOUBLE)) AS BIGINT), 1)) THEN 'train' ELSE 'test' END AS split FROM supervised)"""


@query("time_holdout", "SELECT key, week_start, split FROM held", (*SUP, _HOLD))
def _holdout(spark, sf):
    return L.time_holdout(supervised(spark, sf), "week_start").select("key", "week_start", "split")


@query(
    "fixed_date_split",
    """SELECT CASE WHEN day < DATE '1999-01-01' THEN 'train' WHEN day < DATE '2000-01-01' THEN 'val' ELSE 'test' END AS split,
              COUNT(*) AS n, COUNT(*) FILTER (WHERE truth = 0) AS n_0, COUNT(*) FILTER (WHERE truth = 1) AS n_1, COUNT(*) FILTER (WHERE truth = 2) AS n_2
       FROM predictions GROUP BY 1""",
    (PREDICTIONS_SQL,),
)
def _fixed_split(spark, sf):
    d = L.split_by_dates(predictions(spark, sf), "day", "1999-01-01", "2000-01-01")
    return L.split_summary(d, "split", "truth", [0, 1, 2])


@query(
    "tail_split_per_key",
    """SELECT order_id, CASE WHEN p < FLOOR(n * 0.85::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM (
         SELECT order_id, ROW_NUMBER() OVER (PARTITION BY cust ORDER BY day, order_id) - 1 AS p, COUNT(*) OVER (PARTITION BY cust) AS n FROM sparse)""",
    (SPARSE_SQL,),
)
def _tail(spark, sf):
    return L.tail_split(sparse(spark, sf), SPARSE, 0.15).select("order_id", "split")


@query(
    "expanding_folds",
    """SELECT order_id, CAST(CASE WHEN p < n - 3 * size THEN 0 ELSE (p - (n - 3 * size)) // size + 1 END AS INTEGER) AS fold FROM (
         SELECT order_id, ROW_NUMBER() OVER (ORDER BY day, cust, order_id) - 1 AS p, COUNT(*) OVER () AS n, COUNT(*) OVER () // 4 AS size FROM sparse)""",
    (SPARSE_SQL,),
)
def _folds(spark, sf):
    return L.expanding_folds(sparse(spark, sf), SPARSE, 3).select("order_id", "fold")


@query(
    "class_weights_boosted",
    """SELECT truth, SUM(n) OVER () / (COUNT(*) OVER () * n) * CASE WHEN truth = 2 THEN 3 ELSE 1 END AS weight
       FROM (SELECT truth, COUNT(*) AS n FROM predictions GROUP BY 1)""",
    (PREDICTIONS_SQL,),
)
def _class_weights(spark, sf):
    return L.class_weight_table(predictions(spark, sf), "truth", {2: CLASS_BOOST})


@query(
    "year_class_weights",
    """SELECT y, truth, COUNT(*) AS n, ROUND(MAX(w) / MAX(m), 9) AS weight FROM (
         SELECT *, AVG(w) OVER () AS m FROM (
           SELECT CAST(year(day) AS INTEGER) AS y, truth, cw * CASE year(day) WHEN 1997 THEN 2.0 WHEN 1999 THEN 1.5 ELSE 1.0 END AS w
           FROM predictions JOIN (SELECT truth, SUM(n) OVER () / (COUNT(*) OVER () * n) * CASE WHEN truth = 2 THEN 3 ELSE 1 END AS cw
                                  FROM (SELECT truth, COUNT(*) AS n FROM predictions GROUP BY 1)) USING (truth))) GROUP BY 1, 2""",
    (PREDICTIONS_SQL,),
)
def _year_weights(spark, sf):
    d = L.year_class_weights(
        predictions(spark, sf), "truth", F.year("day"), {1997: 2.0, 1999: 1.5}, 1.0, {2: CLASS_BOOST}
    )
    return d.groupBy(F.year("day").alias("y"), "truth").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("weight"), 9).alias("weight")
    )


@query(
    "positive_weight_ratio",
    """SELECT CAST(GREATEST(COUNT(*) FILTER (WHERE y_alert = 0), 1) AS DOUBLE) / GREATEST(COUNT(*) FILTER (WHERE y_alert = 1), 1) AS scale_pos_weight
       FROM supervised""",
    SUP,
)
def _spw(spark, sf):
    return L.scale_pos_weight(supervised(spark, sf), "y_alert")


def _over_sql(want: str) -> str:
    return f"""SELECT order_id, y, CAST(UNNEST(range(1, copies + 1)) AS INTEGER) AS copy FROM (
      SELECT order_id, y, CASE WHEN y <> 2 THEN 1 ELSE want // n + CASE WHEN r < want % n THEN 1 ELSE 0 END END AS copies FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY y ORDER BY md5(order_id || ':42')) - 1 AS r, GREATEST({want}, n) AS want
        FROM (SELECT order_id, v, y, COUNT(*) FILTER (WHERE y = 2) OVER () AS n, COUNT(*) FILTER (WHERE y <> 2) OVER () AS rest FROM (
          SELECT order_id, v, CASE WHEN v >= 490000 THEN 2 WHEN v >= 250000 THEN 1 ELSE 0 END AS y FROM sparse))))"""


def _classes(spark, sf):
    from tideline.functions.stages import stage_from_value

    return sparse(spark, sf).select("order_id", stage_from_value(F.col("v"), [250_000, 490_000]).alias("y"))


@query("oversample_to_target", _over_sql("1000"), (SPARSE_SQL,))
def _oversample(spark, sf):
    return L.oversample(_classes(spark, sf), "y", 2, ["order_id"], target=1000)


@query("oversample_to_ratio", _over_sql("CAST(FLOOR(rest * 0.3::DOUBLE) AS BIGINT)"), (SPARSE_SQL,))
def _oversample_ratio(spark, sf):
    return L.oversample(_classes(spark, sf), "y", 2, ["order_id"], ratio=0.3)


@query("sample_rows", "SELECT order_id, v FROM sparse ORDER BY md5(order_id || ':7') LIMIT 500", (SPARSE_SQL,))
def _sample(spark, sf):
    return L.sample_rows(sparse(spark, sf), 500, ["order_id"], seed=7).select("order_id", "v")


# ---- class metrics -----------------------------------------------------------


@query(
    "confusion_matrix",
    """SELECT truth, pred, COALESCE(n, 0) AS n FROM (SELECT UNNEST([0, 1, 2]) AS truth) CROSS JOIN (SELECT UNNEST([0, 1, 2]) AS pred)
       LEFT JOIN (SELECT truth, pred, COUNT(*) AS n FROM predictions GROUP BY 1, 2) USING (truth, pred)""",
    (PREDICTIONS_SQL,),
)
def _confusion(spark, sf):
    return V.confusion(predictions(spark, sf), "truth", "pred", [0, 1, 2])


@query(
    "class_report",
    """SELECT label, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0 END AS "precision",
              CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0 END AS recall,
              CASE WHEN support + predicted > 0 THEN 2.0::DOUBLE * tp / (support + predicted) ELSE 0 END AS f1, support, predicted
       FROM (SELECT label, COUNT(*) FILTER (WHERE truth = label AND pred = label) AS tp, COUNT(*) FILTER (WHERE truth = label) AS support,
                    COUNT(*) FILTER (WHERE pred = label) AS predicted
             FROM predictions CROSS JOIN (SELECT UNNEST([0, 1, 2, 3]) AS label) GROUP BY 1)""",
    (PREDICTIONS_SQL,),
)
def _report(spark, sf):
    return V.class_report(predictions(spark, sf), "truth", "pred", [0, 1, 2, 3])


def _metrics_sql(by: str, table: str = "predictions", min_n: int = 1) -> str:
    """Alert metrics per group; ``by`` ends with a comma where it is not empty."""
    group = f"GROUP BY {by.rstrip(', ')}" if by else ""
    cells = ", ".join(
        f"CAST(COUNT(*) FILTER (WHERE truth = {c} AND pred = {c}) AS DOUBLE) AS tp{c}, CAST(COUNT(*) FILTER (WHERE truth = {c}) AS DOUBLE) AS t{c}, "
        f"CAST(COUNT(*) FILTER (WHERE pred = {c}) AS DOUBLE) AS p{c}"
        for c in (0, 1, 2)
    )
    f1 = {c: f"(CASE WHEN t{c} + p{c} > 0 THEN 2.0::DOUBLE * tp{c} / (t{c} + p{c}) ELSE 0::DOUBLE END)" for c in (0, 1, 2)}
    seen = " + ".join(f"CASE WHEN t{c} + p{c} > 0 THEN 1 ELSE 0 END" for c in (0, 1, 2))
    return f"""SELECT {by} n, ok / n AS accuracy, ({' + '.join(f1.values())}) / ({seen}) AS macro_f1,
        ({' + '.join(f'{f1[c]} * t{c}' for c in f1)}) / (t0 + t1 + t2) AS weighted_f1,
        CASE WHEN ap > 0 THEN atp / ap ELSE 0 END AS alert_precision, CASE WHEN at_ > 0 THEN atp / at_ ELSE 0 END AS alert_recall,
        CASE WHEN at_ + ap > 0 THEN 2.0::DOUBLE * atp / (at_ + ap) ELSE 0 END AS alert_f1, CASE WHEN t2 > 0 THEN tp2 / t2 END AS top_recall
      FROM (SELECT {by} COUNT(*) AS n, CAST(COUNT(*) FILTER (WHERE truth = pred) AS DOUBLE) AS ok, {cells},
                   CAST(COUNT(*) FILTER (WHERE truth >= 1 AND pred >= 1) AS DOUBLE) AS atp, CAST(COUNT(*) FILTER (WHERE truth >= 1) AS DOUBLE) AS at_,
                   CAST(COUNT(*) FILTER (WHERE pred >= 1) AS DOUBLE) AS ap
            FROM {table} {group}) WHERE n >= {min_n}"""


@query("alert_metrics", _metrics_sql(""), (PREDICTIONS_SQL,))
def _alert(spark, sf):
    return V.alert_metrics(predictions(spark, sf), "truth", "pred")


@query("metrics_by_site", _metrics_sql("site, ", min_n=3), (PREDICTIONS_SQL,))
def _by_site(spark, sf):
    return V.alert_metrics(predictions(spark, sf), "truth", "pred", by=["site"], min_n=3)


@query(
    "metrics_by_season",
    _metrics_sql(
        "season, ",
        "(SELECT *, CASE (month(day) % 12) // 3 WHEN 0 THEN '겨울' WHEN 1 THEN '봄' WHEN 2 THEN '여름' ELSE '가을' END AS season FROM predictions)",
        2,
    ),
    (PREDICTIONS_SQL,),
)
def _by_season(spark, sf):
    d = predictions(spark, sf).withColumn("season", season_label(F.month("day")))
    return V.alert_metrics(d, "truth", "pred", by=["season"], min_n=2)


@query(
    "metrics_by_year",
    _metrics_sql("year, ", "(SELECT *, CAST(year(day) AS INTEGER) AS year FROM predictions)"),
    (PREDICTIONS_SQL,),
)
def _by_year(spark, sf):
    d = predictions(spark, sf).withColumn("year", F.year("day"))
    return V.alert_metrics(d, "truth", "pred", by=["year"])


@query(
    "metrics_by_level_tertile",
    _metrics_sql(
        "bucket, ",
        """(SELECT *, CASE WHEN level <= (SELECT quantile_cont(level, 0.33) FROM predictions) THEN 'low'
                           WHEN level <= (SELECT quantile_cont(level, 0.66) FROM predictions) THEN 'mid' ELSE 'high' END AS bucket FROM predictions)""",
        2,
    ),
    (PREDICTIONS_SQL,),
)
def _by_tertile(spark, sf):
    d = V.level_tertiles(predictions(spark, sf), "level")
    return V.alert_metrics(d, "truth", "pred", by=["bucket"], min_n=2)


@query(
    "boundary_mask_f1",
    """SELECT 2.0::DOUBLE * COUNT(*) FILTER (WHERE truth = 2 AND pred = 2) / (COUNT(*) FILTER (WHERE truth = 2) + COUNT(*) FILTER (WHERE pred = 2)) AS f1
       FROM predictions""",
    (PREDICTIONS_SQL,),
)
def _mask(spark, sf):
    return V.mask_f1(predictions(spark, sf), "truth", "pred", 2)


def _auc_sql(by: str) -> str:
    part = f"PARTITION BY {by.rstrip(', ')}" if by else ""
    group = f"GROUP BY {by.rstrip(', ')}" if by else ""
    return f"""SELECT {by} ROUND(SUM(pos * (before_neg + neg / 2.0::DOUBLE)) / (SUM(pos)::DOUBLE * SUM(neg)), 9) AS auc FROM (
      SELECT {by} s, pos, neg, COALESCE(SUM(neg) OVER ({part} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_neg FROM (
        SELECT {by} s, CAST(COUNT(*) FILTER (WHERE y = 1) AS DOUBLE) AS pos, CAST(COUNT(*) FILTER (WHERE y = 0) AS DOUBLE) AS neg FROM scored GROUP BY {by} s)) {group}"""


_SCORED = "scored AS (SELECT site, CASE WHEN truth >= 1 THEN 1 ELSE 0 END AS y, p_alert AS s FROM predictions)"


@query("roc_auc", _auc_sql(""), (PREDICTIONS_SQL, _SCORED))
def _auc(spark, sf):
    d = predictions(spark, sf).withColumn("y", (F.col("truth") >= 1).cast("int"))
    return V.roc_auc(d, "y", "p_alert").select(F.round("auc", 9).alias("auc"))


@query("roc_auc_by_site", _auc_sql("site, "), (PREDICTIONS_SQL, _SCORED))
def _auc_site(spark, sf):
    d = predictions(spark, sf).withColumn("y", (F.col("truth") >= 1).cast("int"))
    return V.roc_auc(d, "y", "p_alert", by=["site"]).withColumn("auc", F.round("auc", 9))


@query(
    "roc_auc_label_quality",
    _auc_sql(""),
    ("scored AS (SELECT quality AS y, CAST(n_chars AS DOUBLE) AS s FROM labels JOIN documents USING (doc_id))",),
)
def _auc_labels(spark, sf):
    d = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("s")), "doc_id")
    return V.roc_auc(d, "quality", "s").select(F.round("auc", 9).alias("auc"))


@query(
    "regression_metrics",
    """SELECT key, COUNT(*) AS n, ROUND(1 - SUM((y - p) * (y - p)) / (VAR_POP(y) * COUNT(*)), 6) AS r2, ROUND(AVG(ABS(y - p)), 6) AS mae_log,
              ROUND(AVG(ABS((exp(y) - 1) - GREATEST(exp(p) - 1, 0))), 2) AS mae_raw, ROUND(SQRT(AVG((y - p) * (y - p))), 6) AS rmse_log
       FROM (SELECT key, ln(1 + y_max) AS y, ln(1 + lw2_mean_top_max) AS p FROM supervised) GROUP BY 1""",
    SUP,
)
def _regression(spark, sf):
    d = supervised(spark, sf).select("key", F.log1p("y_max").alias("y"), F.log1p("lw2_mean_top_max").alias("p"))
    out = V.regression_metrics(d, "y", "p", by=["key"])
    return out.select(
        "key", "n", *[F.round(c, 6).alias(c) for c in ["r2", "mae_log", "rmse_log"]], F.round("mae_raw", 2).alias("mae_raw")
    )


_SWEEP_FROM = """SELECT {by} lo.t AS threshold, COUNT(*) FILTER (WHERE y = 1 AND s >= lo.t) AS tp, COUNT(*) FILTER (WHERE y = 0 AND s < lo.t) AS tn,
   COUNT(*) FILTER (WHERE y = 0 AND s >= lo.t) AS fp, COUNT(*) FILTER (WHERE y = 1 AND s < lo.t) AS fn
   FROM scored CROSS JOIN (SELECT 0.05::DOUBLE + i * 0.05::DOUBLE AS t FROM range(0, 19) r(i)) lo GROUP BY {by} lo.t"""

_SWEEP = f"""SELECT *, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS recall,
   CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS "precision",
   CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / ((tp + fn) + (tp + fp)) ELSE 0 END AS f1,
   fp * 1.0::DOUBLE + fn * 3.0::DOUBLE AS cost FROM ({_SWEEP_FROM.format(by='')})"""

_GRID19 = Th.grid_points(0.05, 0.05, 19)


def _sweep_rows(spark, sf):
    d = predictions(spark, sf).withColumn("y", (F.col("truth") >= 1).cast("int"))
    return Th.threshold_sweep(d, "y", "p_alert", _GRID19)


@query("threshold_sweep", _SWEEP, (PREDICTIONS_SQL, _SCORED))
def _sweep(spark, sf):
    return _sweep_rows(spark, sf)


@query(
    "threshold_choice_with_recall",
    f"""SELECT * FROM ({_SWEEP}) ORDER BY CASE WHEN round_even(recall, 3) >= 0.9 THEN 0 ELSE 1 END, cost, threshold LIMIT 1""",
    (PREDICTIONS_SQL, _SCORED),
)
def _choice(spark, sf):
    return Th.best_threshold(_sweep_rows(spark, sf), 0.9)


_TOP_GRID = Th.grid_points(0.04, 0.02, 36)
_CAUTION_GRID = Th.grid_points(0.10, 0.05, 9)

def _grid_sql() -> str:
    def cnt(cond: str) -> str:
        return f"COALESCE(SUM(w) FILTER (WHERE {cond}), 0)"

    f1s = []
    for c in (0, 1, 2):
        t, p = cnt(f"truth = {c}"), cnt(f"d = {c}")
        f1s.append(f"(CASE WHEN {t} + {p} > 0 THEN 2.0::DOUBLE * {cnt(f'truth = {c} AND d = {c}')} / ({t} + {p}) ELSE 0::DOUBLE END)")
    seen = " + ".join(f"CASE WHEN {cnt(f'truth = {c} OR d = {c}')} > 0 THEN 1 ELSE 0 END" for c in (0, 1, 2))
    return f"""grid AS (
      SELECT i_top, i_caution, t_top, t_caution, CAST({cnt('truth = d')} AS DOUBLE) / SUM(w) AS accuracy, ({' + '.join(f1s)}) / ({seen}) AS macro_f1,
             CAST({cnt('truth = 0 AND d >= 1')} AS BIGINT) AS fp, CAST({cnt('truth >= 1 AND d = 0')} AS BIGINT) AS fn,
             {cnt('truth = 0 AND d >= 1')} * 1.0::DOUBLE + {cnt('truth >= 1 AND d = 0')} * 3.0::DOUBLE AS cost,
             round_even(CAST({cnt('truth = 2 AND d = 2')} AS DOUBLE) / GREATEST({cnt('truth = 2')}, 1), 3) AS top_recall
      FROM (SELECT truth, w, i_top, i_caution, t_top, t_caution, CASE WHEN p2 >= t_top THEN 2 WHEN p1 >= t_caution THEN 1 ELSE 0 END AS d
            FROM (SELECT truth, p1, p2, COUNT(*) AS w FROM predictions GROUP BY 1, 2, 3)
            CROSS JOIN (SELECT CAST(i AS INTEGER) AS i_top, 0.04::DOUBLE + i * 0.02::DOUBLE AS t_top FROM range(0, 36) r(i))
            CROSS JOIN (SELECT CAST(i AS INTEGER) AS i_caution, 0.10::DOUBLE + i * 0.05::DOUBLE AS t_caution FROM range(0, 9) r(i)))
      GROUP BY 1, 2, 3, 4)"""


def _grid(spark, sf):
    return Th.threshold_grid(predictions(spark, sf), "truth", "p1", "p2", _TOP_GRID, _CAUTION_GRID)


@query("threshold_pair_grid", "SELECT * FROM grid", (PREDICTIONS_SQL, _grid_sql()))
def _pair_grid(spark, sf):
    return _grid(spark, sf)


@query(
    "threshold_pair_search",
    """SELECT criterion, t_top, t_caution, macro_f1, cost, top_recall FROM (
         SELECT 'macro_f1' AS criterion, * FROM (SELECT * FROM grid ORDER BY macro_f1 DESC, i_top, i_caution LIMIT 1)
         UNION ALL SELECT 'cost', * FROM (SELECT * FROM grid ORDER BY cost, i_top, i_caution LIMIT 1)
         UNION ALL SELECT 'cost_with_recall', * FROM (SELECT * FROM grid ORDER BY CASE WHEN top_recall >= 0.7 THEN 0 ELSE 1 END, cost, i_top, i_caution LIMIT 1))""",
    (PREDICTIONS_SQL, _grid_sql()),
)
def _pair_search(spark, sf):
    return Th.search_thresholds(_grid(spark, sf))


@query("cost_envelope", "SELECT t_top, MIN(cost) AS min_cost FROM grid GROUP BY 1", (PREDICTIONS_SQL, _grid_sql()))
def _envelope(spark, sf):
    return Th.cost_envelope(_grid(spark, sf))


@query(
    "apply_two_thresholds",
    """SELECT CASE WHEN p2 >= 0.12 THEN 2 WHEN p1 >= 0.3 THEN 1 ELSE 0 END AS decision, truth, COUNT(*) AS n FROM predictions GROUP BY 1, 2""",
    (PREDICTIONS_SQL,),
)
def _apply(spark, sf):
    d = Th.apply_thresholds(F.col("p1"), F.col("p2"), 0.12, 0.3)
    return predictions(spark, sf).groupBy(d.alias("decision"), "truth").agg(F.count(F.lit(1)).alias("n"))


_BANDS = """bands AS (
  SELECT key, day, top AS y, quantile_cont(top, 0.1) OVER w AS q10, quantile_cont(top, 0.5) OVER w AS q50, quantile_cont(top, 0.9) OVER w AS q90
  FROM panel WINDOW w AS (PARTITION BY key ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))"""


@query(
    "interval_metrics",
    """SELECT COUNT(*) AS n, ROUND(AVG(GREATEST(0.1 * (y - q10), (0.1 - 1) * (y - q10))), 2) AS pinball_10,
              ROUND(AVG(GREATEST(0.5 * (y - q50), (0.5 - 1) * (y - q50))), 2) AS pinball_50,
              ROUND(AVG(GREATEST(0.9 * (y - q90), (0.9 - 1) * (y - q90))), 2) AS pinball_90,
              AVG(CASE WHEN y BETWEEN q10 AND q90 THEN 1.0 ELSE 0 END) AS coverage, ROUND(AVG(q90 - q10), 2) AS mean_width, ROUND(AVG(ABS(y - q50)), 2) AS median_mae
       FROM bands WHERE q10 IS NOT NULL""",
    (PANEL_SQL, _BANDS),
)
def _interval(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("day").rowsBetween(-30, -1)
    qs = F.percentile("top", [0.1, 0.5, 0.9]).over(w)
    d = panel(spark, sf).withColumn("q", qs).where(F.col("q").isNotNull())
    d = d.select(F.col("top").alias("y"), F.col("q")[0].alias("q10"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q90"))
    out = V.interval_metrics(d, "y", "q10", "q50", "q90")
    return out.withColumns({c: F.round(c, 2) for c in ["pinball_10", "pinball_50", "pinball_90", "mean_width", "median_mae"]})


_ALPHAS = [0.05 + i * 0.05 for i in range(9)]


@query(
    "conformal_alert_sets",
    """SELECT alpha, ROUND(q, 9) AS quantile, AVG(CASE WHEN s >= 1 - q THEN 1.0 ELSE 0 END) FILTER (WHERE y = 1) AS coverage,
              AVG(CASE WHEN s >= 1 - q THEN 0.0 ELSE 1.0 END) FILTER (WHERE y = 0) AS specificity,
              ROUND(1 - AVG(CASE WHEN s >= 1 - q THEN 1.0 ELSE 0 END), 9) AS efficiency
       FROM (SELECT y, s FROM halves WHERE NOT cal) CROSS JOIN (
         SELECT alpha, lo + (hi - lo) * (a - FLOOR(a)) AS q FROM (
           SELECT alpha, a, v[CAST(FLOOR(a) AS BIGINT) + 1] AS lo, v[LEAST(CAST(FLOOR(a) AS BIGINT) + 1, n - 1) + 1] AS hi FROM (
             SELECT alpha, n, v, (n - 1) * LEAST(CEIL((n + 1) * (1.0::DOUBLE - alpha)) / n, 1.0) AS a
             FROM (SELECT COUNT(*) AS n, list_sort(list(CASE WHEN y = 1 THEN 1 - s ELSE s END)) AS v FROM halves WHERE cal)
             CROSS JOIN (SELECT 0.05::DOUBLE + i * 0.05::DOUBLE AS alpha FROM range(0, 9) r(i)))))
       GROUP BY 1, 2, q""",
    (PREDICTIONS_SQL, "halves AS (SELECT CASE WHEN truth >= 1 THEN 1 ELSE 0 END AS y, p_alert AS s, l_orderkey % 2 = 0 AS cal FROM predictions)"),
)
def _conformal(spark, sf):
    d = predictions(spark, sf).withColumn("y", (F.col("truth") >= 1).cast("int"))
    cal = d.where(F.col("l_orderkey") % 2 == 0)
    test = d.where(F.col("l_orderkey") % 2 != 0)
    out = C.conformal(cal, test, "y", "p_alert", _ALPHAS)
    return out.withColumns({c: F.round(c, 9) for c in ["quantile", "efficiency"]})


@query(
    "persistence_against_model",
    """SELECT COUNT(*) AS n, AVG(CASE WHEN y_stage = COALESCE(persist_stage_max, 0) THEN 1.0 ELSE 0 END) AS accuracy_persistence,
              AVG(CASE WHEN y_stage = m THEN 1.0 ELSE 0 END) AS accuracy_model,
              round_even(AVG(CASE WHEN y_stage = m THEN 1.0 ELSE 0 END) - AVG(CASE WHEN y_stage = COALESCE(persist_stage_max, 0) THEN 1.0 ELSE 0 END), 4) AS accuracy_delta,
              AVG(ABS(y_max - persist_top_max)) AS mae_persistence, AVG(ABS(y_max - lw2_mean_top_max)) AS mae_model,
              ROUND(1 - SUM((ly - lp) ** 2) / (VAR_POP(ly) * COUNT(*)), 9) AS r2_persistence,
              ROUND(1 - SUM((ly - lm) ** 2) FILTER (lm IS NOT NULL) / (VAR_POP(ly) FILTER (lm IS NOT NULL) * COUNT(lm)), 9) AS r2_model
       FROM (SELECT *, LN(1 + GREATEST(y_max, 0)) AS ly, LN(1 + GREATEST(lw2_mean_top_max, 0)) AS lm,
               LN(1 + GREATEST(COALESCE(persist_top_max, (SELECT MEDIAN(persist_top_max) FROM held WHERE split = 'test')), 0)) AS lp, CASE WHEN lw2_mean_top_max >= 490000 THEN 3 WHEN lw2_mean_top_max >= 460000 THEN 2 WHEN lw2_mean_top_max >= 400000 THEN 1 ELSE 0 END AS m
             FROM held WHERE split = 'test')""",
    (*SUP, _HOLD),
)
def _compare(spark, sf):
    from tideline.catalog.tables import WEEK_CUTS
    from tideline.functions.stages import stage_from_value

    d = L.time_holdout(supervised(spark, sf), "week_start").where(F.col("split") == "test")
    d = d.withColumn("m", stage_from_value(F.col("lw2_mean_top_max"), WEEK_CUTS))
    out = V.compare_persistence(d, "y_stage", "m", "persist_stage_max", "y_max", "lw2_mean_top_max", "persist_top_max")
    return out.withColumns({c: F.round(c, 9) for c in ("r2_persistence", "r2_model")})


@query(
    "compare_runs",
    "SELECT metric, strict, loose FROM (WITH a AS (" + _metrics_sql("") + "), b AS (" + _metrics_sql("", "(SELECT truth, CASE WHEN p2 >= 0.5 THEN 2 WHEN p1 >= 0.2 THEN 1 ELSE 0 END AS pred FROM predictions)")
    + ") "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, a.{m} AS strict, b.{m} AS loose FROM a CROSS JOIN b"
        for m in ["accuracy", "macro_f1", "alert_recall", "top_recall"]
    )
    + ")",
    (PREDICTIONS_SQL,),
)
def _runs(spark, sf):
    p = predictions(spark, sf)
    loose = p.withColumn("pred", Th.apply_thresholds(F.col("p1"), F.col("p2"), 0.5, 0.2))
    runs = {"strict": V.alert_metrics(p, "truth", "pred"), "loose": V.alert_metrics(loose, "truth", "pred")}
    return V.compare_runs(runs, ["accuracy", "macro_f1", "alert_recall", "top_recall"])


# ---- probability algebra -----------------------------------------------------


@query(
    "average_and_argmax_probabilities",
    """SELECT cls, truth, COUNT(*) AS n FROM (
         SELECT truth, CASE WHEN e0 >= e1 AND e0 >= e2 THEN 0 WHEN e1 >= e2 THEN 1 ELSE 2 END AS cls FROM (
           SELECT truth, (1.0 * ((1 - p1) - p2) + 1.0 * 0.5::DOUBLE) / 2.0 AS e0, (1.0 * p1 + 1.0 * 0.3::DOUBLE) / 2.0 AS e1, (1.0 * p2 + 1.0 * 0.2::DOUBLE) / 2.0 AS e2
           FROM predictions)) GROUP BY 1, 2""",
    (PREDICTIONS_SQL,),
)
def _average(spark, sf):
    p0 = 1 - F.col("p1") - F.col("p2")
    means = [average_probs([(1.0, p), (1.0, F.lit(b))]) for p, b in ((p0, 0.5), (F.col("p1"), 0.3), (F.col("p2"), 0.2))]
    return predictions(spark, sf).groupBy(argmax_class(means).alias("cls"), "truth").agg(F.count(F.lit(1)).alias("n"))


@query(
    "compose_probabilities",
    """SELECT truth, ROUND(AVG(a0 / s), 6) AS c0, ROUND(AVG(a1 / s), 6) AS c1, ROUND(AVG(a2 / s), 6) AS c2,
              COUNT(*) FILTER (WHERE p_alert >= 0.5 AND p2 >= 0.4) AS top_rows, COUNT(*) FILTER (WHERE p_alert >= 0.5 AND p2 < 0.4) AS alert_rows
       FROM (SELECT *, a0 + a1 + a2 AS s FROM (SELECT truth, p_alert, p2, 1 - p_alert AS a0, p_alert * (1 - p2) AS a1, p_alert * p2 AS a2 FROM predictions)) GROUP BY 1""",
    (PREDICTIONS_SQL,),
)
def _compose(spark, sf):
    c = compose_probs(F.col("p_alert"), F.col("p2"))
    d = decide_two_stage(F.col("p_alert"), F.col("p2"), 0.5, 0.4)
    return predictions(spark, sf).groupBy("truth").agg(
        *[F.round(F.avg(x), 6).alias(f"c{i}") for i, x in enumerate(c)],
        F.count_if(d == 2).alias("top_rows"),
        F.count_if(d == 1).alias("alert_rows"),
    )


def _blend_sql() -> str:
    return """SELECT weight, t_alert, t_top, cost, top_recall FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY weight ORDER BY CASE WHEN top_recall >= 0.3 THEN 0 ELSE 1 END, cost, i, j) AS r FROM (
        SELECT weight, i, j, 0.05::DOUBLE + i * 0.1::DOUBLE AS t_alert, 0.05::DOUBLE + j * 0.1::DOUBLE AS t_top,
               COALESCE(SUM(w) FILTER (WHERE truth = 0 AND a >= 0.05::DOUBLE + i * 0.1::DOUBLE), 0) * 1.0::DOUBLE
               + COALESCE(SUM(w) FILTER (WHERE truth >= 1 AND a < 0.05::DOUBLE + i * 0.1::DOUBLE), 0) * 3.0::DOUBLE AS cost,
               CAST(COALESCE(SUM(w) FILTER (WHERE truth = 2 AND a >= 0.05::DOUBLE + i * 0.1::DOUBLE AND b >= 0.05::DOUBLE + j * 0.1::DOUBLE), 0) AS DOUBLE)
               / COALESCE(SUM(w) FILTER (WHERE truth = 2), 0) AS top_recall
        FROM (SELECT weight, truth, weight * p_alert + (1 - weight) * q_alert AS a, weight * p2 + (1 - weight) * q_top AS b, COUNT(*) AS w
              FROM (SELECT truth, p_alert, p2, level / 64 AS q_alert, level / 128 AS q_top FROM predictions)
              CROSS JOIN (SELECT UNNEST([0.3::DOUBLE, 0.6::DOUBLE]) AS weight) GROUP BY 1, 2, 3, 4)
        CROSS JOIN (SELECT i FROM range(0, 9) r(i)) CROSS JOIN (SELECT j FROM range(0, 9) s(j)) GROUP BY 1, 2, 3)) WHERE r = 1"""


@query("blend_weight_search", _blend_sql(), (PREDICTIONS_SQL,))
def _blend(spark, sf):
    from tideline.operators.models import blend_two

    d = predictions(spark, sf).select(
        "truth", "p_alert", "p2", (F.col("level") / 64).alias("q_alert"), (F.col("level") / 128).alias("q_top")
    )
    grid = Th.grid_points(0.05, 0.1, 9)
    return blend_two(d, "truth", ("p_alert", "p2"), ("q_alert", "q_top"), [0.3, 0.6], grid, grid, 0.3)


_SES = """ses AS (
  WITH RECURSIVE pos AS (
    SELECT key, top_max AS v, ROW_NUMBER() OVER (PARTITION BY key ORDER BY week_start) - 1 AS p, COUNT(*) OVER (PARTITION BY key) AS n,
           LAG(top_max) OVER (PARTITION BY key ORDER BY week_start) AS prev FROM weekly),
  fold AS (
    SELECT key, alpha, p, v AS level, 0.0::DOUBLE AS sse FROM pos CROSS JOIN (SELECT 0.1::DOUBLE + i * 0.2::DOUBLE AS alpha FROM range(0, 5) r(i)) WHERE p = 0
    UNION ALL
    SELECT f.key, f.alpha, x.p, f.level + f.alpha * (x.v - f.level), f.sse + (x.v - f.level) * (x.v - f.level)
    FROM fold f JOIN pos x ON x.key = f.key AND x.p = f.p + 1 AND x.p < FLOOR(x.n * 0.85::DOUBLE)),
  best AS (
    SELECT key, alpha, level FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY key ORDER BY p DESC, sse, alpha) AS r FROM fold) WHERE r = 1)
  SELECT pos.key, MAX(n) AS n, COUNT(*) FILTER (WHERE p >= FLOOR(n * 0.85::DOUBLE)) AS holdout_n,
         AVG(ABS(v - prev)) FILTER (WHERE p >= FLOOR(n * 0.85::DOUBLE)) AS mae_naive, MAX(alpha) AS alpha, MAX(level) AS forecast,
         AVG(ABS(v - level)) FILTER (WHERE p >= FLOOR(n * 0.85::DOUBLE)) AS mae_smooth
  FROM pos JOIN best USING (key) GROUP BY 1)"""


@query(
    "smoothing_baseline",
    "SELECT key, n, holdout_n, mae_naive, ROUND(alpha, 6) AS alpha, ROUND(forecast, 2) AS forecast, ROUND(mae_smooth, 2) AS mae_smooth FROM ses",
    (PANEL_SQL, WEEKLY_SQL, _SES),
)
def _ses(spark, sf):
    out = ses_baseline(weekly(spark, sf), WEEKLY_SERIES, "top_max", Th.grid_points(0.1, 0.2, 5))
    return out.withColumns(
        {"alpha": F.round("alpha", 6), "forecast": F.round("forecast", 2), "mae_smooth": F.round("mae_smooth", 2)}
    )


@query(
    "flagship_weekly_forecast",
    "SELECT * FROM (" + _metrics_sql("key, ", "(SELECT key, LEAST(y_stage, 2) AS truth, LEAST(persist_stage_max, 2) AS pred FROM held WHERE split = 'test')") + ")",
    (*SUP, _HOLD),
)
def flagship(spark, sf):
    """Panel to weeks to look-back table, persistence forecast, hold-out, metrics per key."""
    d = L.time_holdout(supervised(spark, sf), "week_start").where(F.col("split") == "test")
    d = d.select(
        "key", F.least("y_stage", F.lit(2)).alias("truth"), F.least("persist_stage_max", F.lit(2)).alias("pred")
    )
    return V.alert_metrics(d, "truth", "pred", by=["key"])
