"""Aggregates, events, rules and reports over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog.registry import query
from tideline.catalog.tables import (
    DAILY,
    GAPPY_SQL,
    KINDS,
    PANEL_SQL,
    PREDICTIONS_SQL,
    SPARSE,
    SPARSE_SQL,
    STAGED_SQL,
    USER_DAYS_SQL,
    WEEKLY_SQL,
    gappy,
    panel,
    predictions,
    read,
    sparse,
    staged,
    user_days,
    weekly,
)
from tideline.fixed_values import (
    ACTIVITY_NONE,
    ACTIVITY_WORDS,
    DAILY_NO_RULE,
    DAILY_RULE_ACTIONS,
    MISS_TYPES,
    SCENARIO_ACTIONS,
    WEEKLY_RULES,
)
from tideline.functions.rows import bin_by, risk_score, shares
from tideline.functions.stages import stage_from_value
from tideline.operators import aggregates as A
from tideline.operators import events as E
from tideline.operators import rules as U
from tideline.operators.quantiles import exact_quantiles, quantile_with_fallback
from tideline.operators.windows import diff_n, rolling, stress_indices

W = "(PARTITION BY key ORDER BY day)"

# ---- aggregates --------------------------------------------------------------


@query(
    "grouped_summary",
    """SELECT l_returnflag, l_linestatus, AVG(l_quantity) AS qty_mean, MAX(l_extendedprice) AS price_max, MIN(l_extendedprice) AS price_min,
              COALESCE(SUM(CASE WHEN l_linenumber > 99 THEN l_quantity END), 0) AS none_sum, SUM(l_quantity) AS qty_sum
       FROM lineitem GROUP BY 1, 2""",
)
def _summary(spark, sf):
    d = read(spark, sf, "lineitem").withColumn("none", F.when(F.col("l_linenumber") > 99, F.col("l_quantity")))
    return A.summarize(
        d,
        ["l_returnflag", "l_linestatus"],
        {
            "qty_mean": ("l_quantity", "mean"),
            "price_max": ("l_extendedprice", "max"),
            "price_min": ("l_extendedprice", "min"),
            "none_sum": ("none", "sum"),
            "qty_sum": ("l_quantity", "sum"),
        },
    )


@query(
    "conditional_rate",
    "SELECT site, COUNT(*) AS n, AVG(CASE WHEN truth = 2 THEN 1.0 ELSE 0 END) * 100 AS rate FROM predictions GROUP BY 1",
    (PREDICTIONS_SQL,),
)
def _rate(spark, sf):
    return A.rate_by(predictions(spark, sf), ["site"], F.col("truth") == 2)


@query(
    "pivot_rate_matrix",
    """SELECT row_bin, AVG(CASE WHEN truth = 2 THEN 1.0 ELSE 0.0 END) FILTER (WHERE col_bin = '<3') * 100 AS "<3",
              AVG(CASE WHEN truth = 2 THEN 1.0 ELSE 0.0 END) FILTER (WHERE col_bin = '3-5') * 100 AS "3-5",
              AVG(CASE WHEN truth = 2 THEN 1.0 ELSE 0.0 END) FILTER (WHERE col_bin = '>5') * 100 AS ">5"
       FROM (SELECT *, CASE WHEN level >= 0 AND level < 10 THEN '<10' WHEN level >= 10 AND level < 30 THEN '10-30'
                            WHEN level >= 30 AND level < 50 THEN '>30' END AS row_bin,
                    CASE WHEN l_linenumber < 3 THEN '<3' WHEN l_linenumber < 5 THEN '3-5' ELSE '>5' END AS col_bin FROM predictions)
       WHERE row_bin IS NOT NULL GROUP BY 1""",
    (PREDICTIONS_SQL,),
)
def _pivot_rate(spark, sf):
    d = predictions(spark, sf).select(
        "truth",
        bin_by(F.col("level"), [0, 10, 30, 50], ["<10", "10-30", ">30"]).alias("row_bin"),
        bin_by(F.col("l_linenumber"), [0, 3, 5, 100], ["<3", "3-5", ">5"]).alias("col_bin"),
    )
    return A.pivot_rate(d, "row_bin", "col_bin", ["<3", "3-5", ">5"], F.col("truth") == 2)


@query(
    "pivot_class_by_year",
    """SELECT CAST(year(day) AS INTEGER) AS year, COUNT(*) FILTER (WHERE stage = 0) AS "0", COUNT(*) FILTER (WHERE stage = 1) AS "1",
              COUNT(*) FILTER (WHERE stage = 2) AS "2", COUNT(*) FILTER (WHERE stage = 3) AS "3" FROM staged GROUP BY 1""",
    (PANEL_SQL, STAGED_SQL),
)
def _pivot_count(spark, sf):
    return A.pivot_count(staged(spark, sf).withColumn("year", F.year("day")), "year", "stage", [0, 1, 2, 3])


@query("value_counts_top", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10")
def _value_counts(spark, sf):
    return A.value_counts(read(spark, sf, "orders"), "o_custkey", 10)


@query(
    "exact_quantiles_by_group",
    """SELECT l_returnflag, ROUND(quantile_cont(l_extendedprice, 0.1), 3) AS q10, ROUND(quantile_cont(l_extendedprice, 0.5), 3) AS q50,
              ROUND(quantile_cont(l_extendedprice, 0.9), 3) AS q90 FROM (SELECT l_returnflag, FLOOR(l_extendedprice) AS l_extendedprice FROM lineitem) GROUP BY 1""",
)
def _quantiles(spark, sf):
    d = read(spark, sf, "lineitem").select("l_returnflag", F.floor("l_extendedprice").alias("p"))
    out = exact_quantiles(d, "p", [0.1, 0.5, 0.9], by=["l_returnflag"])
    return out.select("l_returnflag", *[F.round(q, 3).alias(q) for q in ["q10", "q50", "q90"]])


@query(
    "quantile_with_positive_fallback",
    """SELECT CASE WHEN quantile_cont(x, 0.75) = 0 THEN (SELECT quantile_cont(x, 0.5) FROM z WHERE x > 0) ELSE quantile_cont(x, 0.75) END AS cut,
              (SELECT quantile_cont(y, 0.75) FROM z) AS plain FROM z""",
    ("z AS (SELECT GREATEST(l_quantity - 40, 0) AS x, l_quantity AS y FROM lineitem)",),
)
def _fallback(spark, sf):
    d = read(spark, sf, "lineitem").select(
        F.greatest(F.col("l_quantity") - 40, F.lit(0.0)).alias("x"), F.col("l_quantity").alias("y")
    )
    cut = quantile_with_fallback(d, "x", 0.75, 0.5, 1.0, "cut")
    plain = quantile_with_fallback(d, "y", 0.75, 0.5, 1.0, "plain")
    return cut.join(F.broadcast(plain), how="left")


@query(
    "month_profile",
    """SELECT CAST(month(day) AS INTEGER) AS month, AVG(total) AS mean_total, AVG(top) AS mean_top, AVG(n) AS mean_n,
              AVG(CASE WHEN stage = 2 THEN 1.0 ELSE 0 END) * 100 AS rate, COUNT(*) AS n FROM staged GROUP BY 1""",
    (PANEL_SQL, STAGED_SQL),
)
def _month_profile(spark, sf):
    return A.profile_by(staged(spark, sf), F.month("day"), "month", ["total", "top", "n"], F.col("stage") == 2)


@query(
    "year_profile",
    """SELECT CAST(year(day) AS INTEGER) AS year, AVG(top) AS mean_top, AVG(CASE WHEN stage = 2 THEN 1.0 ELSE 0 END) * 100 AS rate,
              COUNT(*) AS n FROM staged GROUP BY 1""",
    (PANEL_SQL, STAGED_SQL),
)
def _year_profile(spark, sf):
    return A.profile_by(staged(spark, sf), F.year("day"), "year", ["top"], F.col("stage") == 2)


_LAGCORR = """SELECT x.key, CAST(g.lag AS INTEGER) AS lag, ROUND(corr(x.v, y.top), 6) AS r, COUNT(*) AS n
  FROM (SELECT key, v, ROW_NUMBER() OVER (PARTITION BY key ORDER BY day) AS p FROM gappy WHERE v IS NOT NULL) x
  CROSS JOIN (SELECT UNNEST([0, 3, 7, 10, 14, 21]) AS lag) g
  JOIN (SELECT key, top, ROW_NUMBER() OVER (PARTITION BY key ORDER BY day) AS p FROM gappy WHERE top IS NOT NULL) y
    ON y.key = x.key AND y.p = x.p + g.lag GROUP BY 1, 2"""


@query("lag_correlation", _LAGCORR, (PANEL_SQL, GAPPY_SQL))
def _lag_corr(spark, sf):
    out = A.lag_correlation(gappy(spark, sf), DAILY, "v", "top", [0, 3, 7, 10, 14, 21])
    return out.withColumn("r", F.round("r", 6))


@query(
    "best_lag",
    f"SELECT key, arg_max(lag, r) AS best_lag, MAX(r) AS r FROM ({_LAGCORR}) GROUP BY 1",
    (PANEL_SQL, GAPPY_SQL),
)
def _best_lag(spark, sf):
    return A.best_lag(_lag_corr(spark, sf), ["key"])


@query(
    "composition_by_bin",
    "SELECT bin, share_click_dom, share_view_dom, share_purchase_dom, rate, n, CASE "
    "WHEN share_click_dom >= share_view_dom AND share_click_dom >= share_purchase_dom THEN 'click_dom' "
    "WHEN share_view_dom >= share_purchase_dom THEN 'view_dom' ELSE 'purchase_dom' END AS dominant FROM ("
    "SELECT bin, round_even(AVG(click / (s + 1e-6)) * 100, 1) AS share_click_dom, round_even(AVG(\"view\" / (s + 1e-6)) * 100, 1) AS share_view_dom, "
    "round_even(AVG(purchase / (s + 1e-6)) * 100, 1) AS share_purchase_dom, AVG(CASE WHEN error > 0 THEN 1.0 ELSE 0 END) * 100 AS rate, COUNT(*) AS n "
    "FROM (SELECT *, COALESCE(click, 0) + COALESCE(\"view\", 0) + COALESCE(purchase, 0) AS s, "
    "CASE WHEN day < DATE '2024-01-11' THEN 'early' WHEN day < DATE '2024-01-21' THEN 'mid' ELSE 'late' END AS bin FROM user_days) GROUP BY 1)",
    (USER_DAYS_SQL,),
)
def _composition(spark, sf):
    parts = ["click", "view", "purchase"]
    d = shares(user_days(spark, sf), parts)
    d = d.withColumn(
        "bin",
        F.when(F.col("day") < "2024-01-11", "early").when(F.col("day") < "2024-01-21", "mid").otherwise("late"),
    )
    return A.composition_by(d, "bin", [f"{p}_dom" for p in parts], F.col("error") > 0)


@query(
    "missing_rates_top",
    " UNION ALL ".join(
        f"SELECT '{k}' AS column_name, AVG(CASE WHEN \"{k}\" IS NULL THEN 1.0 ELSE 0 END) AS missing_rate FROM user_days"
        for k in KINDS + ["key", "day"]
    )
    + " ORDER BY missing_rate DESC, column_name LIMIT 6",
    (USER_DAYS_SQL,),
)
def _missing(spark, sf):
    return A.missing_rates(user_days(spark, sf), 6, KINDS + ["key", "day"])


@query(
    "median_gap_per_key",
    """SELECT cust, quantile_cont(gap, 0.5) AS median_gap FROM (
         SELECT cust, day - LAG(day) OVER (PARTITION BY cust ORDER BY day, order_id) AS gap FROM sparse) GROUP BY 1""",
    (SPARSE_SQL,),
)
def _gap(spark, sf):
    return A.median_gap(sparse(spark, sf), SPARSE)


@query(
    "encoding_mismatch",
    """SELECT AVG(CASE WHEN COALESCE(a, 0) <> b THEN 1.0 ELSE 0 END) AS mismatch_rate, COUNT(*) AS n FROM (
         SELECT CASE WHEN order_id % 13 = 0 THEN NULL WHEN v >= 260000 THEN 2 WHEN v >= 100000 THEN 1 ELSE 0 END AS a,
                CASE WHEN v >= 250000 THEN 2 WHEN v >= 100000 THEN 1 ELSE 0 END AS b FROM sparse)""",
    (SPARSE_SQL,),
)
def _mismatch(spark, sf):
    d = sparse(spark, sf).select(
        F.when(F.col("order_id") % 13 != 0, stage_from_value(F.col("v"), [100_000, 260_000])).alias("a"),
        stage_from_value(F.col("v"), [100_000, 250_000]).alias("b"),
    )
    return A.mismatch_rate(d, "a", "b")


_PROFILED = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_NAMED = ["l_returnflag", "l_linestatus", "l_shipdate"]


@query(
    "column_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, COUNT({c}) AS n, ROUND(AVG({c}), 4) AS mean, ROUND(STDDEV_SAMP({c}), 4) AS sd,
            CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max, 0.0::DOUBLE AS missing_rate,
            COUNT(DISTINCT {c}) AS n_distinct, ROUND(quantile_cont({c}::DOUBLE, 0.25), 4) AS q25, ROUND(quantile_cont({c}::DOUBLE, 0.5), 4) AS q50,
            ROUND(quantile_cont({c}::DOUBLE, 0.75), 4) AS q75 FROM lineitem"""
        for c in _PROFILED
    ),
)
def _profile(spark, sf):
    out = A.profile(read(spark, sf, "lineitem"), _PROFILED)
    return out.withColumns({c: F.round(c, 4) for c in ["mean", "sd", "q25", "q50", "q75"]})


@query(
    "column_profile_text",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, COUNT({c}) AS n, 1 - COUNT({c}) / COUNT(*) AS missing_rate, COUNT(DISTINCT {c}) AS n_distinct,
            (SELECT CAST({c} AS VARCHAR) FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, CAST({c} AS VARCHAR) LIMIT 1) AS top,
            (SELECT MAX(k) FROM (SELECT COUNT(*) AS k FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c})) AS top_n FROM lineitem"""
        for c in _NAMED
    ),
)
def _profile_text(spark, sf):
    return A.profile_text(read(spark, sf, "lineitem"), _NAMED)


@query(
    "latest_per_key",
    "SELECT key, day, total, top FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY key ORDER BY day DESC) AS r FROM panel) WHERE r = 1",
    (PANEL_SQL,),
)
def _latest(spark, sf):
    return A.latest_per_key(panel(spark, sf), ["key"], ["day"]).drop("n")


@query(
    "latest_per_customer",
    "SELECT cust, arg_max(order_id, (day, order_id)) AS order_id, arg_max(v, (day, order_id)) AS v FROM sparse GROUP BY 1",
    (SPARSE_SQL,),
)
def _latest_sparse(spark, sf):
    d = sparse(spark, sf).select("cust", "day", "order_id", "v")
    return A.latest_per_key(d, ["cust"], ["day", "order_id"]).drop("day")


@query(
    "unit_histogram",
    """SELECT g.bin_start, COALESCE(h.n, 0) AS n FROM (
         SELECT UNNEST(range(0, CAST((SELECT MAX(FLOOR(l_quantity / 3) * 3) FROM lineitem) AS BIGINT) + 1, 3)) AS bin_start) g
       LEFT JOIN (SELECT CAST(FLOOR(l_quantity / 3) * 3 AS BIGINT) AS bin_start, COUNT(*) AS n FROM lineitem GROUP BY 1) h USING (bin_start)""",
)
def _histogram(spark, sf):
    return A.histogram(read(spark, sf, "lineitem"), "l_quantity", 3)


@query(
    "total_order_output",
    "SELECT key, day, total FROM panel ORDER BY key, day",
    (PANEL_SQL,),
)
def _sorted(spark, sf):
    return panel(spark, sf).select("key", "day", "total").orderBy("key", "day")


@query(
    "importance_families",
    """SELECT family, n, round_even(100 * n / SUM(n) OVER (), 1) AS percent FROM (
         SELECT CASE WHEN regexp_matches(p_name, '^small') THEN 'small first' WHEN regexp_matches(p_name, 'ring') THEN 'ring' ELSE 'other' END AS family, COUNT(*) AS n
         FROM (SELECT p_name, p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 200) GROUP BY 1)""",
)
def _families(spark, sf):
    d = read(spark, sf, "part").select(F.col("p_name").alias("feature"), "p_partkey", F.col("p_retailprice").alias("importance"))
    top = A.top_pairs(d, "importance", 200, tie=["p_partkey"])
    fams = A.importance_families(top, 200, [("^small", "small first"), ("ring", "ring")], "other")
    return A.to_percent(fams)


@query(
    "top_pairs",
    "SELECT p_name, p_brand, p_retailprice AS score FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 12",
)
def _top_pairs(spark, sf):
    d = read(spark, sf, "part").select("p_name", "p_brand", F.col("p_retailprice").alias("score"), "p_partkey")
    return A.top_pairs(d, "score", 12, tie=["p_partkey"]).drop("p_partkey")


@query(
    "recent_timeline",
    "SELECT * FROM (SELECT week_start, key, top_max FROM weekly ORDER BY week_start DESC, key DESC LIMIT 18)",
    (PANEL_SQL, WEEKLY_SQL),
)
def _recent(spark, sf):
    return A.recent(weekly(spark, sf).select("week_start", "key", "top_max"), ["week_start", "key"], 18)


@query(
    "union_of_key_frames",
    "SELECT key, COUNT(*) AS n, SUM(total) AS total FROM (SELECT * FROM panel WHERE key < '3' UNION ALL SELECT * FROM panel WHERE key >= '3') GROUP BY 1",
    (PANEL_SQL,),
)
def _union(spark, sf):
    p = panel(spark, sf)
    both = p.where(F.col("key") < "3").unionByName(p.where(F.col("key") >= "3"))
    return both.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("total"))


# ---- events ------------------------------------------------------------------

_FLAGGED = f"""flagged AS (
  SELECT key, day, top, stage, CASE WHEN r7 >= 3000000 THEN 1 ELSE 0 END AS wet, CASE WHEN d7 < -300000 THEN 1 ELSE 0 END AS dropped
  FROM (SELECT *, SUM(total) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS r7,
               total - LAG(total, 7) OVER {W} AS d7 FROM staged))"""


def _flagged(spark, sf):
    d = rolling(staged(spark, sf), DAILY, {"r7": ("total", 7, "sum")})
    d = diff_n(d, DAILY, "total", 7, "d7")
    return E.event_flags(d, {"wet": F.col("r7") >= 3_000_000, "dropped": F.col("d7") < -300_000})


@query(
    "event_flags",
    "SELECT key, day, wet, dropped FROM flagged",
    (PANEL_SQL, STAGED_SQL, _FLAGGED),
)
def _flags(spark, sf):
    return _flagged(spark, sf).select("key", "day", "wet", "dropped")


@query(
    "onset_two_ways",
    f"""SELECT key, day, CASE WHEN f = 1 AND COALESCE(LAG(f) OVER {W}, 0) = 0 THEN 1 ELSE 0 END AS first_may_fire,
               CASE WHEN f = 1 AND LAG(f) OVER {W} = 0 THEN 1 ELSE 0 END AS first_never_fires
        FROM (SELECT key, day, CASE WHEN stage >= 1 THEN 1 ELSE 0 END AS f FROM staged)""",
    (PANEL_SQL, STAGED_SQL),
)
def _onset(spark, sf):
    d = E.event_flags(staged(spark, sf), {"f": F.col("stage") >= 1})
    d = E.onset(d, DAILY, "f", "first_may_fire")
    return E.onset(d, DAILY, "f", "first_never_fires", default=None).select("key", "day", "first_may_fire", "first_never_fires")


_ONSETS = f"""onsets AS (SELECT *, CASE WHEN wet = 1 AND LAG(wet) OVER {W} = 0 THEN 1 ELSE 0 END AS starts FROM flagged)"""


@query(
    "delayed_response",
    """SELECT e.key, COUNT(*) AS events, COUNT(d.delay) AS hits, COUNT(d.delay) / COUNT(*) * 100 AS hit_rate, quantile_cont(d.delay, 0.5) AS median_delay
       FROM onsets e LEFT JOIN (
         SELECT a.key, a.day, MIN(b.day) - a.day AS delay FROM onsets a JOIN onsets b ON b.key = a.key AND b.day > a.day AND b.day <= a.day + 30 AND b.stage = 3
         WHERE a.starts = 1 GROUP BY 1, 2) d ON d.key = e.key AND d.day = e.day
       WHERE e.starts = 1 GROUP BY 1""",
    (PANEL_SQL, STAGED_SQL, _FLAGGED, _ONSETS),
)
def _delayed(spark, sf):
    d = E.onset(_flagged(spark, sf), DAILY, "wet", "starts", default=None)
    return E.delayed_response(d, DAILY, "starts", F.col("stage") == 3, 30, by=["key"])


@query(
    "post_event_count",
    """SELECT e.key, e.day, COUNT(p.day) AS hits FROM panel e
       LEFT JOIN panel p ON p.key = e.key AND p.day > e.day AND p.day <= e.day + 21 AND p.top >= 460000
       WHERE e.top >= 495000 GROUP BY 1, 2""",
    (PANEL_SQL,),
)
def _post(spark, sf):
    d = panel(spark, sf).withColumn("crossed", (F.col("top") >= 495_000).cast("int"))
    return E.post_event_count(d, DAILY, "crossed", F.col("top") >= 460_000, 21).select("key", "day", "hits")


@query(
    "state_transitions",
    f"""SELECT prev, curr, COALESCE(n, 0) AS n FROM (SELECT UNNEST([0, 1, 2, 3]) AS prev) CROSS JOIN (SELECT UNNEST([0, 1, 2, 3]) AS curr)
        LEFT JOIN (SELECT prev, curr, COUNT(*) AS n FROM (SELECT LAG(stage) OVER {W} AS prev, stage AS curr FROM staged)
                   WHERE prev IS NOT NULL GROUP BY 1, 2) USING (prev, curr)""",
    (PANEL_SQL, STAGED_SQL),
)
def _transitions(spark, sf):
    return E.transitions(staged(spark, sf), DAILY, "stage", [0, 1, 2, 3])


@query(
    "state_transitions_unbounded_keys",
    """SELECT prev, curr, COUNT(*) AS n FROM (SELECT LAG(s) OVER (PARTITION BY cust ORDER BY day, order_id) AS prev, s AS curr FROM (
         SELECT *, CASE WHEN v >= 250000 THEN 2 WHEN v >= 100000 THEN 1 ELSE 0 END AS s FROM sparse))
       WHERE prev IS NOT NULL GROUP BY 1, 2""",
    (SPARSE_SQL,),
)
def _transitions_sparse(spark, sf):
    d = sparse(spark, sf).withColumn("s", stage_from_value(F.col("v"), [100_000, 250_000]))
    return E.transitions(d, SPARSE, "s", [0, 1, 2])


_STEPS = f"steps AS (SELECT * FROM (SELECT *, LAG(stage) OVER {W} AS prev FROM staged) WHERE prev = 1 AND stage = 2)"


@query(
    "pre_event_means",
    """SELECT ROUND(AVG(m_total), 2) AS pre_total, ROUND(AVG(m_n), 4) AS pre_n, COUNT(*) AS events FROM (
         SELECT s.key, s.day, AVG(p.total) AS m_total, AVG(p.n) AS m_n FROM steps s
         LEFT JOIN panel p ON p.key = s.key AND p.day < s.day AND p.day >= s.day - 7 GROUP BY 1, 2)""",
    (PANEL_SQL, STAGED_SQL, _STEPS),
)
def _pre(spark, sf):
    d = staged(spark, sf)
    ev = E.transition_rows(d, DAILY, "stage", 1, 2)
    out = E.pre_event_means(ev, d, ["key"], "day", 7, ["total", "n"])
    return out.select(F.round("pre_total", 2).alias("pre_total"), F.round("pre_n", 4).alias("pre_n"), "events")


def _contrast_sql(on: str) -> str:
    return f"""SELECT before_event, AVG(total) AS mean_total, AVG(n) AS mean_n, COUNT(*) AS n FROM (
      SELECT *, CASE WHEN EXISTS (SELECT 1 FROM steps s WHERE {on} p.day >= s.day - 7 AND p.day < s.day) THEN 1 ELSE 0 END AS before_event
      FROM staged p WHERE stage = 1) GROUP BY 1"""


@query("pre_event_contrast", _contrast_sql("s.key = p.key AND"), (PANEL_SQL, STAGED_SQL, _STEPS))
def _contrast(spark, sf):
    d = staged(spark, sf)
    ev = E.transition_rows(d, DAILY, "stage", 1, 2)
    return E.pre_event_contrast(ev, d.where(F.col("stage") == 1), ["key"], "day", 7, ["total", "n"])


@query("pre_event_contrast_across_keys", _contrast_sql(""), (PANEL_SQL, STAGED_SQL, _STEPS))
def _contrast_across(spark, sf):
    d = staged(spark, sf)
    ev = E.transition_rows(d, DAILY, "stage", 1, 2)
    return E.pre_event_contrast(ev, d.where(F.col("stage") == 1), ["key"], "day", 7, ["total", "n"], across_keys=True)


def _episodes_sql(lead: bool) -> str:
    extra = ", CAST(lead AS INTEGER) AS lead, lead IS NOT NULL AS detected" if lead else ""
    return f"""SELECT key, start, "end", CAST("end" - start + 1 AS INTEGER) AS length, brk IS NULL AS open{extra} FROM (
      SELECT key, day AS start, COALESCE(brk - 1, last_day) AS "end", brk, day - found AS lead FROM (
        SELECT *, LAG(alarm) OVER {W} AS was,
               MIN(CASE WHEN NOT alarm THEN day END) OVER (PARTITION BY key ORDER BY day DESC) AS brk,
               MAX(day) OVER (PARTITION BY key) AS last_day,
               MAX(CASE WHEN hint THEN day END) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS found
        FROM (SELECT key, day, stage >= 2 AS alarm, total >= 1800000 AS hint FROM staged))
      WHERE alarm AND NOT COALESCE(was, FALSE))"""


@query("alert_episodes", _episodes_sql(False), (PANEL_SQL, STAGED_SQL))
def _episodes(spark, sf):
    return E.episodes(staged(spark, sf), DAILY, F.col("stage") >= 2)


@query("detection_leads", _episodes_sql(True), (PANEL_SQL, STAGED_SQL))
def _leads(spark, sf):
    return E.episodes(staged(spark, sf), DAILY, F.col("stage") >= 2, detect=F.col("total") >= 1_800_000)


@query(
    "detection_lead_summary",
    f"""SELECT COUNT(*) AS episodes, COUNT(*) FILTER (WHERE detected) AS detected, COUNT(*) FILTER (WHERE NOT detected) AS missed,
               AVG(lead) AS mean_lead, MAX(lead) AS max_lead, quantile_cont(lead, 0.5) AS median_lead FROM ({_episodes_sql(True)})""",
    (PANEL_SQL, STAGED_SQL),
)
def _lead_summary(spark, sf):
    return E.lead_summary(_leads(spark, sf))


@query(
    "episodes_unbounded_keys",
    """SELECT cust, start_id, n FROM (
         SELECT cust, MIN(order_id) FILTER (WHERE first_row) AS start_id, COUNT(*) AS n FROM (
           SELECT *, SUM(CASE WHEN brk THEN 1 ELSE 0 END) OVER w AS grp, alarm AND NOT COALESCE(LAG(alarm) OVER w, FALSE) AS first_row
           FROM (SELECT *, v >= 200000 AS alarm, v < 200000 AS brk FROM sparse)
           WINDOW w AS (PARTITION BY cust ORDER BY day, order_id)) WHERE alarm GROUP BY cust, grp)""",
    (SPARSE_SQL,),
)
def _episodes_sparse(spark, sf):
    from tideline.operators.series import seen, with_position

    d = with_position(sparse(spark, sf).select("cust", "day", "order_id", "v"), SPARSE, "p")
    d = E.episode_starts(d, SPARSE, F.col("v") >= 200_000, "starts")
    d = seen(d, SPARSE, {"brk": F.when(F.col("v") < 200_000, F.col("p"))}, forward=True)
    last = d.groupBy("cust").agg((F.max("p") + 1).alias("rows"))
    d = d.where("starts").join(last, "cust")
    return d.select("cust", F.col("order_id").alias("start_id"), (F.coalesce("brk", "rows") - F.col("p")).alias("n"))


@query(
    "last_match_before",
    """SELECT key, day, MAX(CASE WHEN total >= 1800000 THEN day END) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS last_hint
       FROM panel""",
    (PANEL_SQL,),
)
def _last_match(spark, sf):
    out = E.last_match_before(panel(spark, sf), DAILY, F.col("total") >= 1_800_000, 30, "last_hint")
    return out.select("key", "day", "last_hint")


# ---- rules -------------------------------------------------------------------

_SCEN_CTE = f"""scen AS (
  SELECT *, CASE WHEN run >= 3 AND n BETWEEN 2 AND 3 THEN 'S-RED' WHEN r7 >= 3000000 AND top >= 400000 AND d7 < -300000 THEN 'S-ORA'
                 WHEN top >= 250000 AND top < 400000 AND n >= 2 THEN 'S-YEL' ELSE 'S-GRN' END AS scenario
  FROM (SELECT *, p - COALESCE(MAX(CASE WHEN top >= 250000 THEN NULL ELSE p END) OVER {W}, 0) AS run,
               SUM(total) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS r7,
               total - LAG(total, 7) OVER {W} AS d7
        FROM (SELECT *, ROW_NUMBER() OVER {W} AS p FROM panel)))"""


def _scenarios(spark, sf):
    from tideline.operators.windows import streak

    d = rolling(panel(spark, sf), DAILY, {"r7": ("total", 7, "sum")})
    d = diff_n(d, DAILY, "total", 7, "d7")
    d = streak(d, DAILY, F.col("top") >= 250_000, "run")
    rules = [
        ("S-RED", (F.col("run") >= 3) & F.col("n").between(2, 3)),
        ("S-ORA", (F.col("r7") >= 3_000_000) & (F.col("top") >= 400_000) & (F.col("d7") < -300_000)),
        ("S-YEL", (F.col("top") >= 250_000) & (F.col("top") < 400_000) & (F.col("n") >= 2)),
    ]
    return d.withColumn("scenario", U.classify_first(rules, "S-GRN"))


@query("scenario_first_match", "SELECT key, day, scenario FROM scen", (PANEL_SQL, _SCEN_CTE))
def _scenario(spark, sf):
    return _scenarios(spark, sf).select("key", "day", "scenario")


@query(
    "scenario_rates",
    "SELECT scenario, COUNT(*) AS n, AVG(CASE WHEN top >= 460000 AND top < 490000 THEN 1.0 ELSE 0 END) * 100 AS rate FROM scen GROUP BY 1",
    (PANEL_SQL, _SCEN_CTE),
)
def _scenario_rates(spark, sf):
    return A.rate_by(_scenarios(spark, sf), ["scenario"], (F.col("top") >= 460_000) & (F.col("top") < 490_000))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_ACTIONS_VALUES = ", ".join(
    f"({_sql_text(sc)}, {_sql_text(level)}, {_sql_text(h)}, {i}, {_sql_text(a)})"
    for sc, (level, hs) in SCENARIO_ACTIONS.items()
    for h, acts in hs.items()
    for i, a in enumerate(acts, 1)
)


@query(
    "scenario_actions",
    f"""SELECT key, scenario, risk_level, horizon, step, action, n FROM (SELECT key, scenario, COUNT(*) AS n FROM scen GROUP BY 1, 2)
        LEFT JOIN (VALUES {_ACTIONS_VALUES}) r(scenario, risk_level, horizon, step, action) USING (scenario)""",
    (PANEL_SQL, _SCEN_CTE),
)
def _actions(spark, sf):
    counts = _scenarios(spark, sf).groupBy("key", "scenario").agg(F.count(F.lit(1)).alias("n"))
    return U.attach_actions(counts, SCENARIO_ACTIONS, "scenario").select(
        "key", "scenario", "risk_level", "horizon", "step", "action", "n"
    )


def _recommended(spark, sf):
    """Weekly rules on the panel, one compared with the table's own median."""
    d = panel(spark, sf)
    med = exact_quantiles(d, "total", [0.5], names=["ref"])
    d = d.join(F.broadcast(med), how="left")
    d = diff_n(d, DAILY, "total", 4, "slope")
    rec = {k: U.recommendation(k, *v) for k, v in WEEKLY_RULES.items() if k != "SX"}
    title, cond, expect, acts = WEEKLY_RULES["SX"]
    risk = F.least(F.col("n") / 4, F.lit(1.0))
    said = F.format_string(cond, F.format_number(risk * 100, 0), F.col("top").cast("bigint").cast("string"))
    rec["SX"] = U.recommendation("SX", title, said, expect, acts)
    rules = [
        ((F.col("top") > 450_000) & (F.col("slope") > 0), rec["S1"]),
        ((F.col("slope") > 200_000) & (F.col("total") > F.col("ref") * 1.1), rec["S2"]),
        ((F.col("slope") < 0) & (F.col("top") > 300_000), rec["S3"]),
        (F.col("n") >= 5, rec["S4"]),
        (risk >= 0.75, rec["SX"]),
    ]
    return d.withColumn("scenarios", U.match_rules(rules, rec["S0"]))


_REC_CTE = f"""hits AS (
  SELECT key, day, id, top, n FROM (
    SELECT key, day, top, n, UNNEST(CASE WHEN len(ids) > 0 THEN ids ELSE ['S0'] END) AS id FROM (
      SELECT key, day, top, n, string_split(concat_ws(',', CASE WHEN top > 450000 AND slope > 0 THEN 'S1' END,
                CASE WHEN slope > 200000 AND total > ref * 1.1 THEN 'S2' END, CASE WHEN slope < 0 AND top > 300000 THEN 'S3' END,
                CASE WHEN n >= 5 THEN 'S4' END, CASE WHEN LEAST(n / 4, 1.0) >= 0.75 THEN 'SX' END,
                CASE WHEN NOT (COALESCE(top > 450000 AND slope > 0, FALSE) OR COALESCE(slope > 200000 AND total > ref * 1.1, FALSE)
                     OR COALESCE(slope < 0 AND top > 300000, FALSE) OR n >= 5 OR LEAST(n / 4, 1.0) >= 0.75) THEN 'S0' END), ',') AS ids
      FROM (SELECT *, total - LAG(total, 4) OVER {W} AS slope, (SELECT quantile_cont(total, 0.5) FROM panel) AS ref FROM panel))))"""

_RULE_VALUES = ", ".join(
    f"({_sql_text(k)}, {_sql_text(t)}, {_sql_text(c.replace('%s%%', '{p}%').replace('%s', '{v}'))}, {_sql_text(e)}, {_sql_text(' | '.join(a))})"
    for k, (t, c, e, a) in WEEKLY_RULES.items()
)


def _activity_sql(text: str) -> str:
    cases = ", ".join(
        "CASE WHEN " + " OR ".join(f"contains({text}, {_sql_text(w)})" for w in ACTIVITY_WORDS[tag]) + f" THEN {_sql_text(tag)} END"
        for tag in sorted(ACTIVITY_WORDS)
    )
    return f"COALESCE(NULLIF(concat_ws('; ', {cases}), ''), {_sql_text(ACTIVITY_NONE)})"


@query(
    "recommendations_exploded",
    f"""SELECT key, day, scenario_id, scenario_title, condition, expectation, actions_text,
               {_activity_sql("concat_ws(' ', scenario_title, condition, expectation, actions_text)")} AS tags FROM (
          SELECT key, day, id AS scenario_id, title AS scenario_title,
                 replace(replace(cond, '{{p}}', CAST(CAST(LEAST(n / 4, 1.0) * 100 AS INTEGER) AS VARCHAR)), '{{v}}', CAST(CAST(top AS BIGINT) AS VARCHAR)) AS condition,
                 expectation, actions_text
          FROM hits JOIN (VALUES {_RULE_VALUES}) r(id, title, cond, expectation, actions_text) USING (id))""",
    (PANEL_SQL, _REC_CTE),
)
def _exploded(spark, sf):
    return U.explode_recommendations(_recommended(spark, sf), "scenarios", ACTIVITY_WORDS, ACTIVITY_NONE, ["key", "day"])


@query(
    "recommendation_counts",
    "SELECT id, COUNT(*) AS n, COUNT(DISTINCT key) AS keys FROM hits GROUP BY 1",
    (PANEL_SQL, _REC_CTE),
)
def _rec_counts(spark, sf):
    rows = _recommended(spark, sf).select("key", F.explode("scenarios").alias("r"))
    return rows.groupBy(F.col("r.id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("keys"))


_FLAT_RULES = [
    ("S1_고온건조", "level >= 40 AND p2 >= 0.5"),
    ("S2_저수위_체류", "level <= 10 AND p1 >= 0.2"),
    ("S3_관심단계_진입", "p1 >= 0.4 OR truth >= 2"),
    ("S4_경계단계_임박", "p2 >= 0.8"),
    ("S5_강우_후_유입", "level >= 30 AND l_linenumber = 1"),
]


def _flat_sql() -> str:
    ids = ", ".join(f"CASE WHEN {c} THEN {_sql_text(i)} END" for i, c in _FLAT_RULES)
    acts = ", ".join(f"CASE WHEN {c} THEN {_sql_text(' / '.join(DAILY_RULE_ACTIONS[i][:2]))} END" for i, c in _FLAT_RULES)
    return f"""SELECT rules, actions, COUNT(*) AS n FROM (
      SELECT COALESCE(NULLIF(concat_ws('|', {ids}), ''), {_sql_text(DAILY_NO_RULE[0])}) AS rules,
             COALESCE(NULLIF(concat_ws(' / ', {acts}), ''), {_sql_text(DAILY_NO_RULE[1])}) AS actions FROM predictions) GROUP BY 1, 2"""


@query("rules_all_matches_flat", _flat_sql(), (PREDICTIONS_SQL,))
def _flat(spark, sf):
    rules = [(i, F.expr(c), DAILY_RULE_ACTIONS[i]) for i, c in _FLAT_RULES]
    out = U.match_rules_flat(predictions(spark, sf), rules, DAILY_NO_RULE)
    return out.groupBy("rules", "actions").agg(F.count(F.lit(1)).alias("n"))


@query(
    "miss_types",
    f"""SELECT CASE WHEN level > 40 THEN {_sql_text(MISS_TYPES[0])} WHEN month(day) >= 9 THEN {_sql_text(MISS_TYPES[1])} ELSE {_sql_text(MISS_TYPES[2])} END AS miss_type,
               COUNT(*) AS n FROM predictions WHERE truth = 2 AND pred <> 2 GROUP BY 1""",
    (PREDICTIONS_SQL,),
)
def _misses(spark, sf):
    rain = F.col("level") * 2.5
    return U.classify_misses(predictions(spark, sf), "truth", "pred", 2, rain, F.month("day"), MISS_TYPES)


@query(
    "risk_calendar",
    f"""SELECT key, day, stage, hsi_14, csi, heat_streak,
          round_even(LEAST(GREATEST((0.25 * GREATEST(heat - 25, 0) + 0.20 * GREATEST(heat / 2 - 20, 0) + 0.15 * GREATEST(2 - rain, 0)
            + 0.15 * GREATEST((heat - 40) / 40, 0) + 0.15 * ln(1 + r7) / 10 - 0.10 * ln(1 + rain) / 10 + 0.10 * hsi_14 / 50) * 100 / 3.5, 0), 100), 1) AS risk,
          CASE WHEN heat_streak >= 3 THEN 'S-RED' WHEN r7 >= 12 THEN 'S-ORA' ELSE 'S-GRN' END AS scenario
        FROM (SELECT key, day, heat, rain, stage, hsi_14, r7, hsi_14 * (1 + r7 / 700) AS csi,
                     CAST(p - COALESCE(MAX(CASE WHEN heat >= 28 THEN NULL ELSE p END) OVER {W}, 0) AS INTEGER) AS heat_streak
              FROM (SELECT *, SUM(GREATEST(heat, 28) - 28) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS hsi_14,
                           SUM(rain) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS r7, ROW_NUMBER() OVER {W} AS p
                    FROM (SELECT key, day, stage, FLOOR(top / 10000) AS heat, CAST(n AS DOUBLE) AS rain FROM staged)))""",
    (PANEL_SQL, STAGED_SQL),
)
def _risk_calendar(spark, sf):
    d = staged(spark, sf).select(
        "key", "day", "stage", F.floor(F.col("top") / 10_000).cast("double").alias("heat"), F.col("n").cast("double").alias("rain")
    )
    d = rolling(stress_indices(d, DAILY, "heat", "rain"), DAILY, {"r7": ("rain", 7, "sum")})
    spec = {
        "air": F.col("heat"),
        "water": F.col("heat") / 2,
        "wind": F.col("rain"),
        "storage": F.col("heat"),
        "inflow7": F.col("r7"),
        "outflow": F.col("rain"),
        "heat": F.col("hsi_14"),
    }
    scenario = U.classify_first([("S-RED", F.col("heat_streak") >= 3), ("S-ORA", F.col("r7") >= 12)], "S-GRN")
    return d.select(
        "key", "day", "stage", "hsi_14", "csi", "heat_streak", risk_score(spec).alias("risk"), scenario.alias("scenario")
    )
