"""Window, resampling and join queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog.registry import query
from tideline.catalog.tables import (
    DAILY,
    GAPPY_SQL,
    PANEL_SQL,
    SPARSE,
    SPARSE_SQL,
    STAGED_SQL,
    STATIONS_SQL,
    WEEK_VALUES,
    WEEKLY_SERIES,
    WEEKLY_SQL,
    gappy,
    panel,
    read,
    sparse,
    staged,
    stations,
    supervised,
    weekly,
)
from tideline.operators import joins as J
from tideline.operators import resample as Rs
from tideline.operators import windows as Wn

W = "(PARTITION BY key ORDER BY day)"


def _w(lo: str, hi: str) -> str:
    return f"(PARTITION BY key ORDER BY day ROWS BETWEEN {lo} AND {hi})"


# ---- windows ---------------------------------------------------------------

@query(
    "lag_set",
    f"SELECT key, day, {', '.join(f'LAG(total, {n}) OVER {W} AS total_lag{n}' for n in (1, 3, 7, 14))}, "
    f"{', '.join(f'LAG(top, {n}) OVER {W} AS top_lag{n}' for n in (1, 3, 7, 14))} FROM panel",
    (PANEL_SQL,),
)
def _lags(spark, sf):
    out = Wn.lags(panel(spark, sf), DAILY, ["total", "top"], [1, 3, 7, 14])
    return out.drop("total", "top", "n")


_SW = "(PARTITION BY cust ORDER BY day, order_id)"


@query(
    "lag_set_unbounded_keys",
    f"SELECT order_id, LAG(v, 1) OVER {_SW} AS v_lag1, LAG(v, 3) OVER {_SW} AS v_lag3 FROM sparse",
    (SPARSE_SQL,),
)
def _lags_sparse(spark, sf):
    return Wn.lags(sparse(spark, sf), SPARSE, ["v"], [1, 3]).select("order_id", "v_lag1", "v_lag3")


def _strict_sql(fn: str, col: str, n: int) -> str:
    f = _w(f"{n} PRECEDING", "1 PRECEDING")
    return f"CASE WHEN COUNT({col}) OVER {f} >= {n} THEN {fn}({col}) OVER {f} END"


@query(
    "rolling_strict",
    f"""SELECT key, day, {_strict_sql('AVG', 'v', 2)} AS mean2, {_strict_sql('MAX', 'total', 7)} AS max7,
        {_strict_sql('SUM', 'total', 14)} AS sum14 FROM gappy""",
    (PANEL_SQL, GAPPY_SQL),
)
def _rolling_strict(spark, sf):
    out = Wn.rolling(
        gappy(spark, sf),
        DAILY,
        {"mean2": ("v", 2, "mean"), "max7": ("total", 7, "max"), "sum14": ("total", 14, "sum")},
        strict=True,
    )
    return out.select("key", "day", "mean2", "max7", "sum14")


@query(
    "rolling_lenient",
    f"""SELECT key, day, AVG(v) OVER {_w('6 PRECEDING', 'CURRENT ROW')} AS mean7,
        SUM(v) OVER {_w('13 PRECEDING', 'CURRENT ROW')} AS sum14 FROM gappy""",
    (PANEL_SQL, GAPPY_SQL),
)
def _rolling_lenient(spark, sf):
    out = Wn.rolling(gappy(spark, sf), DAILY, {"mean7": ("v", 7, "mean"), "sum14": ("v", 14, "sum")})
    return out.select("key", "day", "mean7", "sum14")


@query(
    "rolling_unbounded_keys",
    """SELECT order_id, SUM(v) OVER (PARTITION BY cust ORDER BY day, order_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS sum7
       FROM sparse""",
    (SPARSE_SQL,),
)
def _rolling_sparse(spark, sf):
    return Wn.rolling(sparse(spark, sf), SPARSE, {"sum7": ("v", 7, "sum")}).select("order_id", "sum7")


@query(
    "wow_delta",
    f"""SELECT key, day, m - LAG(m, 7) OVER {W} AS wow_delta_total
        FROM (SELECT key, day, AVG(total) OVER {_w('6 PRECEDING', 'CURRENT ROW')} AS m FROM panel)""",
    (PANEL_SQL,),
)
def _wow(spark, sf):
    return Wn.wow_delta(panel(spark, sf), DAILY, ["total"]).select("key", "day", "wow_delta_total")


@query("diff_seven_rows", f"SELECT key, day, total - LAG(total, 7) OVER {W} AS total_delta7 FROM panel", (PANEL_SQL,))
def _diff(spark, sf):
    return Wn.diff_n(panel(spark, sf), DAILY, "total", 7).select("key", "day", "total_delta7")


@query(
    "rising_three",
    f"""SELECT key, day, CASE WHEN v > LAG(v, 1) OVER {W} AND LAG(v, 1) OVER {W} > LAG(v, 2) OVER {W}
                               AND LAG(v, 2) OVER {W} > LAG(v, 3) OVER {W} THEN 1 ELSE 0 END AS rising FROM gappy""",
    (PANEL_SQL, GAPPY_SQL),
)
def _rising(spark, sf):
    return Wn.rising_run(gappy(spark, sf), DAILY, "v", 3, "rising").select("key", "day", "rising")


@query(
    "two_day_exceedance",
    f"""SELECT key, day, COALESCE(f, FALSE) AND COALESCE(LAG(f) OVER {W}, FALSE) AS both_days
        FROM (SELECT key, day, v >= 400000 AS f FROM gappy)""",
    (PANEL_SQL, GAPPY_SQL),
)
def _consec(spark, sf):
    d = gappy(spark, sf).withColumn("f", F.col("v") >= 400_000)
    return Wn.consecutive_true(d, DAILY, "f", "both_days").select("key", "day", "both_days")


def _streak_sql(cols: str, pred: str, table: str, w: str) -> str:
    return f"""SELECT {cols}, CAST(p - COALESCE(MAX(CASE WHEN COALESCE({pred}, FALSE) THEN NULL ELSE p END) OVER {w}, 0) AS INTEGER) AS run
        FROM (SELECT *, ROW_NUMBER() OVER {w} AS p FROM {table})"""


@query("streak_length", _streak_sql("key, day", "v >= 200000", "gappy", W), (PANEL_SQL, GAPPY_SQL))
def _streak(spark, sf):
    return Wn.streak(gappy(spark, sf), DAILY, F.col("v") >= 200_000, "run").select("key", "day", "run")


@query("streak_unbounded_keys", _streak_sql("order_id", "v >= 150000", "sparse", _SW), (SPARSE_SQL,))
def _streak_sparse(spark, sf):
    return Wn.streak(sparse(spark, sf), SPARSE, F.col("v") >= 150_000, "run").select("order_id", "run")


@query(
    "degree_sums",
    f"""SELECT key, day,
          SUM(GREATEST(v, 200000) - 200000 + (v - v)) OVER {_w('13 PRECEDING', 'CURRENT ROW')} AS lenient14,
          {_strict_sql('SUM', 'g', 7)} AS strict7
        FROM (SELECT *, CASE WHEN total IS NOT NULL THEN GREATEST(total, 100000) END AS g FROM gappy)""",
    (PANEL_SQL, GAPPY_SQL),
)
def _degree(spark, sf):
    out = Wn.clipped_sum(gappy(spark, sf), DAILY, "v", 200_000, 14, "lenient14")
    out = Wn.clipped_sum(out, DAILY, "total", 100_000, 7, "strict7", subtract=False, strict=True)
    return out.select("key", "day", "lenient14", "strict7")


@query(
    "stress_indices",
    f"""SELECT key, day, hsi_14, hsi_7, r7 / 700 AS hli_7, r14 / 1400 AS hli_14, hsi_14 * (1 + r7 / 700) AS csi,
               CAST(p - COALESCE(MAX(CASE WHEN heat >= 28 THEN NULL ELSE p END) OVER {W}, 0) AS INTEGER) AS heat_streak
        FROM (SELECT *, SUM(GREATEST(heat, 28) - 28) OVER {_w('13 PRECEDING', 'CURRENT ROW')} AS hsi_14,
                     SUM(GREATEST(heat, 28) - 28) OVER {_w('6 PRECEDING', 'CURRENT ROW')} AS hsi_7,
                     SUM(rain) OVER {_w('6 PRECEDING', 'CURRENT ROW')} AS r7,
                     SUM(rain) OVER {_w('13 PRECEDING', 'CURRENT ROW')} AS r14, ROW_NUMBER() OVER {W} AS p
              FROM (SELECT key, day, FLOOR(top / 10000) AS heat, CAST(n AS DOUBLE) AS rain FROM panel))""",
    (PANEL_SQL,),
)
def _stress(spark, sf):
    d = panel(spark, sf).select(
        "key", "day", F.floor(F.col("top") / 10_000).cast("double").alias("heat"), F.col("n").cast("double").alias("rain")
    )
    out = Wn.stress_indices(d, DAILY, "heat", "rain")
    return out.select("key", "day", "hsi_14", "hsi_7", "hli_7", "hli_14", "csi", "heat_streak")


@query("lead_label_seven", f"SELECT key, day, LEAD(stage, 7) OVER {W} AS target FROM staged", (PANEL_SQL, STAGED_SQL))
def _lead(spark, sf):
    return Wn.lead_label(staged(spark, sf), DAILY, "stage", 7, "target").select("key", "day", "target")


@query(
    "framed_max_labels",
    f"""SELECT key, day, MAX(stage) OVER {_w('1 FOLLOWING', '7 FOLLOWING')} AS next7,
               MAX(stage) OVER {_w('5 PRECEDING', '1 FOLLOWING')} AS shifted7 FROM staged""",
    (PANEL_SQL, STAGED_SQL),
)
def _frame_max(spark, sf):
    out = Wn.frame_max(staged(spark, sf), DAILY, "stage", 1, 7, "next7")
    return Wn.frame_max(out, DAILY, "stage", -5, 1, "shifted7").select("key", "day", "next7", "shifted7")


def lookback_sql(periods: int = 4, tag: str | None = None) -> str:
    """The look-back table of ``weekly`` as a SQL body."""
    tag = tag or f"lw{periods}"
    w = "(PARTITION BY key ORDER BY week_start)"
    f = f"(PARTITION BY key ORDER BY week_start ROWS BETWEEN {periods} PRECEDING AND 1 PRECEDING)"
    f2 = "(PARTITION BY key ORDER BY week_start ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)"
    cols = []
    for v in WEEK_VALUES:
        cols += [
            f"AVG({v}) OVER {f} AS {tag}_mean_{v}",
            f"STDDEV_POP({v}) OVER {f} AS {tag}_std_{v}",
            f"LAG({v}, 1) OVER {w} - LAG({v}, {periods}) OVER {w} AS {tag}_slope_{v}",
        ]
    for v in ["total_max", "top_max", "stage_max"]:
        cols += [f"AVG({v}) OVER {f2} AS lw2_mean_{v}", f"LAG({v}, 1) OVER {w} AS lw1_{v}"]
    for v in ["stage_max", "top_max"]:
        cols.append(f"LAG({v}, 1) OVER {w} AS persist_{v}")
    return f"""SELECT * EXCLUDE (__rn) FROM (
      SELECT *, top_max AS y_max, total_mean AS y_mean, LEAST(stage_max, 3) AS y_stage,
             CASE WHEN stage_max >= 2 THEN 1 ELSE 0 END AS y_alert,
             ROW_NUMBER() OVER {w} AS __rn, {', '.join(cols)} FROM weekly)
      WHERE __rn > {max(periods, 2)}"""


SUPERVISED_SQL = f"supervised AS ({lookback_sql(4)})"

def _rounded_sql(periods: int) -> str:
    names = [f"lw{periods}_std_{v}" for v in WEEK_VALUES]
    stds = ", ".join(f"ROUND({n}, 2) AS {n}" for n in names)
    return f"SELECT * EXCLUDE ({', '.join(names)}), {stds} FROM ({lookback_sql(periods)})"


def _rounded(df, periods):
    return df.withColumns({n: F.round(n, 2) for n in [f"lw{periods}_std_{v}" for v in WEEK_VALUES]})


@query("weekly_rollup", "SELECT * FROM weekly", (PANEL_SQL, WEEKLY_SQL))
def _weekly(spark, sf):
    return weekly(spark, sf)


@query("weekly_supervised", _rounded_sql(4), (PANEL_SQL, WEEKLY_SQL))
def _supervised(spark, sf):
    return _rounded(supervised(spark, sf, 4), 4)


@query("weekly_supervised_three", _rounded_sql(3), (PANEL_SQL, WEEKLY_SQL))
def _supervised3(spark, sf):
    return _rounded(supervised(spark, sf, 3), 3)


@query("weekly_supervised_five", _rounded_sql(5), (PANEL_SQL, WEEKLY_SQL))
def _supervised5(spark, sf):
    return _rounded(supervised(spark, sf, 5), 5)


@query(
    "persistence_columns",
    """SELECT key, week_start, persist_stage, persist_top FROM (
         SELECT *, ROW_NUMBER() OVER w AS rn, LAG(stage_max) OVER w AS persist_stage, LAG(top_max) OVER w AS persist_top
         FROM weekly WINDOW w AS (PARTITION BY key ORDER BY week_start)) WHERE rn > 4""",
    (PANEL_SQL, WEEKLY_SQL),
)
def _persistence(spark, sf):
    out = Wn.persistence(weekly(spark, sf), WEEKLY_SERIES, {"persist_stage": "stage_max", "persist_top": "top_max"}, skip=4)
    return out.select("key", "week_start", "persist_stage", "persist_top")


@query(
    "trailing_sequences",
    """SELECT key, week_start, t0, t1, t2, t3, s0, s3 FROM (
         SELECT key, week_start, ROW_NUMBER() OVER w AS rn, LAG(top_max, 4) OVER w AS t0, LAG(top_max, 3) OVER w AS t1,
                LAG(top_max, 2) OVER w AS t2, LAG(top_max, 1) OVER w AS t3,
                CAST(LAG(stage_max, 4) OVER w AS DOUBLE) AS s0, CAST(LAG(stage_max, 1) OVER w AS DOUBLE) AS s3
         FROM weekly WINDOW w AS (PARTITION BY key ORDER BY week_start)) WHERE rn > 4""",
    (PANEL_SQL, WEEKLY_SQL),
)
def _sequences(spark, sf):
    out = Wn.sequences(weekly(spark, sf), WEEKLY_SERIES, ["top_max", "stage_max"], 4)
    seq = F.col("sequence")
    return out.select(
        "key", "week_start", *[seq[i][0].alias(f"t{i}") for i in range(4)], seq[0][1].alias("s0"), seq[3][1].alias("s3")
    )


# ---- resampling --------------------------------------------------------------

_GROWTH_CTE = """grown AS (
  SELECT cust, day + CAST(i AS INTEGER) AS day,
         CASE WHEN nd IS NULL THEN v ELSE (v + 1e-6) * exp(ln((nv + 1e-6) / (v + 1e-6)) / (nd - day) * i) END AS v
  FROM (SELECT *, UNNEST(CASE WHEN nd IS NULL THEN [0] ELSE range(0, nd - day) END) AS i
        FROM (SELECT *, LEAD(day) OVER (PARTITION BY cust ORDER BY day, order_id) AS nd,
                     LEAD(v) OVER (PARTITION BY cust ORDER BY day, order_id) AS nv FROM sparse)))"""


@query(
    "expand_growth",
    """SELECT cust, CAST(year(day) AS INTEGER) AS year, COUNT(*) AS days, ROUND(AVG(v), 2) AS mean_v, ROUND(MAX(v), 2) AS max_v
       FROM grown GROUP BY 1, 2""",
    (SPARSE_SQL, _GROWTH_CTE),
)
def _growth(spark, sf):
    out = Rs.expand_growth(sparse(spark, sf), SPARSE, ["v"])
    return out.groupBy("cust", F.year("day").alias("year")).agg(
        F.count(F.lit(1)).alias("days"), F.round(F.avg("v"), 2).alias("mean_v"), F.round(F.max("v"), 2).alias("max_v")
    )


_INTERP_CTE = """interp AS (
  SELECT *, COALESCE(v, CASE WHEN bp IS NULL THEN av ELSE av + (bv - av) * (p - ap) / (bp - ap) END) AS filled, p - ap AS gone
  FROM (SELECT *, MAX(CASE WHEN v IS NOT NULL THEN p END) OVER (PARTITION BY key ORDER BY p) AS ap,
               LAST_VALUE(v IGNORE NULLS) OVER (PARTITION BY key ORDER BY p ROWS UNBOUNDED PRECEDING) AS av,
               MIN(CASE WHEN v IS NOT NULL THEN p END) OVER (PARTITION BY key ORDER BY p DESC) AS bp,
               LAST_VALUE(v IGNORE NULLS) OVER (PARTITION BY key ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS bv
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY key ORDER BY day) - 1 AS p FROM gappy)))"""


@query("interpolate_linear", "SELECT key, day, filled AS v FROM interp", (PANEL_SQL, GAPPY_SQL, _INTERP_CTE))
def _interpolate(spark, sf):
    return Rs.interpolate_linear(gappy(spark, sf), DAILY, ["v"]).select("key", "day", "v")


@query(
    "interpolate_limited",
    "SELECT key, day, CASE WHEN v IS NOT NULL OR gone <= 5 THEN filled END AS v FROM interp",
    (PANEL_SQL, GAPPY_SQL, _INTERP_CTE),
)
def _interpolate_limited(spark, sf):
    return Rs.interpolate_linear(gappy(spark, sf), DAILY, ["v"], limit=5).select("key", "day", "v")


@query(
    "fill_edges_and_ffill_zero",
    f"""SELECT key, day,
          COALESCE(v, LAST_VALUE(v IGNORE NULLS) OVER (PARTITION BY key ORDER BY day DESC ROWS UNBOUNDED PRECEDING),
                   LAST_VALUE(v IGNORE NULLS) OVER (PARTITION BY key ORDER BY day ROWS UNBOUNDED PRECEDING)) AS edges,
          COALESCE(LAST_VALUE(v IGNORE NULLS) OVER (PARTITION BY key ORDER BY day ROWS UNBOUNDED PRECEDING), 0) AS forward
        FROM gappy""",
    (PANEL_SQL, GAPPY_SQL),
)
def _edges(spark, sf):
    d = gappy(spark, sf).select("key", "day", F.col("v").alias("edges"), F.col("v").alias("forward"))
    return Rs.ffill_zero(Rs.fill_edges(d, DAILY, ["edges"]), DAILY, ["forward"])


@query(
    "ffill_unbounded_keys",
    """SELECT order_id, COALESCE(LAST_VALUE(x IGNORE NULLS) OVER (PARTITION BY cust ORDER BY day, order_id ROWS UNBOUNDED PRECEDING), 0) AS x
       FROM (SELECT *, CASE WHEN order_id % 3 <> 0 THEN v END AS x FROM sparse)""",
    (SPARSE_SQL,),
)
def _ffill_sparse(spark, sf):
    d = sparse(spark, sf).withColumn("x", F.when(F.col("order_id") % 3 != 0, F.col("v")))
    return Rs.ffill_zero(d, SPARSE, ["x"]).select("order_id", "x")


@query(
    "fill_chain",
    """SELECT key, day, COALESCE(filled, LAST_VALUE(filled IGNORE NULLS) OVER (PARTITION BY key ORDER BY day DESC ROWS UNBOUNDED PRECEDING), m, 0) AS v
       FROM interp LEFT JOIN (SELECT key AS k, quantile_cont(v, 0.5) AS m FROM gappy GROUP BY 1) ON k = key""",
    (PANEL_SQL, GAPPY_SQL, _INTERP_CTE),
)
def _fill_chain(spark, sf):
    return Rs.fill_chain(gappy(spark, sf), DAILY, ["v"]).select("key", "day", "v")


@query(
    "station_rollup",
    "SELECT day, ROUND(AVG(qty), 4) AS qty, AVG(qty_max) AS qty_max FROM stations GROUP BY 1",
    (STATIONS_SQL,),
)
def _stations(spark, sf):
    out = Rs.average_over(stations(spark, sf), ["day"], ["qty", "qty_max"])
    return out.select("day", F.round("qty", 4).alias("qty"), "qty_max")


# ---- joins -------------------------------------------------------------------

@query(
    "attach_on_key_and_day",
    """SELECT p.key, p.day, p.total, q.n_open FROM panel p LEFT JOIN (
         SELECT o_orderpriority AS key, CAST(o_orderdate AS DATE) AS day, COUNT(*) AS n_open
         FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2) q ON p.key = q.key AND p.day = q.day""",
    (PANEL_SQL,),
)
def _attach(spark, sf):
    opened = (
        read(spark, sf, "orders")
        .where(F.col("o_orderstatus") == "O")
        .groupBy(F.col("o_orderpriority").alias("key"), F.to_date("o_orderdate").alias("day"))
        .agg(F.count(F.lit(1)).alias("n_open"))
    )
    return J.attach(panel(spark, sf), opened, ["key", "day"]).select("key", "day", "total", "n_open")


@query(
    "attach_daily_series",
    """SELECT key, p.day, total, qty_max FROM panel p LEFT JOIN (
         SELECT day, AVG(qty_max) AS qty_max FROM stations GROUP BY 1) s ON p.day = s.day""",
    (PANEL_SQL, STATIONS_SQL),
)
def _attach_daily(spark, sf):
    series = Rs.average_over(stations(spark, sf), ["day"], ["qty_max"])
    return J.attach_daily(panel(spark, sf), series, "day").select("key", "day", "total", "qty_max")


@query(
    "align_mean_with_default",
    """SELECT key, p.day, COALESCE(m, 1.0 / 3) AS aligned_share FROM panel p LEFT JOIN (
         SELECT CAST(l_shipdate AS DATE) AS day, AVG(l_linenumber) AS m FROM lineitem WHERE l_quantity > 45 GROUP BY 1) q
       ON p.day = q.day""",
    (PANEL_SQL,),
)
def _align(spark, sf):
    other = (
        read(spark, sf, "lineitem")
        .where(F.col("l_quantity") > 45)
        .select(F.to_date("l_shipdate").alias("day"), F.col("l_linenumber").alias("share"))
    )
    return J.align_mean(panel(spark, sf), other, "day", ["share"], 1.0 / 3).select("key", "day", "aligned_share")


@query(
    "rows_after_events",
    """SELECT e.key, e.day AS event_day, COUNT(*) AS n, SUM(p.total) AS total, MIN(p.day) AS first_day
       FROM panel e JOIN panel p ON p.key = e.key AND p.day > e.day AND p.day <= e.day + 21
       WHERE e.top >= 490000 GROUP BY 1, 2""",
    (PANEL_SQL,),
)
def _after(spark, sf):
    p = panel(spark, sf)
    ev = p.where(F.col("top") >= 490_000).select("key", F.col("day").alias("event_day"))
    pairs = J.after_events(ev, p, ["key"], "event_day", "day", 21)
    return pairs.groupBy("key", "event_day").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total").alias("total"), F.min("day").alias("first_day")
    )


@query(
    "rows_before_events",
    """SELECT e.key, e.day AS event_day, COUNT(*) AS n, MAX(p.top) AS top
       FROM panel e JOIN panel p ON p.key = e.key AND p.day < e.day AND p.day >= e.day - 7
       WHERE e.top >= 490000 GROUP BY 1, 2""",
    (PANEL_SQL,),
)
def _before(spark, sf):
    p = panel(spark, sf)
    ev = p.where(F.col("top") >= 490_000).select("key", F.col("day").alias("event_day"))
    pairs = J.before_events(ev, p, ["key"], "event_day", "day", 7)
    return pairs.groupBy("key", "event_day").agg(F.count(F.lit(1)).alias("n"), F.max("top").alias("top"))


@query(
    "range_totals_unbounded_keys",
    """SELECT e.order_id, COUNT(r.order_id) AS orders_after, COALESCE(SUM(r.v), 0) AS value_after
       FROM sparse e LEFT JOIN sparse r ON r.cust = e.cust AND r.day > e.day AND r.day <= e.day + 90
       WHERE e.v >= 450000 GROUP BY 1""",
    (SPARSE_SQL,),
)
def _range_totals(spark, sf):
    d = sparse(spark, sf)
    ev = d.where(F.col("v") >= 450_000).select("cust", F.col("day").alias("at"), "order_id")
    out = J.range_totals(
        ev, d, ["cust"], "at", "day", 1, 90, {"orders_after": F.lit(1).cast("long"), "value_after": F.col("v")}
    )
    return out.select("order_id", "orders_after", "value_after")


@query(
    "mark_days_before_events",
    """SELECT key, day, CASE WHEN EXISTS (SELECT 1 FROM panel e WHERE e.key = p.key AND e.top >= 490000
                                           AND p.day >= e.day - 7 AND p.day < e.day) THEN 1 ELSE 0 END AS own,
              CASE WHEN EXISTS (SELECT 1 FROM panel e WHERE e.top >= 497000
                                 AND p.day >= e.day - 7 AND p.day < e.day) THEN 1 ELSE 0 END AS any_key
       FROM panel p""",
    (PANEL_SQL,),
)
def _mark(spark, sf):
    p = panel(spark, sf)
    ev = p.select("key", F.col("day").alias("at"), "top")
    out = J.mark_in_windows(p, ev.where(F.col("top") >= 490_000), ["key"], "day", "at", 7, "own")
    out = J.mark_in_windows(out, ev.where(F.col("top") >= 497_000), [], "day", "at", 7, "any_key")
    return out.select("key", "day", "own", "any_key")
