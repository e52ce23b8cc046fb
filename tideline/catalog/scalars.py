"""Scalar functions, filters, typing and sources over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog.registry import query
from tideline.catalog.tables import (
    KINDS,
    PANEL_SQL,
    PREDICTIONS_SQL,
    ROW_CUTS,
    SPARSE_SQL,
    USER_DAYS_SQL,
    panel,
    predictions,
    read,
    sparse,
    user_days,
)
from tideline.fixed_values import BAND_CUTS, BAND_NAMES
from tideline.functions import rows as R
from tideline.functions import stages as St
from tideline.functions.calendar import between_dates, calendar_features, only_months, season_label
from tideline.functions.text import tag_text
from tideline.operators.joins import prefer_right
from tideline.operators.quantiles import median_impute
from tideline.operators.ranking import encode_key
from tideline.session import scratch_path
from tideline.sources.readers import read_optional, read_panel, read_recommendations
from tideline.sources.schema import coerce_types, drop_missing, drop_optional, normalize_headers, require_columns
from tideline.sources.writers import write_table


@query(
    "coerce_types",
    """
    SELECT o_orderkey, TRY_CAST(raw AS DOUBLE) AS price, TRY_CAST(raw_day AS DATE) AS day
    FROM (SELECT o_orderkey,
                 CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE CAST(FLOOR(o_totalprice) AS VARCHAR) END AS raw,
                 CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS raw_day
          FROM orders)
    """,
)
def _coerce(spark, sf):
    o = read(spark, sf, "orders")
    raw = o.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.floor("o_totalprice").cast("string")).alias("price"),
        F.when(F.col("o_orderkey") % 5 == 0, "-").otherwise(F.to_date("o_orderdate").cast("string")).alias("day"),
    )
    return coerce_types(raw, ["price"], ["day"])


@query(
    "normalize_headers_drop_columns",
    "SELECT c_custkey AS customer, c_mktsegment AS segment, c_acctbal AS balance FROM customer WHERE c_acctbal IS NOT NULL",
)
def _headers(spark, sf):
    c = read(spark, sf, "customer").toDF(" c_custkey ", "c_name", "c_nationkey", "c\nacctbal", "c_mktsegment  ")
    out = normalize_headers(c, {"c_custkey": "customer", "c acctbal": "balance", "c_mktsegment": "segment"})
    return drop_optional(drop_missing(out, ["balance"]), ["c_name", "c_nationkey", "not_there"])


@query("csv_round_trip", "SELECT key, day, total, top, n FROM panel", (PANEL_SQL,))
def _csv(spark, sf):
    path = scratch_path(spark, "csv_round_trip")
    write_table(panel(spark, sf), path, "csv")
    return read_panel(spark, path, "key string, day date, total double, top double, n bigint")


@query(
    "csv_legacy_code_page",
    "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE o_orderstatus WHEN 'F' THEN '관심' WHEN 'O' THEN '경계' ELSE '미발령' END AS stage_name FROM orders",
)
def _cp949(spark, sf):
    names = F.when(F.col("o_orderstatus") == "F", "관심").when(F.col("o_orderstatus") == "O", "경계").otherwise("미발령")
    path = scratch_path(spark, "csv_legacy_code_page")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    out = read(spark, sf, "orders").select("o_orderkey", names.alias("stage_name"))
    out.write.mode("overwrite").option("header", True).option("encoding", "x-windows-949").csv(path)
    return read_panel(spark, path, "o_orderkey bigint, stage_name string", encoding="cp949")


@query(
    "stage_from_value_flags",
    """
    SELECT order_id, CASE WHEN v >= 450000 THEN 3 WHEN v >= 250000 THEN 2 WHEN v >= 100000 THEN 1 ELSE 0 END AS stage,
           COALESCE(v >= 100000, FALSE) AS over_1, COALESCE(v >= 250000, FALSE) AS over_2,
           COALESCE(v >= 450000, FALSE) AS over_3,
           LEAST(CASE WHEN v >= 450000 THEN 3 WHEN v >= 250000 THEN 2 WHEN v >= 100000 THEN 1 ELSE 0 END, 2) AS clamped,
           CASE WHEN v >= 100000 THEN 1 ELSE 0 END AS alert
    FROM (SELECT order_id, CASE WHEN order_id % 11 = 0 THEN NULL ELSE v END AS v FROM sparse)
    """,
    (SPARSE_SQL,),
)
def _stages(spark, sf):
    d = sparse(spark, sf).withColumn("v", F.when(F.col("order_id") % 11 != 0, F.col("v")))
    stage = St.stage_from_value(F.col("v"), ROW_CUTS)
    return d.select(
        "order_id",
        stage.alias("stage"),
        *[St.exceeds(F.col("v"), c).alias(f"over_{i}") for i, c in enumerate(ROW_CUTS, 1)],
        St.clamp(stage, 0, 2).alias("clamped"),
        St.at_least(stage, 1).alias("alert"),
    )


@query(
    "stage_from_label_and_back",
    """
    SELECT o_orderpriority, code, names[LEAST(GREATEST(code, 0), 2) + 1] AS label, COUNT(*) AS n
    FROM (SELECT o_orderpriority, ['low', 'mid', 'high'] AS names,
                 CASE TRIM(o_orderpriority) WHEN '5-LOW' THEN 0 WHEN '3-MEDIUM' THEN 1
                      ELSE CASE WHEN o_orderpriority LIKE '%URG%' THEN 3 WHEN o_orderpriority LIKE '%HIGH%' THEN 2 ELSE 0 END
                 END AS code
          FROM orders)
    GROUP BY 1, 2, 3
    """,
)
def _labels(spark, sf):
    code = St.stage_from_label(
        F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" ")),
        {"5-LOW": 0, "3-MEDIUM": 1},
        {"URG": 3, "HIGH": 2},
    )
    o = read(spark, sf, "orders").withColumn("code", code)
    label = St.label_from_code(F.col("code"), ["low", "mid", "high"])
    return o.groupBy("o_orderpriority", "code", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "between_dates_months_key",
    """
    SELECT key, day, total FROM panel
    WHERE day BETWEEN DATE '1996-03-01' AND DATE '1999-09-30' AND month(day) IN (6, 7, 8, 9) AND key = '5-LOW'
    """,
    (PANEL_SQL,),
)
def _dates(spark, sf):
    out = between_dates(panel(spark, sf), "day", "1996-03-01", "1999-09-30")
    return only_months(out, "day", [6, 7, 8, 9]).where(F.col("key") == "5-LOW").select("key", "day", "total")


@query(
    "fill_from_and_prefer_right",
    """
    SELECT o.o_orderkey, c.c_acctbal AS amount,
           COALESCE(CASE WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE o.o_totalprice END, c.c_acctbal, 0.0) AS filled
    FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey
    """,
)
def _fill_from(spark, sf):
    o = read(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("cust"),
        F.col("o_totalprice").alias("amount"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("own"),
    )
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("cust"), F.col("c_acctbal").alias("amount"))
    out = prefer_right(o, c, ["cust"], ["amount"])
    return out.select("o_orderkey", "amount", R.fill_from(F.col("own"), F.col("amount"), F.lit(0.0)).alias("filled"))


_SUM = "(" + " + ".join(f"COALESCE(CAST(\"{k}\" AS DOUBLE), 0)" for k in KINDS) + ")"
_GREATEST = "GREATEST(" + ", ".join(f'"{k}"' for k in KINDS) + ")"


@query(
    "row_sum_shares_dominant",
    f"""
    SELECT key, day, {_SUM} AS total,
           {", ".join(f'"{k}" / ({_SUM} + 1e-6) AS {k}_dom' for k in KINDS)},
           CASE {" ".join(f"WHEN \"{k}\" = {_GREATEST} THEN '{k}'" for k in KINDS)} END AS dominant
    FROM user_days
    """,
    (USER_DAYS_SQL,),
)
def _shares(spark, sf):
    u = user_days(spark, sf)
    out = R.shares(u, KINDS).withColumn("total", R.row_sum(KINDS)).withColumn("dominant", R.argmax_label(KINDS))
    return out.select("key", "day", "total", *[f"{k}_dom" for k in KINDS], "dominant")


@query(
    "bin_by_edges",
    """
    SELECT left_bin, right_bin, COUNT(*) AS n FROM (
      SELECT CASE WHEN l_quantity >= 5 AND l_quantity < 20 THEN 'a' WHEN l_quantity >= 20 AND l_quantity < 35 THEN 'b'
                  WHEN l_quantity >= 35 AND l_quantity < 50 THEN 'c' END AS left_bin,
             CASE WHEN l_quantity > 5 AND l_quantity <= 20 THEN 'a' WHEN l_quantity > 20 AND l_quantity <= 35 THEN 'b'
                  WHEN l_quantity > 35 AND l_quantity <= 50 THEN 'c' END AS right_bin
      FROM lineitem) GROUP BY 1, 2
    """,
)
def _bins(spark, sf):
    q, edges, names = F.col("l_quantity"), [5, 20, 35, 50], ["a", "b", "c"]
    return (
        read(spark, sf, "lineitem")
        .groupBy(R.bin_by(q, edges, names).alias("left_bin"), R.bin_by(q, edges, names, right=True).alias("right_bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "calendar_and_cyclic_parts",
    """
    SELECT day, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month,
           CAST(dayofyear(day) AS INTEGER) AS day_of_year, CAST(weekofyear(day) AS INTEGER) AS week_of_year,
           CAST((month(day) % 12) // 3 AS INTEGER) AS season,
           CASE WHEN month(day) BETWEEN 6 AND 8 THEN 1 ELSE 0 END AS summer,
           CASE (month(day) % 12) // 3 WHEN 0 THEN 'winter' WHEN 1 THEN 'spring' WHEN 2 THEN 'summer' ELSE 'autumn' END AS season_name,
           ROUND(sin(2 * pi() * month(day) / 12), 6) + 0 AS sin_month, ROUND(cos(2 * pi() * month(day) / 12), 6) + 0 AS cos_month,
           n
    FROM (SELECT CAST(l_shipdate AS DATE) AS day, COUNT(*) AS n FROM lineitem GROUP BY 1)
    """,
)
def _calendar(spark, sf):
    d = read(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    sin, cos = R.cyclic(F.col("month"), 12)
    names = ["winter", "spring", "summer", "autumn"]
    return calendar_features(d, "day").select(
        "*",
        season_label(F.col("month"), names).alias("season_name"),
        (F.round(sin, 6) + 0).alias("sin_month"),
        (F.round(cos, 6) + 0).alias("cos_month"),
    )


@query(
    "log_transform_and_differences",
    """
    SELECT c_custkey, ROUND(ln(GREATEST(c_acctbal, 0) + 1), 6) AS logged,
           ROUND(GREATEST(exp(ln(GREATEST(c_acctbal, 0) + 1)) - 1, 0), 2) AS back,
           c_acctbal - c_nationkey AS difference, GREATEST(c_acctbal, 1000.0) AS floored
    FROM customer
    """,
)
def _log(spark, sf):
    b = F.col("c_acctbal")
    return read(spark, sf, "customer").select(
        "c_custkey",
        F.round(R.to_log(b), 6).alias("logged"),
        F.round(R.from_log(R.to_log(b)), 2).alias("back"),
        (b - F.col("c_nationkey")).alias("difference"),
        R.floor_at(b, 1000.0).alias("floored"),
    )


_NULLED = """nulled AS (
  SELECT order_id, day, CASE WHEN order_id % 4 = 0 THEN NULL ELSE v END AS a,
         CASE WHEN order_id % 6 = 0 THEN NULL ELSE CAST(cust AS DOUBLE) END AS b FROM sparse)"""


@query(
    "median_impute_train_scope",
    """
    SELECT order_id, COALESCE(a, (SELECT quantile_cont(a, 0.5) FROM nulled WHERE day < DATE '2000-01-01')) AS a,
           COALESCE(b, (SELECT quantile_cont(b, 0.5) FROM nulled WHERE day < DATE '2000-01-01')) AS b
    FROM nulled
    """,
    (SPARSE_SQL, _NULLED),
)
def _impute(spark, sf):
    d = sparse(spark, sf).select(
        "order_id",
        "day",
        F.when(F.col("order_id") % 4 != 0, F.col("v")).alias("a"),
        F.when(F.col("order_id") % 6 != 0, F.col("cust").cast("double")).alias("b"),
    )
    out = median_impute(d, ["a", "b"], fit_on=F.col("day") < F.to_date(F.lit("2000-01-01")))
    return out.select("order_id", "a", "b")


@query(
    "encode_key_sorted",
    "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS INTEGER) AS name_code FROM customer",
)
def _encode_sorted(spark, sf):
    return encode_key(read(spark, sf, "customer"), "c_name", "name_code").select("c_custkey", "name_code")


@query(
    "encode_key_first_seen",
    """
    SELECT o_orderkey, code FROM orders JOIN (
      SELECT o_custkey, CAST(row_number() OVER (ORDER BY f) - 1 AS INTEGER) AS code
      FROM (SELECT o_custkey, MIN(o_orderkey) AS f FROM orders GROUP BY 1)) USING (o_custkey)
    """,
)
def _encode_first(spark, sf):
    return encode_key(read(spark, sf, "orders"), "o_custkey", "code", first_seen=["o_orderkey"]).select(
        "o_orderkey", "code"
    )


_RISK_SQL = """
SELECT score, score_zero_missing, COUNT(*) AS n FROM (
  SELECT CASE WHEN air IS NOT NULL THEN round_even(LEAST(GREATEST((0.25 * CASE WHEN air IS NOT NULL THEN GREATEST(air - 25, 0) END + 0.20 * GREATEST(water - 20, 0) + 0.15 * GREATEST(2 - wind, 0)
           + 0.15 * GREATEST((storage - 40) / 40, 0) + 0.15 * ln(1 + inflow) / 10 - 0.10 * ln(1 + outflow) / 10
           + 0.10 * heat / 50) * 100 / 3.5, 0), 100), 1) END AS score,
         round_even(LEAST(GREATEST((0.25 * GREATEST(air_z - 25, 0) + 0.20 * GREATEST(water_z - 20, 0) + 0.15 * GREATEST(2 - wind_z, 0)
           + 0.15 * GREATEST((storage_z - 40) / 40, 0) + 0.15 * ln(1 + inflow_z) / 10 - 0.10 * ln(1 + outflow_z) / 10
           + 0.10 * heat_z / 50) * 100 / 3.5, 0), 100), 1) AS score_zero_missing
  FROM (SELECT *, CASE WHEN air IS NULL OR air = 0 THEN 0 ELSE air END AS air_z, CASE WHEN water IS NULL OR water = 0 THEN 0 ELSE water END AS water_z,
               CASE WHEN wind IS NULL OR wind = 0 THEN 2 ELSE wind END AS wind_z, CASE WHEN storage IS NULL OR storage = 0 THEN 50 ELSE storage END AS storage_z,
               CASE WHEN inflow IS NULL OR inflow = 0 THEN 0 ELSE inflow END AS inflow_z, CASE WHEN outflow IS NULL OR outflow = 0 THEN 0 ELSE outflow END AS outflow_z,
               CASE WHEN heat IS NULL OR heat = 0 THEN 0 ELSE heat END AS heat_z
        FROM risk))
WHERE score_zero_missing IS NOT NULL GROUP BY 1, 2
"""
_RISK_CTE = """risk AS (
  SELECT CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_quantity / 1.7 END AS air, l_quantity / 2.3 AS water,
         CAST(l_linenumber AS DOUBLE) - 1 AS wind, CAST(l_suppkey % 100 AS DOUBLE) AS storage,
         FLOOR(l_extendedprice / 100) AS inflow, CAST(l_partkey % 300 AS DOUBLE) AS outflow, l_tax * 1000 AS heat
  FROM lineitem)"""


def _risk_inputs(spark, sf):
    return read(spark, sf, "lineitem").select(
        F.when(F.col("l_orderkey") % 9 != 0, F.col("l_quantity") / 1.7).alias("air"),
        (F.col("l_quantity") / 2.3).alias("water"),
        (F.col("l_linenumber").cast("double") - 1).alias("wind"),
        (F.col("l_suppkey") % 100).cast("double").alias("storage"),
        F.floor(F.col("l_extendedprice") / 100).cast("double").alias("inflow7"),
        (F.col("l_partkey") % 300).cast("double").alias("outflow"),
        (F.col("l_tax") * 1000).alias("heat"),
    )


@query("risk_score_both_modes", _RISK_SQL, (_RISK_CTE,))
def _risk(spark, sf):
    d = _risk_inputs(spark, sf)
    spec = {k: F.col(k) for k in ["air", "water", "wind", "storage", "inflow7", "outflow", "heat"]}
    return (
        d.groupBy(R.risk_score(spec).alias("score"), R.risk_score(spec, zero_is_missing=True).alias("score_zero_missing"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("score_zero_missing").isNotNull())
    )


TAG_WORDS = {"water": ["eau", "and"], "life": ["vie", "ing"], "order": ["tion", "er "], "under": ["unter"]}


def _tags_sql(text: str) -> str:
    def hit(ws):
        return " OR ".join(f"contains({text}, '{w}')" for w in ws)

    cases = ", ".join(f"CASE WHEN {hit(TAG_WORDS[tag])} THEN '{tag}' END" for tag in sorted(TAG_WORDS))
    return f"COALESCE(NULLIF(concat_ws('; ', {cases}), ''), '(none)')"


@query("tag_documents", f"SELECT doc_id, {_tags_sql('text')} AS tags FROM documents")
def _tag_documents(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", tag_text(F.col("text"), TAG_WORDS, "(none)").alias("tags"))


@query(
    "tag_conversations",
    f"SELECT role, {_tags_sql('text')} AS tags, COUNT(*) AS n FROM conversations GROUP BY 1, 2",
)
def _tag_conversations(spark, sf):
    c = read(spark, sf, "conversations")
    return c.groupBy("role", tag_text(F.col("text"), TAG_WORDS, "(none)").alias("tags")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "prob_bands",
    """
    SELECT CASE WHEN p2 >= 0.7 THEN '경계 가능성↑' WHEN p2 >= 0.5 THEN '관심 가능성↑' WHEN p2 >= 0.3 THEN '주의' ELSE '정상' END AS band,
           truth, COUNT(*) AS n FROM predictions GROUP BY 1, 2
    """,
    (PREDICTIONS_SQL,),
)
def _bands(spark, sf):
    return (
        predictions(spark, sf)
        .groupBy(St.prob_band(F.col("p2"), BAND_CUTS, BAND_NAMES).alias("band"), "truth")
        .agg(F.count(F.lit(1)).alias("n"))
    )


_RECOMMENDATIONS = """
    SELECT site, week, p, pred_stage, id, action FROM (
      SELECT o_orderpriority AS site, CAST(CAST(date_trunc('week', MAX(o_orderdate)) AS DATE) AS VARCHAR) AS week,
             COUNT(*) / CAST((SELECT COUNT(*) FROM orders) AS DOUBLE) AS p, 1 AS pred_stage, 'S3' AS id,
             UNNEST(['watch', 'sample']) AS action
      FROM orders GROUP BY o_orderpriority)
    """


def _recommendation_table(spark, sf):
    o = read(spark, sf, "orders")
    total = o.agg(F.count(F.lit(1)).alias("__all"))
    doc = F.struct(
        F.lit("S3").alias("id"),
        F.lit("t").alias("title"),
        F.lit("c").alias("조건"),
        F.lit("e").alias("예상"),
        F.array(F.lit("watch"), F.lit("sample")).alias("권고"),
    )
    return (
        o.groupBy(F.col("o_orderpriority").alias("채수위치"))
        .agg(F.date_trunc("week", F.max("o_orderdate")).cast("date").cast("string").alias("week_start_target"), F.count(F.lit(1)).alias("__n"))
        .join(F.broadcast(total), how="left")
        .select(
            "채수위치",
            "week_start_target",
            (F.col("__n") / F.col("__all")).alias("p_alert_ge1_scenario"),
            F.lit(1).alias("pred_stage"),
            F.array(doc).alias("scenarios"),
        )
    )


def _actions(docs):
    back = docs.select("*", F.explode("scenarios").alias("s"))
    return back.select(
        F.col("채수위치").alias("site"),
        F.col("week_start_target").alias("week"),
        F.col("p_alert_ge1_scenario").alias("p"),
        "pred_stage",
        F.col("s.id").alias("id"),
        F.explode("s.권고").alias("action"),
    )


@query("recommendations_json_round_trip", _RECOMMENDATIONS)
def _json(spark, sf):
    path = scratch_path(spark, "recommendations_json")
    write_table(_recommendation_table(spark, sf), path, "json")
    return _actions(read_recommendations(spark, path, lines=True))


@query("recommendations_array_per_file", _RECOMMENDATIONS)
def _json_arrays(spark, sf):
    """The form with one array of documents in each file; one file for each site here."""
    docs = _recommendation_table(spark, sf)
    path = scratch_path(spark, "recommendations_arrays")
    arrays = docs.groupBy("채수위치").agg(F.to_json(F.collect_list(F.struct(*docs.columns))).alias("value"))
    # A text file may hold several lines, a multi-line document only one array: a folder for each site.
    arrays.select("value", F.hash("채수위치").alias("part")).write.partitionBy("part").text(path)
    return _actions(read_recommendations(spark, path))


@query(
    "required_columns",
    "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders",
)
def _required(spark, sf):
    cols = ["o_orderkey", "o_custkey", "o_orderstatus"]
    return require_columns(normalize_headers(read(spark, sf, "orders")), cols).select(*cols)


@query(
    "optional_tables",
    "SELECT o_orderkey, o_totalprice, TRUE AS other_is_absent FROM orders",
)
def _optional(spark, sf):
    """A table that is there is read; one that is not gives None, and no error."""
    there = read_optional(spark, f"{sf}/orders.parquet", "parquet")
    absent = read_optional(spark, f"{sf}/predictions_of_no_run.parquet", "parquet")
    return there.select("o_orderkey", "o_totalprice", F.lit(absent is None).alias("other_is_absent"))
