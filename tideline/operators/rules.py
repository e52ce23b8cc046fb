"""Rule tables as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.text import tag_text


def classify_first(rules: Sequence[tuple[str, Column]], default: str) -> Column:
    """Label of the first rule that holds; unknown counts as not holding."""
    out = F.lit(default)
    for label, holds in reversed(list(rules)):
        out = F.when(holds, label).otherwise(out)
    return out


def or_default(c: Column, default: float) -> Column:
    """Missing or zero replaced by a default."""
    return F.when(c.isNull() | (c == 0), F.lit(default)).otherwise(c)


def recommendation(
    rule_id: str, title: str, condition: str | Column, expectation: str, actions: Sequence[str]
) -> Column:
    text = condition if isinstance(condition, Column) else F.lit(condition)
    return F.struct(
        F.lit(rule_id).alias("id"),
        F.lit(title).alias("title"),
        text.alias("condition"),
        F.lit(expectation).alias("expectation"),
        F.array(*[F.lit(a) for a in actions]).alias("actions"),
    )


def match_rules(rules: Sequence[tuple[Column, Column]], default: Column) -> Column:
    """All matching recommendations in rule order, or the default one."""
    found = F.array_compact(F.array(*[F.when(holds, rec) for holds, rec in rules]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(default))


def match_rules_flat(
    df: DataFrame,
    rules: Sequence[tuple[str, Column, Sequence[str]]],
    none: tuple[str, str],
    names: tuple[str, str] = ("rules", "actions"),
    per_rule: int = 2,
) -> DataFrame:
    """Ids of all matching rules joined by '|' and their first actions by ' / '."""
    ids = F.array_compact(F.array(*[F.when(holds, F.lit(i)) for i, holds, _ in rules]))
    texts = F.flatten(
        F.array_compact(
            F.array(*[F.when(holds, F.array(*[F.lit(a) for a in acts[:per_rule]])) for _, holds, acts in rules])
        )
    )
    some = F.size(ids) > 0
    return df.withColumns(
        {
            names[0]: F.when(some, F.array_join(ids, "|")).otherwise(F.lit(none[0])),
            names[1]: F.when(some, F.array_join(texts, " / ")).otherwise(F.lit(none[1])),
        }
    )


def explode_recommendations(
    df: DataFrame, column: str, words: dict[str, list[str]], none: str, keep: Sequence[str]
) -> DataFrame:
    """One row per recommendation with its joined actions and activity tags."""
    rows = df.select(*keep, F.explode(column).alias("r")).withColumn("__actions", F.array_join("r.actions", " | "))
    rows = rows.withColumn("__text", F.concat_ws(" ", "r.title", "r.condition", "r.expectation", "__actions"))
    return rows.select(
        *keep,
        F.col("r.id").alias("scenario_id"),
        F.col("r.title").alias("scenario_title"),
        F.col("r.condition").alias("condition"),
        F.col("r.expectation").alias("expectation"),
        F.col("__actions").alias("actions_text"),
        tag_text(F.col("__text"), words, none).alias("tags"),
    )


def attach_actions(df: DataFrame, table: dict[str, tuple[str, dict[str, list[str]]]], key: str) -> DataFrame:
    """One row per scenario, horizon and action of a literal rule table.

    The table is part of the program, so it is broadcast.
    """
    rows = [
        (scenario, level, horizon, i, action)
        for scenario, (level, horizons) in table.items()
        for horizon, actions in horizons.items()
        for i, action in enumerate(actions, start=1)
    ]
    rules = df.sparkSession.createDataFrame(
        rows, f"`{key}` string, risk_level string, horizon string, step int, action string"
    )
    return df.join(F.broadcast(rules), key, "left")


def classify_misses(
    df: DataFrame, truth: str, pred: str, top: int, rain: Column, month: Column, types: Sequence[str]
) -> DataFrame:
    """Missed top-stage rows by type: heavy rain, late season, other."""
    missed = df.where((F.col(truth) == top) & (F.col(pred) != top))
    kind = F.when(rain > 100, types[0]).when(month >= 9, types[1]).otherwise(F.lit(types[2]))
    return missed.groupBy(kind.alias("miss_type")).agg(F.count(F.lit(1)).alias("n"))
