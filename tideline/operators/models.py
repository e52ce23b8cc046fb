"""Alert models on MLlib: fits, ensembles, calibration, ablations."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import MinMaxScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.evaluation import alert_metrics
from tideline.operators.isotonic import apply_isotonic, fit_isotonic
from tideline.operators.quantiles import exact_quantiles
from tideline.operators.ranking import hash_order
from tideline.operators.series import Series
from tideline.operators.splits import class_weights, expanding_folds
from tideline.operators.thresholds import apply_thresholds, pair_cost_grid
from tideline.operators.windows import lead_label
from tideline.session import cut_lineage

VECTOR = "features"


def assembler(features: Sequence[str]) -> VectorAssembler:
    """Feature vector; rows with a missing feature must have been filled before."""
    return VectorAssembler(inputCols=list(features), outputCol=VECTOR, handleInvalid="error")


def _fit(df: DataFrame, features: Sequence[str], learner) -> PipelineModel:
    return Pipeline(stages=[assembler(features), learner]).fit(df)


def fit_gbt_regressor(
    df: DataFrame, features: Sequence[str], label: str, max_iter: int = 40, depth: int = 5, step: float = 0.1, seed: int = 42
) -> PipelineModel:
    """Boosted trees on a (log-scaled) target; predicts into ``prediction``."""
    return _fit(
        df,
        features,
        GBTRegressor(
            featuresCol=VECTOR, labelCol=label, maxIter=max_iter, maxDepth=depth, stepSize=step,
            subsamplingRate=0.9, seed=seed,
        ),
    )


def fit_alert_model(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    weight: str | None = None,
    validation: str | None = None,
    max_iter: int = 40,
    depth: int = 5,
    step: float = 0.1,
    seed: int = 42,
) -> PipelineModel:
    """Boosted binary classifier with row weights; ``validation`` turns on early stopping."""
    learner = GBTClassifier(
        featuresCol=VECTOR, labelCol=label, maxIter=max_iter, maxDepth=depth, stepSize=step, seed=seed
    )
    if weight:
        learner = learner.setWeightCol(weight)
    if validation:
        learner = learner.setValidationIndicatorCol(validation)
    return _fit(df, features, learner)


def fit_stage_model(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    weight: str | None = None,
    max_iter: int = 20,
    depth: int = 5,
    seed: int = 42,
) -> PipelineModel:
    """Boosted multiclass stage model: one boosted classifier per stage."""
    one = GBTClassifier(featuresCol=VECTOR, maxIter=max_iter, maxDepth=depth, seed=seed)
    learner = OneVsRest(classifier=one, featuresCol=VECTOR, labelCol=label, parallelism=4)
    if weight:
        learner = learner.setWeightCol(weight)
    return _fit(df, features, learner)


def fit_forest(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    kind: str = "classifier",
    weight: str | None = None,
    trees: int = 250,
    depth: int = 14,
    seed: int = 42,
) -> PipelineModel:
    cls = RandomForestClassifier if kind == "classifier" else RandomForestRegressor
    learner = cls(featuresCol=VECTOR, labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    if weight:
        learner = learner.setWeightCol(weight)
    return _fit(df, features, learner)


def score(model: PipelineModel, df: DataFrame, prob: str | None = None, classes: Sequence[int] = (1,), pred: str | None = None) -> DataFrame:
    """Scored rows; class probabilities become plain columns ``<prob>_<class>``.

    A one-vs-rest model has no probabilities; its only output is the prediction.
    """
    out = model.transform(df)
    new = {}
    if prob:
        p = vector_to_array("probability")
        new = {f"{prob}_{c}": F.get(p, F.lit(c)) for c in classes}
    if pred:
        new[pred] = F.col("prediction")
    return out.withColumns(new).drop(VECTOR, "rawPrediction", "probability", "prediction")


def stage_probabilities(model: PipelineModel, df: DataFrame, classes: Sequence[int], prefix: str = "prob") -> DataFrame:
    """Normalised per-stage probabilities of a one-vs-rest boosted model."""
    ready = model.stages[0].transform(df)
    for c, binary in zip(classes, model.stages[1].models):
        ready = binary.transform(ready)
        p = F.get(vector_to_array(binary.getProbabilityCol()), F.lit(1))
        ready = ready.withColumn(f"__p_{c}", p).drop(
            binary.getProbabilityCol(), binary.getRawPredictionCol(), binary.getPredictionCol()
        )
    total = sum([F.col(f"__p_{c}") for c in classes], F.lit(0.0))
    even = F.lit(1.0 / len(classes))
    new = {f"{prefix}_{c}": F.when(total > 0, F.col(f"__p_{c}") / total).otherwise(even) for c in classes}
    return ready.withColumns(new).drop(VECTOR, *[f"__p_{c}" for c in classes])


def average_probs(weighted: Sequence[tuple[float, Column]]) -> Column:
    """Weighted mean of probabilities."""
    total = sum(w for w, _ in weighted)
    return sum([F.lit(w) * p for w, p in weighted], F.lit(0.0)) / F.lit(total)


def argmax_class(probs: Sequence[Column]) -> Column:
    """Index of the largest probability, the first one on ties."""
    return (F.array_position(F.array(*probs), F.greatest(*probs)) - 1).cast("int")


def compose_probs(alert: Column, top: Column) -> tuple[Column, Column, Column]:
    """Three class probabilities from P(alert) and P(top | alert), summing to 1."""
    raw = (1 - alert, alert * (1 - top), alert * top)
    total = raw[0] + raw[1] + raw[2]
    return raw[0] / total, raw[1] / total, raw[2] / total


def calibrate_isotonic(
    train: DataFrame,
    fit: Callable[[DataFrame], PipelineModel],
    label: str,
    ids: Sequence[str],
    folds: int = 3,
    seed: int = 42,
) -> Callable[[DataFrame, str], DataFrame]:
    """Out-of-fold isotonic calibration.

    Each fold's model is fitted on the other folds and its scores are calibrated on
    the fold itself; a row's calibrated probability is the mean over the folds.
    The folds' models are fitted side by side, and the folds are the groups of one
    isotonic fit.  Returns ``apply(rows, name)``.
    """
    fold = F.pmod(F.conv(F.substring(hash_order(ids, seed), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")
    parts = train.withColumn("__fold", fold)
    fits = side_by_side([(str(k), partial(fit, parts.where(F.col("__fold") != k))) for k in range(folds)], at_once=folds)
    for k, (_, error) in fits.items():
        if error:
            raise RuntimeError(f"fold {k}: {error}")
    models, held = [fits[str(k)][0] for k in range(folds)], None
    for k in range(folds):
        own = score(models[k], parts.where(F.col("__fold") == k), prob="__p").select("__fold", "__p_1", F.col(label).cast("double").alias("__y"))
        held = own if held is None else held.unionByName(own)
    blocks = fit_isotonic(held, "__p_1", "__y", by=["__fold"])

    def apply(rows: DataFrame, name: str) -> DataFrame:
        out = rows
        for k, model in enumerate(models):
            scored = score(model, out, prob="__p").withColumn("__fold", F.lit(k))
            out = apply_isotonic(scored, blocks, "__p_1", f"__iso_{k}", by=["__fold"]).drop("__p_1", "__fold")
        found = F.array_compact(F.array(*[F.col(f"__iso_{k}") for k in range(folds)]))
        mean = F.aggregate(found, F.lit(0.0), lambda a, b: a + b) / F.nullif(F.size(found), F.lit(0))
        return out.withColumn(name, mean).drop(*[f"__iso_{k}" for k in range(folds)])

    return apply


def side_by_side(tasks: Sequence[tuple[str, Callable[[], object]]], at_once: int = 4) -> dict[str, tuple[object, str | None]]:
    """Run independent fits as concurrent jobs; name -> (result, None) or (None, what went wrong).

    Spark runs the jobs of several threads at once: while one fit waits for its last tasks, others use the
    free cores. Each thread has a scheduler pool of its own, so under fair scheduling no fit starves. A fit that
    fails is reported and takes no other with it.
    """
    spark = SparkSession.active()
    context = spark.sparkContext

    def run(name: str, task: Callable[[], object]) -> tuple[object, str | None]:
        context.setLocalProperty("spark.scheduler.pool", f"fit-{name}")
        try:
            return task(), None
        except Exception as e:  # reported to the caller by name
            return None, f"{type(e).__name__}: {str(e)[:500]}"
        finally:
            context.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max_workers=max(1, min(at_once, len(tasks) or 1))) as pool:
        waiting = {name: pool.submit(inheritable_thread_target(spark)(run), name, task) for name, task in tasks}
        return {name: done.result() for name, done in waiting.items()}


def grid_search_time(
    df: DataFrame,
    s: Series,
    label: str,
    fit: Callable[..., PipelineModel],
    grid: dict[str, Sequence],
    predict: Callable[[PipelineModel, DataFrame], DataFrame],
    folds: int = 3,
    at_once: int = 4,
) -> tuple[dict, list[tuple[dict, float | None]]]:
    """Best parameters by mean macro-F1 over expanding time folds.

    ``predict`` returns rows with ``label`` and an integer ``pred``.  The folds are stored
    once and all (parameters, fold) pairs are fitted side by side; only one metric row each
    reaches the driver.  Parameters with a failing fit score None; if all fail, the first error is raised.
    """
    parts = cut_lineage(expanding_folds(df, s, folds))
    tried = [dict(zip(grid, values)) for values in product(*grid.values())]

    def one(params: dict, k: int) -> float:
        model = fit(parts.where(F.col("fold") < k), **params)
        row = alert_metrics(predict(model, parts.where(F.col("fold") == k)), label, "pred").select("macro_f1").first()
        return row[0] if row else 0.0

    tasks = [(f"{i}-{k}", partial(one, p, k)) for i, p in enumerate(tried) for k in range(1, folds + 1)]
    done = side_by_side(tasks, at_once)
    results = []
    for i, params in enumerate(tried):
        scores = [done[f"{i}-{k}"][0] for k in range(1, folds + 1)]
        results.append((params, None if None in scores else sum(scores) / folds))
    if all(score is None for _, score in results):
        raise RuntimeError(next(error for _, error in done.values() if error))
    best = max((r for r in results if r[1] is not None), key=lambda r: r[1])[0]
    return best, results


def _union(done: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    failed = {name: error for name, (_, error) in done.items() if error}
    if len(failed) == len(done):
        raise RuntimeError(str(failed))
    out = None
    for name, (part, error) in done.items():
        if error:
            warnings.warn(f"{name}: {error}", stacklevel=3)
        else:
            out = part if out is None else out.unionByName(part)
    return out


def ablate_lookback(
    build: Callable[[int], DataFrame],
    evaluate: Callable[[DataFrame, int], DataFrame],
    lengths: Sequence[int] = (3, 4, 5),
    at_once: int = 3,
) -> DataFrame:
    """Metrics of the same model on tables with different look-back lengths, fitted side by side.

    A length that fails is left out with a warning; if all fail, that is an error.
    """
    one = lambda n: cut_lineage(evaluate(build(n), n).withColumn("lookback", F.lit(n)))
    return _union(side_by_side([(f"lookback {n}", partial(one, n)) for n in lengths], at_once))


def compare_leads(
    df: DataFrame,
    s: Series,
    stage: str,
    features: Sequence[str],
    split: Callable[[DataFrame], DataFrame],
    leads: Sequence[int] = (1, 3, 7, 14),
    t_top: float = 0.12,
    t_caution: float = 0.30,
    boost: dict[int, float] | None = None,
    trees: int = 250,
    depth: int = 14,
    at_once: int = 4,
) -> DataFrame:
    """Test metrics per lead time, on rows complete in every feature; the leads are fitted side by side.

    ``split`` adds a ``split`` column with ``train`` and ``test``.  A lead that fails is left out with a warning.
    """

    def one(n: int) -> DataFrame:
        labelled = lead_label(df, s, stage, n, "__y").where(F.col("__y").isNotNull())
        ready = split(labelled).na.drop(subset=list(features))
        ready = ready.withColumn("__y", F.least(F.col("__y"), F.lit(2)).cast("double"))
        train = class_weights(ready.where(F.col("split") == "train"), "__y", boost or {2: 3.0}, "__w")
        model = fit_forest(train, features, "__y", weight="__w", trees=trees, depth=depth)
        scored = score(model, ready.where(F.col("split") == "test"), prob="p", classes=(1, 2))
        scored = scored.withColumn(
            "pred",
            apply_thresholds(F.coalesce("p_1", F.lit(0.0)), F.coalesce("p_2", F.lit(0.0)), t_top, t_caution),
        ).withColumn("truth", F.col("__y").cast("int"))
        return cut_lineage(alert_metrics(scored, "truth", "pred").withColumn("lead", F.lit(n)))

    return _union(side_by_side([(f"lead {n}", partial(one, n)) for n in leads], at_once))


def fit_per_key(
    df: DataFrame, key: str, values: Sequence | None, fit: Callable[[DataFrame], PipelineModel], predict: Callable[[PipelineModel, DataFrame], DataFrame], most: int = 200
) -> DataFrame:
    """One model per key value, pooled predictions on the test rows.

    ``values`` None takes every key of the table, the null key included, up to ``most``;
    more is an error.  Each fit is a Spark job of its own on that key's rows.
    """
    if values is None:
        values = sorted((r[0] for r in df.select(key).distinct().limit(most + 1).collect()), key=str)
        if len(values) > most:
            raise ValueError(f"more than {most} keys; fit one model over all, with the key as a feature")
    pooled = None
    for v in values:
        own = df.where(F.col(key).eqNullSafe(F.lit(v)))
        part = predict(fit(own.where(F.col("split") == "train")), own.where(F.col("split") == "test"))
        pooled = part if pooled is None else pooled.unionByName(part)
    return pooled


def fit_two_stage(
    train: DataFrame, features: Sequence[str], stage: str, fit: Callable[[DataFrame, Sequence[str], str], PipelineModel]
) -> tuple[PipelineModel, PipelineModel]:
    """Alert or not on all rows; top stage or not on the alert rows only."""
    alert = train.withColumn("__alert", (F.col(stage) >= 1).cast("double"))
    top = train.where(F.col(stage) >= 1).withColumn("__top", (F.col(stage) == 2).cast("double"))
    return fit(alert, features, "__alert"), fit(top, features, "__top")


def score_two_stage(models: tuple[PipelineModel, PipelineModel], df: DataFrame) -> DataFrame:
    """Columns ``p_alert`` and ``p_top``."""
    out = score(models[0], df, prob="__a").withColumnRenamed("__a_1", "p_alert")
    return score(models[1], out, prob="__t").withColumnRenamed("__t_1", "p_top")


def decide_two_stage(p_alert: Column, p_top: Column, t_alert: float, t_top: float) -> Column:
    return F.when((p_alert >= t_alert) & (p_top >= t_top), 2).when(p_alert >= t_alert, 1).otherwise(0)


def blend_two(
    val: DataFrame,
    y: str,
    first: tuple[str, str],
    second: tuple[str, str],
    weights: Sequence[float],
    alert_grid: Sequence[float],
    top_grid: Sequence[float],
    min_top_recall: float = 0.70,
) -> DataFrame:
    """Blend weight and threshold pair of least cost with enough top recall.

    Everything is chosen on validation rows.  Each row is repeated once per weight and
    binned by the thresholds it reaches; all pairs of all weights are then evaluated on
    the cells.  One row per weight comes back, the cheapest feasible pair each.
    """
    w = F.col("weight")
    rows = val.withColumn("weight", F.explode(F.array(*[F.lit(float(x)) for x in weights])))
    blended = rows.select(
        "weight",
        F.col(y).alias("__y"),
        (w * F.col(first[0]) + (1 - w) * F.col(second[0])).alias("__a"),
        (w * F.col(first[1]) + (1 - w) * F.col(second[1])).alias("__t"),
    )
    grid = pair_cost_grid(blended, "__y", "__a", "__t", alert_grid, top_grid, by=["weight"])
    short = F.when(F.col("top_recall") >= min_top_recall, 0).otherwise(1)
    best = F.min_by(F.struct("t_alert", "t_top", "cost", "top_recall"), F.struct(short, "cost", "i_alert", "i_top"))
    return grid.groupBy("weight").agg(best.alias("b")).select("weight", "b.*")


def scale_sequences(df: DataFrame, train: DataFrame, values: Sequence[str], kind: str = "minmax") -> DataFrame:
    """Feature columns scaled by statistics of the training rows only."""
    cls = MinMaxScaler if kind == "minmax" else StandardScaler
    scaler = cls(inputCol=VECTOR, outputCol="__scaled")
    if kind != "minmax":
        scaler = scaler.setWithMean(True)
    vec = array_to_vector(F.array(*[F.coalesce(F.col(v).cast("double"), F.lit(0.0)) for v in values]))
    fitted = scaler.fit(train.select(vec.alias(VECTOR)))
    out = fitted.transform(df.withColumn(VECTOR, vec)).withColumn("__arr", vector_to_array("__scaled"))
    return out.withColumns({f"scaled_{v}": F.col("__arr")[i] for i, v in enumerate(values)}).drop(VECTOR, "__scaled", "__arr")


def fit_quantiles(
    train: DataFrame, features: Sequence[str], label: str, qs: Sequence[float] = (0.1, 0.5, 0.9), depth: int = 5, min_rows: int = 20
) -> Callable[[DataFrame], DataFrame]:
    """Quantile bands from the training values in each leaf of one regression tree."""
    tree = DecisionTreeRegressor(
        featuresCol=VECTOR, labelCol=label, maxDepth=depth, minInstancesPerNode=min_rows, leafCol="__leaf", seed=42
    )
    model = _fit(train, features, tree)
    leaves = model.transform(train).select("__leaf", label)
    names = [f"q{round(q * 100)}" for q in qs]
    table = exact_quantiles(leaves, label, qs, by=["__leaf"], names=names)

    def apply(rows: DataFrame) -> DataFrame:
        # At most 2^depth leaves.
        return model.transform(rows).join(F.broadcast(table), "__leaf", "left").drop("__leaf", VECTOR, "prediction")

    return apply


def save_model(model: PipelineModel, path: str, meta: dict[str, str]) -> None:
    """Model and a one-row table of what scoring needs (features, thresholds, classes)."""
    from pyspark.sql import SparkSession

    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in meta.items()])
    row.write.mode("overwrite").parquet(f"{path}/meta")


def load_model(spark, path: str) -> tuple[PipelineModel, dict]:
    meta = spark.read.parquet(f"{path}/meta").first().asDict()
    return PipelineModel.load(f"{path}/model"), meta
