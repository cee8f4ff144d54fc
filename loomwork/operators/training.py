"""Training with exact quotas: stratified splits and folds by hash ranks, cross-validation from one prepared table, and models stored by name."""

from __future__ import annotations

import json
import re

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import broadcast_if_small, scratch, stored
from .models import detect_task, estimator, is_id_like, prep_stages, spread, with_layers
from .steps import StepError


def usable_features(df: DataFrame, target: str) -> list[str]:
    """All other columns but those that look like ids; all of them if nothing else is left."""
    others = [c for c in df.columns if c != target]
    return [c for c in others if not is_id_like(df, c)] or others


def ranked(df: DataFrame, label: str | None, key: list[str], seed: int = 42) -> DataFrame:
    """Rows with ``_place``, from 0 in hashed order within their class, and ``_size``, the rows of the class.

    A class is cut into slices by the hash, of about one size and in its order; rows are dealt by slice once, and the slices before are a count."""
    kind = (F.col(label) if label else F.lit(0)).alias("_class")
    rows = df.select("*", kind, F.xxhash64(F.lit(seed), *key).alias("_hash")).withColumn("_slice", F.shiftright("_hash", 52))
    whole = Window.partitionBy("_class")
    before = F.sum("_n").over(whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy("_class", "_slice").agg(F.count("*").alias("_n"))
    counts = counts.select(F.col("_class").alias("_of"), F.col("_slice").alias("_part"), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_size"))
    order = Window.partitionBy("_class", "_slice").orderBy("_hash", *[F.col(c).asc_nulls_last() for c in key])
    same = F.col("_class").eqNullSafe(F.col("_of")) & (F.col("_slice") == F.col("_part"))
    out = rows.withColumn("_rank", F.row_number().over(order)).join(broadcast_if_small(stored(counts, "strata")), same)
    return out.withColumn("_place", F.col("_rank") - 1 + F.col("_before")).drop("_class", "_slice", "_of", "_part", "_hash", "_rank", "_before")


def _held(test_size: float) -> Column:
    quota = F.least(F.col("_size") - 1, F.greatest(F.lit(1), F.round(test_size * F.col("_size")).cast("long")))
    return F.col("_place") < quota


def split(df: DataFrame, label: str | None, key: list[str], test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Rows with ``held_out``: of each class exactly the rounded share, one at least and all but one at most."""
    return ranked(df, label, key, seed).withColumn("held_out", _held(test_size)).drop("_place", "_size")


def _ready(df: DataFrame, target: str, features: list[str], key: list[str], task: str) -> tuple[DataFrame, list]:
    """(rows with a target, of the columns that a model needs; stages of preparation)."""
    rows = df.where(F.col(target).isNotNull()).select(*dict.fromkeys([*features, target, *key]))
    stages = prep_stages(df, features)
    if task == "classification":
        return rows, [*stages, StringIndexer(inputCol=target, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="keep")]
    return rows.withColumn("_y", F.col(target).cast("double")), stages


def score(pred: DataFrame, task: str, weight: Column | float = 1.0) -> DataFrame:
    """(metric, value, n): r2 of a regression, accuracy of a classification; a row counts as often as its weight says."""
    y, p, weight = F.col("_y"), F.col("prediction"), weight if isinstance(weight, Column) else F.lit(weight)
    n = F.sum(weight)
    r2 = 1 - F.try_divide(F.sum(weight * (y - p) ** 2), F.sum(weight * y * y) - F.sum(weight * y) ** 2 / n)
    value = r2 if task == "regression" else F.try_divide(F.sum(weight * (y == p).cast("double")), n)
    return pred.agg(F.lit("r2" if task == "regression" else "accuracy").alias("metric"), F.round(value, 6).alias("value"), F.coalesce(n, F.lit(0)).cast("long").alias("n"))


def cross_validate(df: DataFrame, target: str, features: list[str] | None, key: list[str], algorithm: str = "linear", folds: int = 5, seed: int = 42) -> DataFrame:
    """(fold, metric, value, n): folds of equal size, of each class alike; the rows are prepared and written once for all of them."""
    features = features or usable_features(df.drop(*key), target)
    task = detect_task(df, target)
    rows, stages = _ready(df, target, features, key, task)
    dealt = ranked(rows, target if task == "classification" else None, key, seed)
    return _folds(dealt, Pipeline(stages=stages).fit(rows), task, [*features, target], key, algorithm, folds)


def _folds(dealt: DataFrame, prepared: PipelineModel, task: str, columns: list[str], key: list[str], algorithm: str, folds: int) -> DataFrame:
    """Equal rows of a fold are one row with their number as its weight where a model has the same solution for both."""
    dealt = dealt.withColumn("_fold", (F.col("_place") % folds).cast("int"))
    if algorithm == "logistic":
        dealt = dealt.groupBy("_fold", *dict.fromkeys(columns)).agg(F.count("*").cast("double").alias("_w")).withColumn("_k", F.xxhash64("_fold", *columns))
    else:
        dealt = dealt.select("_fold", *dict.fromkeys(columns + (["_y"] if "_y" in dealt.columns else [])), F.lit(1.0).alias("_w"), F.xxhash64(*key).alias("_k"))
    rows = stored(prepared.transform(dealt).select("features", "_y", "_fold", "_w", "_k"), "folds")
    out = []
    for f in range(folds):
        learn, made = rows.where(F.col("_fold") != f), estimator(algorithm, task)
        if algorithm == "logistic":
            made.setWeightCol("_w")
        model = with_layers(made, learn).fit(spread(learn, made))
        r = score(model.transform(rows.where(F.col("_fold") == f)), task, F.col("_w")).first()
        out.append((f, r.metric, r.value, r.n))
    return dealt.sparkSession.createDataFrame(out, "fold int, metric string, value double, n long")


#: Scores of a fit check: a gap beyond which training is much better than the held-out rows, a good and a weak score.
GAP, GOOD, WEAK = 0.15, 0.7, 0.5


def fit_check(df: DataFrame, target: str, features: list[str] | None, key: list[str], algorithm: str = "linear", folds: int = 3, seed: int = 42) -> DataFrame:
    """(metric, train, held_out, cross_validated, gap, verdict) of a model: overfitting, underfitting or balanced.  Rows are prepared and written once; one
    fifth is held out of the fit, of each class alike."""
    features = features or usable_features(df.drop(*key), target)
    task = detect_task(df, target)
    rows, stages = _ready(df, target, features, key, task)
    # one order serves both: the held-out rows are the first of it, the folds take turns in it
    dealt = stored(ranked(rows, target if task == "classification" else None, key, seed), "fit-check-order")
    cut = dealt.withColumn("held_out", _held(0.2))
    ready = stored(Pipeline(stages=stages).fit(cut.where("not held_out")).transform(cut).select("features", "_y", "held_out", F.xxhash64(*key).alias("_k")), "fit-check")
    learn, made = ready.where("not held_out"), estimator(algorithm, task)
    model = with_layers(made, learn).fit(spread(learn, made))
    own, other = (score(model.transform(part), task).first() for part in (learn, ready.where("held_out")))
    cv = _folds(dealt, Pipeline(stages=stages).fit(dealt), task, [*features, target], key, algorithm, folds).agg(F.avg("value").alias("v")).first().v
    if own.value is None or other.value is None:
        verdict = None
    elif own.value - other.value > GAP and own.value > GOOD:
        verdict = "overfitting"
    else:
        verdict = "underfitting" if own.value < WEAK and other.value < WEAK else "balanced"
    gap = own.value - other.value if verdict else None
    return df.sparkSession.createDataFrame([(own.metric, own.value, other.value, cv, gap, verdict)], "metric string, train double, held_out double, cross_validated double, gap double, verdict string")


def _shelf(spark: SparkSession, name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
        raise StepError(f"a model's name has letters, digits, _ and - only, not {name!r}")
    return scratch(spark, "x").rsplit("/", 1)[0] + f"/models/{name}"


def save_model(spark: SparkSession, model: PipelineModel, name: str, about: dict) -> None:
    """Store a model and what is known about it under ``name`` in the shared folder; one of that name is replaced."""
    model.write().overwrite().save(_shelf(spark, name) + "/stages")
    spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "about string").coalesce(1).write.mode("overwrite").parquet(_shelf(spark, name) + "/about")


def load_model(spark: SparkSession, name: str) -> tuple[PipelineModel, dict]:
    about = json.loads(spark.read.schema("about string").parquet(_shelf(spark, name) + "/about").first().about)
    return PipelineModel.load(_shelf(spark, name) + "/stages"), about


def train_saved(df: DataFrame, target: str, features: list[str] | None, key: list[str], name: str, algorithm: str = "linear", test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """(metric, value, n) of the held-out rows of a stratified split; the model is stored by name with its target, features, task and score."""
    features = features or usable_features(df.drop(*key), target)
    task = detect_task(df, target)
    rows, stages = _ready(df, target, features, key, task)
    rows = stored(split(rows, target if task == "classification" else None, key, test_size, seed), "split")
    learn = rows.where("not held_out")
    prepared = Pipeline(stages=stages).fit(learn)
    ready, made = stored(prepared.transform(learn).select("features", "_y", F.xxhash64(*key).alias("_k")), "model-rows"), estimator(algorithm, task)
    fitted = with_layers(made, ready).fit(spread(ready, made))
    told = stored(score(fitted.transform(prepared.transform(rows.where("held_out"))), task), "score")
    r = told.first()
    model = PipelineModel(stages=[s for s in prepared.stages if not (task == "classification" and s is prepared.stages[-1])] + [fitted])
    about = {"target": target, "features": features, "task": task, "algorithm": algorithm, "metric": r.metric, "value": r.value, "held_out": r.n}
    if task == "classification":
        about["classes"] = list(prepared.stages[-1].labels)
    save_model(df.sparkSession, model, name, about)
    return told


def predict_saved(df: DataFrame, name: str) -> DataFrame:
    """Rows with ``prediction`` of a stored model: a number, or the name of a class.  Missing features are told by name."""
    model, about = load_model(df.sparkSession, name)
    lost = [f for f in about["features"] if f not in df.columns]
    if lost:
        raise StepError(f"model {name} needs {', '.join(lost)}")
    out = model.transform(df).select(*df.columns, "prediction")
    if about["task"] == "classification":
        classes = F.array(*[F.lit(c) for c in about["classes"]])
        out = out.withColumn("prediction", F.get(classes, F.col("prediction").cast("int")))
    return out
