"""Models: pyspark.ml pipelines, evaluation tables, clusters, anomalies, forecasts and Pareto fronts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import broadcast_if_small, stored
from .nearest import nearest
from .profile import column_roles
from .ranks import quantiles


def is_id_like(df: DataFrame, column: str) -> bool:
    """Not a number, more than 30 distinct values and more than 5 % of the rows."""
    if column_roles(df.schema)[column] == "numeric":
        return False
    r = df.agg(F.countDistinct(column).alias("d"), F.count("*").alias("n")).first()
    return r.d > 30 and r.d > 0.05 * r.n


def detect_task(df: DataFrame, target: str) -> str:
    """Text, or at most 20 distinct whole numbers: classification."""
    if column_roles(df.schema)[target] != "numeric":
        return "classification"
    v = F.col(target)
    r = df.agg(F.countDistinct(v).alias("d"), F.count_if(v != F.floor(v)).alias("broken")).first()
    return "classification" if r.d <= 20 and r.broken == 0 else "regression"


def prep_stages(df: DataFrame, features: list[str]) -> list:
    """Numbers imputed by the mean, text one-hot with null as its own level."""
    roles = column_roles(df.schema)
    numbers = [f for f in features if roles[f] == "numeric"]
    texts = [f for f in features if roles[f] != "numeric"]
    stages: list = []
    if numbers:
        stages.append(Imputer(inputCols=numbers, outputCols=[f"{c}__i" for c in numbers]))
    for c in texts:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}__n", handleInvalid="keep", stringOrderType="alphabetAsc"))
    if texts:
        stages.append(OneHotEncoder(inputCols=[f"{c}__n" for c in texts], outputCols=[f"{c}__h" for c in texts], dropLast=False, handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=[f"{c}__i" for c in numbers] + [f"{c}__h" for c in texts], outputCol="features", handleInvalid="keep"))
    return stages


def estimator(algorithm: str, task: str):
    kind = (algorithm, task)
    made = {
        ("linear", "regression"): lambda: LinearRegression(labelCol="_y"), ("ridge", "regression"): lambda: LinearRegression(labelCol="_y", regParam=1.0, elasticNetParam=0.0),
        ("random_forest", "regression"): lambda: RandomForestRegressor(labelCol="_y", seed=42), ("gradient_boosting", "regression"): lambda: GBTRegressor(labelCol="_y", seed=42),
        ("logistic", "classification"): lambda: LogisticRegression(labelCol="_y"), ("random_forest", "classification"): lambda: RandomForestClassifier(labelCol="_y", seed=42),
        ("gradient_boosting", "classification"): lambda: GBTClassifier(labelCol="_y", seed=42), ("mlp", "classification"): lambda: MultilayerPerceptronClassifier(labelCol="_y", seed=42),
    }
    return made[kind]()


def fold_column(key: list[str], seed: int = 42) -> Column:
    """0 to 99 by a hash of the row key: the same split at every run and at every size."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(100))


def train(df: DataFrame, target: str, features: list[str], key: list[str], algorithm: str = "linear", test_size: float = 0.2, seed: int = 42) -> tuple[PipelineModel, DataFrame]:
    """(model, predictions of the held-out rows): 80/20 by a hash of the key; a null target drops the row."""
    task = detect_task(df, target)
    rows = df.where(F.col(target).isNotNull())
    if task == "classification":
        label = [StringIndexer(inputCol=target, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="keep")]
    else:
        label, rows = [], rows.withColumn("_y", F.col(target).cast("double"))
    part = fold_column(key, seed)
    # a network needs features of one scale
    scale = [StandardScaler(inputCol="features", outputCol="_scaled", withMean=True)] if algorithm == "mlp" else []
    prepared = Pipeline(stages=[*prep_stages(df, features), *label, *scale]).fit(rows.where(part >= 100 * test_size))
    made = estimator(algorithm, task)
    made.setFeaturesCol("_scaled" if scale else "features")
    learn = stored(prepared.transform(rows.where(part >= 100 * test_size)).select(made.getFeaturesCol(), "_y", F.xxhash64(*key).alias("_k")), "model-rows")
    fitted = with_layers(made, learn).fit(spread(learn, made))
    model = PipelineModel(stages=[*prepared.stages, fitted])
    return model, model.transform(rows.where(part < 100 * test_size))


def with_layers(made, learn: DataFrame):
    """A network gets as many inputs as there are features, two hidden layers and as many outputs as classes."""
    if isinstance(made, MultilayerPerceptronClassifier):
        classes = int(learn.agg(F.max("_y")).first()[0]) + 1
        made.setLayers([len(learn.first()[made.getFeaturesCol()]), 32, 16, max(2, classes)])
    return made


#: Bytes of prepared rows that one task of an iterative model keeps, about.
TASK_BYTES = 128_000_000


def spread(learn: DataFrame, made, key: str = "_k") -> DataFrame:
    """``learn`` dealt by its key hash, so that no task keeps more than about TASK_BYTES of it: written rows pack so well that Spark reads a great many of
    them in one task.  A linear model reads its rows once and keeps none."""
    first = None if isinstance(made, LinearRegression) else learn.first()
    parts = -(-learn.count() * (8 * first[made.getFeaturesCol()].size + 64) // TASK_BYTES) if first else 1
    return learn.repartition(parts, key) if parts > 1 else learn


def regression_metrics(pred: DataFrame, y: str = "_y", p: str = "prediction") -> DataFrame:
    e = F.col(y) - F.col(p)
    return pred.agg(
        F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.avg(F.abs(e)), 6).alias("mae"),
        F.round(1 - F.sum(e * e) / (F.sum(F.col(y) ** 2) - F.sum(y) ** 2 / F.count("*")), 6).alias("r2"), F.round(F.avg(e), 6).alias("bias"), F.count("*").alias("n"),
    )


def error_by_group(pred: DataFrame, group: str, y: str = "_y", p: str = "prediction") -> DataFrame:
    e = F.col(y) - F.col(p)
    return pred.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.avg(e), 6).alias("bias"))


def residual_histogram(pred: DataFrame, bins: int = 10, y: str = "_y", p: str = "prediction") -> DataFrame:
    """(bin, low, high, n): residuals in bins of equal width between their ends; two scans."""
    e = (F.col(y) - F.col(p)).cast("double")
    ends = pred.agg(F.min(e).alias("a"), F.max(e).alias("b")).first()
    if ends.a is None:
        return pred.select(F.lit(0).alias("bin"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.lit(0).cast("long").alias("n")).where("false")
    width = (ends.b - ends.a) / bins or 1.0
    place = F.least(F.lit(bins - 1), F.floor((e - ends.a) / width)).cast("int").alias("bin")
    counts = pred.where(e.isNotNull()).groupBy(place).agg(F.count("*").alias("n"))
    return counts.select("bin", F.round(ends.a + F.col("bin") * width, 6).alias("low"), F.round(ends.a + (F.col("bin") + 1) * width, 6).alias("high"), "n")


def bias_over_time(pred: DataFrame, time: str, grain: str = "month", periods: int = 3, y: str = "_y", p: str = "prediction") -> DataFrame:
    """(period, n, bias, rolling): mean residual per period and over the last ``periods`` ones (weighted by rows); windows run over the periods alone."""
    per = pred.groupBy(F.date_trunc(grain, time).cast("date").alias("period")).agg(F.count("*").alias("n"), F.sum(F.col(y) - F.col(p)).alias("_s"))
    w = Window.orderBy("period").rowsBetween(1 - periods, Window.currentRow)
    return per.select("period", "n", F.round(F.col("_s") / F.col("n"), 6).alias("bias"), F.round(F.sum("_s").over(w) / F.sum("n").over(w), 6).alias("rolling"))


def confusion(pred: DataFrame, y: str, p: str) -> DataFrame:
    return pred.groupBy(F.col(y).alias("actual"), F.col(p).alias("predicted")).agg(F.count("*").alias("n"))


def precision_recall(pred: DataFrame, y: str, p: str) -> DataFrame:
    """(label, precision, recall, f1) of every label."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    c = confusion(pred, y, p)
    a = c.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("na"), F.sum(hit).alias("hits"))
    b = c.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("np"))
    j = a.join(b, "label", "left")
    pr, rc = F.coalesce(F.col("hits") / F.col("np"), F.lit(0.0)), F.col("hits") / F.col("na")
    return j.select("label", F.round(pr, 6).alias("precision"), F.round(rc, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * pr * rc, pr + rc), F.lit(0.0)), 6).alias("f1"))


def calibration(pred: DataFrame, score: str, y: str, bins: int = 10) -> DataFrame:
    return pred.groupBy(F.least(F.lit(bins - 1), F.floor(F.col(score) * bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("score"), F.round(F.avg(y), 6).alias("share"))


def roc(pred: DataFrame, score: str, y: str) -> DataFrame:
    """(auc) by mid ranks: sorted along range partitions, no one-task window."""
    from .ranks import mid_ranks

    r = mid_ranks(pred.select(F.col(score).alias("s"), F.col(y).alias("y")), "s", "r")
    a = r.agg(F.sum(F.when(F.col("y") == 1, F.col("r"))).alias("r1"), F.count_if(F.col("y") == 1).alias("n1"), F.count("*").alias("n"))
    n1, n0 = F.col("n1"), F.col("n") - F.col("n1")
    return a.select(F.round((F.col("r1") - n1 * (n1 + 1) / 2) / (n1 * n0), 6).alias("auc"))


def fit_gap(df: DataFrame, target: str, features: list[str], key: list[str], algorithm: str = "linear") -> DataFrame:
    """(share, rmse): learning curve on nested hashed samples, held-out rows fixed."""
    out = []
    for share in (0.2, 0.4, 0.6, 0.8, 1.0):
        nested = df.where((fold_column(key, 42) < 20) | (fold_column(key, 7) < 100 * share))
        out.append(regression_metrics(train(nested, target, features, key, algorithm)[1]).select(F.lit(share).alias("share"), "rmse", "n"))
    return reduce(DataFrame.unionByName, out)


def permutation_importance(model: PipelineModel, pred_src: DataFrame, target: str, features: list[str], key: list[str]) -> DataFrame:
    """(feature, rise): how much the squared error rises when a column is dealt anew among the rows.

    The column is joined back by its place in a second hashed order, so the shuffle is distributed."""
    from .ranks import global_rank

    pred_src = pred_src.select(*dict.fromkeys([*features, target, *key]))
    src = global_rank(pred_src.withColumn("_a", F.xxhash64(F.lit(1), *key)), ["_a", *key], "_i").select(*dict.fromkeys([*features, target]), "_i")
    base = model.transform(pred_src).agg(F.avg((F.col(target) - F.col("prediction")) ** 2).alias("b"))
    out = []
    for f in features:
        other = global_rank(pred_src.select(F.col(f).alias("_f"), F.xxhash64(F.lit(2), *key).alias("_b"), *key), ["_b", *key], "_i").select("_i", "_f")
        dealt = src.drop(f).join(other, "_i").withColumnRenamed("_f", f)
        err = model.transform(dealt).agg(F.avg((F.col(target) - F.col("prediction")) ** 2).alias("e"))
        out.append(err.crossJoin(base).select(F.lit(f).alias("feature"), F.round(F.col("e") - F.col("b"), 6).alias("rise")))
    return reduce(DataFrame.unionByName, out)


def partial_dependence(model: PipelineModel, df: DataFrame, feature: str, grid: list[float] | None = None, points: int = 10) -> DataFrame:
    """(value, prediction, n): mean prediction with the feature set to each value of a grid (its own quantiles if none is given).

    A row meets the grid as it is scored and goes into one partial sum a grid point; what is shuffled has a row a grid point and task."""
    grid = grid if grid is not None else sorted({q for q in quantiles(df, {"v": feature}, [i / (points - 1) for i in range(points)])["v"] if q is not None})
    values = F.explode(F.array(*[F.lit(float(v)) for v in grid])).alias("_value")
    src = df.drop(feature).select("*", values).withColumn(feature, F.col("_value"))
    return model.transform(src).groupBy(F.col("_value").alias("value")).agg(F.avg("prediction").alias("prediction"), F.count("*").alias("n"))


def row_contributions(model: PipelineModel, df: DataFrame, row: Column, features: list[str]) -> DataFrame:
    """(feature, value, contribution): how far the prediction of the one row that ``row`` picks falls when a feature is set to the mean of all rows."""
    means = df.agg(*[F.avg(f).alias(f) for f in features]).first()
    one = df.where(row).limit(1)
    swaps = [F.struct(F.lit("").alias("_swap"), *[F.col(f).cast("double").alias(f) for f in features])]
    for c in features:
        swaps.append(F.struct(F.lit(c).alias("_swap"), *[(F.lit(means[f]) if f == c else F.col(f)).cast("double").alias(f) for f in features]))
    told = one.select(F.explode(F.array(*swaps)).alias("s"), *[F.col(f).cast("double").alias(f"_own_{f}") for f in features], *[c for c in df.columns if c not in features]).select("s.*", *[c for c in df.columns if c not in features], *[f"_own_{f}" for f in features])
    scored = stored(model.transform(told).select("_swap", "prediction", *[f"_own_{f}" for f in features]), "swaps")
    base = scored.where("_swap = ''").select(F.col("prediction").alias("_base"))
    own = F.coalesce(*[F.when(F.col("_swap") == f, F.col(f"_own_{f}")) for f in features])
    return scored.where("_swap <> ''").join(F.broadcast(base)).select(F.col("_swap").alias("feature"), own.alias("value"), (F.col("_base") - F.col("prediction")).alias("contribution"))


def random_search(df: DataFrame, target: str, features: list[str], key: list[str], trials: int = 5, folds: int = 3, seed: int = 42) -> DataFrame:
    """(trial, regParam, elasticNetParam, rmse) of randomly drawn linear models, cross-validated by hashed folds."""
    rng = np.random.default_rng(seed)
    rows = df.where(F.col(target).isNotNull()).withColumn("_y", F.col(target).cast("double"))
    prepared = stored(Pipeline(stages=prep_stages(df, features)).fit(rows).transform(rows).select("features", "_y", (fold_column(key, seed) % folds).alias("_f")), "search-rows")
    out = []
    for t in range(trials):
        reg, net = float(10 ** rng.uniform(-3, 1)), float(rng.uniform())
        scores = []
        for f in range(folds):
            m = LinearRegression(labelCol="_y", regParam=reg, elasticNetParam=net).fit(prepared.where(f"_f <> {f}"))
            scores.append(regression_metrics(m.transform(prepared.where(f"_f = {f}"))).first().rmse)
        out.append((t, reg, net, float(np.mean(scores))))
    return df.sparkSession.createDataFrame(out, "trial int, regParam double, elasticNetParam double, rmse double")


def knn(train_rows: DataFrame, queries: DataFrame, id_col: str, features: list[str], label: str, k: int = 5) -> DataFrame:
    """(query, prediction): most frequent label of the k nearest rows (Euclid; ties by id, then label).  Queries are a stated set."""
    vector = F.array(*[F.col(f).cast("double") for f in features])
    there = " and ".join(f"`{f}` is not null" for f in features)
    near = stored(nearest(train_rows.where(there), queries.where(there), id_col, vector, k).select("query", "id"), "knn-near")
    labels = train_rows.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"))
    votes = labels.join(broadcast_if_small(near), "id").groupBy("query", "label").agg(F.count("*").alias("n"))
    return votes.groupBy("query").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("prediction"))


def scaled(df: DataFrame, features: list[str]) -> DataFrame:
    src = df.where(" and ".join(f"`{f}` is not null" for f in features))
    stages = [VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True)]
    return Pipeline(stages=stages).fit(src).transform(src).drop("_raw")


def kmeans(df: DataFrame, features: list[str], k_min: int = 2, k_max: int = 8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(rows with cluster, scores per k): the best silhouette picks k."""
    src = scaled(df, features)
    found = []
    for k in range(k_min, k_max + 1):
        m = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(src)
        score = ClusteringEvaluator(predictionCol="cluster", featuresCol="features").evaluate(m.transform(src))
        found.append((k, float(m.summary.trainingCost), float(score), m))
    best = max(found, key=lambda x: x[2])[3]
    scores = df.sparkSession.createDataFrame([f[:3] for f in found], "k int, inertia double, silhouette double")
    return best.transform(src).drop("features"), scores


def pca(df: DataFrame, features: list[str], n: int = 2) -> tuple[DataFrame, list[float]]:
    src = scaled(df, features)
    m = PCA(k=n, inputCol="features", outputCol="_p").fit(src)
    out = m.transform(src).withColumn("_p", vector_to_array("_p"))
    return out.select(*df.columns, *[F.col("_p")[i].alias(f"pc{i + 1}") for i in range(n)]), m.explainedVariance.toArray().tolist()


def isolation_forest(df: DataFrame, features: list[str], key: list[str], trees: int = 200, sample: int = 256, contamination: float = 0.05, seed: int = 42) -> DataFrame:
    """Rows with ``anomaly_score`` and ``anomaly``: trees grown on at most ``sample`` rows each, drawn from all rows by a hash per tree (a documented
    bound), all rows scored in Arrow batches, the cut at the 1 - contamination quantile."""
    src = df.where(" and ".join(f"`{f}` is not null" for f in features))
    # each tree draws from all rows by its own hash; ties and repeated keys are broken by the values
    total = src.count()
    share = min(1.0, 4.0 * sample / max(1, total))
    # a row finds its trees before it is repeated for them; a condition a tree is compiled, a function over an array is not
    place = lambda t: F.xxhash64(F.lit(seed), F.lit(t), *key)
    tree = F.array_compact(F.array(*[F.when(F.pmod(place(t), F.lit(1 << 30)) < int(share * (1 << 30)), t) for t in range(trees)]))
    drawn = src.select(*[F.col(f).cast("double").alias(f) for f in features], F.struct(*key).alias("_key"), F.explode(tree).alias("_tree"))
    drawn = drawn.withColumn("_h", F.xxhash64(F.lit(seed), "_tree", "_key"))
    order = Window.partitionBy("_tree").orderBy("_h", *features)
    drawn = drawn.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= sample)
    table = drawn.orderBy("_tree", "_r").select("_tree", *features).toPandas()
    draws = [g[features].to_numpy(dtype=float) for _, g in table.groupby("_tree")]
    rng = np.random.default_rng(seed)
    depth = int(np.ceil(np.log2(max(2, sample))))

    def grow(x: np.ndarray, d: int):
        lo, hi = (x.min(axis=0), x.max(axis=0)) if len(x) else (np.zeros(1), np.zeros(1))
        free = np.flatnonzero(hi > lo)
        if d >= depth or len(x) <= 1 or not len(free):
            return d + _path(len(x))
        f = int(rng.choice(free))
        cut = float(rng.uniform(lo[f], hi[f]))
        left = x[:, f] < cut
        return f, cut, grow(x[left], d + 1), grow(x[~left], d + 1)

    forest = [_masks(grow(x, 0), len(features)) for x in draws]
    shared, norm = df.sparkSession.sparkContext.broadcast(forest), _path(sample)

    @F.pandas_udf("double")
    def score(cols: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        # all cuts of a feature at once; each tree knows how many of its own lie below
        cuts = [np.unique(np.concatenate([t[1][f][0] for t in shared.value] or [np.zeros(0)])) for f in range(len(features))]
        own = [[np.concatenate([[0], np.searchsorted(c, cuts[f], side="right")]) for f, (c, _) in enumerate(by)] for _, by in shared.value]
        for pdf in cols:
            x, total = pdf.to_numpy(dtype=float), np.zeros(len(pdf))
            at = [np.searchsorted(cuts[f], x[:, f], side="right") for f in range(len(features))]
            for (leaves, by), mine in zip(shared.value, own):
                open_ = np.full((len(x), -(-len(leaves) // 64)), ~np.uint64(0))
                for f, (c, masks) in enumerate(by):
                    if len(c):
                        open_ &= masks[mine[f][at[f]]]
                word = (open_ != 0).argmax(axis=1)
                left = open_[np.arange(len(x)), word]
                total += leaves[64 * word + np.bitwise_count((left & (~left + np.uint64(1))) - np.uint64(1))]
            yield pd.Series(2 ** (-total / max(1, len(shared.value)) / norm))

    out = stored(src.withColumn("anomaly_score", score(F.struct(*[F.col(f).cast("double") for f in features]))), "anomaly-scores")
    cut = out.agg(F.percentile_approx("anomaly_score", 1 - contamination, 10_000).alias("_cut"))
    return out.crossJoin(F.broadcast(cut)).withColumn("anomaly", F.col("anomaly_score") > F.col("_cut")).drop("_cut")


def _masks(tree, features: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(values of the leaves from the left, per feature its cuts in order and, for each number of cuts that a value is not below, the leaves still open).

    A node whose cut the value is not below closes the leaves on its left; the first leaf that all features leave open is that of the row."""
    leaves, nodes = [], []

    def walk(node) -> None:
        if not isinstance(node, tuple):
            leaves.append(node)
            return
        first = len(leaves)
        walk(node[2])
        nodes.append((node[0], node[1], first, len(leaves)))
        walk(node[3])

    walk(tree)
    out = []
    for f in range(features):
        mine = sorted((cut, a, z) for g, cut, a, z in nodes if g == f)
        open_ = np.ones((len(mine) + 1, 64 * -(-len(leaves) // 64)), bool)
        for i, (_, a, z) in enumerate(mine):
            open_[i + 1 :, a:z] = False
        out.append((np.array([c for c, _, _ in mine]), np.packbits(open_, axis=1, bitorder="little").view(np.uint64)))
    return np.array(leaves, dtype=float), out


def _path(n: int) -> float:
    """Mean depth of an unsuccessful search in a tree of n rows."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def resample(df: DataFrame, date: str, value: str, grain: str = "month", group: list[str] | None = None) -> DataFrame:
    """(group, period, value): sums per period; empty periods between a group's first and last are 0."""
    keys = group or []
    g = df.groupBy(*keys, F.date_trunc(grain, date).cast("date").alias("period")).agg(F.sum(value).alias("value"))
    step = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month", "quarter": "interval 3 months", "year": "interval 1 year"}[grain]
    span = g.groupBy(*keys).agg(F.min("period").alias("a"), F.max("period").alias("z"))
    grid = span.select(*keys, F.explode(F.sequence("a", "z", F.expr(step))).alias("period"))
    return grid.join(g, [*keys, "period"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def seasonal_naive(series: DataFrame, group: list[str], season: int, horizon: int) -> DataFrame:
    """(group, step, forecast): the value one season before, repeated."""
    w = Window.partitionBy(*group).orderBy(F.desc("period"))
    last = series.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= season)
    steps = F.explode(F.filter(F.sequence(F.lit(1), F.lit(horizon)), lambda h: F.pmod(h - 1, F.lit(season)) == F.lit(season) - F.col("_r"))).alias("step")
    return last.select(*group, steps, F.col("value").alias("forecast"))


def holt_winters(y: np.ndarray, season: int, horizon: int) -> tuple[np.ndarray, float]:
    """(forecast, residual sd): additive smoothing; the best of a fixed grid of factors by squared one-step error."""
    best = None
    seasonal = season > 1 and len(y) >= 2 * season
    for alpha in (0.1, 0.3, 0.5, 0.8):
        for beta in (0.0, 0.1, 0.3):
            for gamma in (0.05, 0.2, 0.5) if seasonal else (0.0,):
                m = season if seasonal else 1
                level, slope = (y[:m].mean(), (y[m : 2 * m].mean() - y[:m].mean()) / m) if seasonal else (y[0], y[1] - y[0])
                s = list(y[:m] - level - slope * (np.arange(m) - (m - 1) / 2)) if seasonal else [0.0]
                level += slope * (m - 1) / 2 if seasonal else 0.0
                err = []
                for t in range(m if seasonal else 1, len(y)):
                    k = t % m
                    f = level + slope + s[k]
                    err.append(y[t] - f)
                    new = alpha * (y[t] - s[k]) + (1 - alpha) * (level + slope)
                    slope = beta * (new - level) + (1 - beta) * slope
                    s[k] = gamma * (y[t] - new) + (1 - gamma) * s[k] if seasonal else 0.0
                    level = new
                sse = float(np.square(err).sum())
                if best is None or sse < best[0]:
                    out = np.array([level + (h + 1) * slope + s[(len(y) + h) % m] for h in range(horizon)])
                    best = (sse, out, float(np.std(err)))
    return best[1], best[2]


def forecast(series: DataFrame, group: list[str], season: int = 12, horizon: int = 12) -> DataFrame:
    """(group, step, forecast, low, high) of each group's own series: Holt-Winters from 8 periods on, else the last value."""
    schema = ", ".join(f"{g} {dict(series.dtypes)[g]}" for g in group) + ", step int, forecast double, low double, high double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("period")["value"].to_numpy(dtype=float)
        f, sd = holt_winters(y, season, horizon) if len(y) >= 8 else (np.full(horizon, y[-1]), float(np.std(y)))
        width = 1.959964 * sd * np.sqrt(np.arange(1, horizon + 1))
        made = {g: [pdf[g].iloc[0]] * horizon for g in group}
        return pd.DataFrame({**made, "step": np.arange(1, horizon + 1), "forecast": f, "low": f - width, "high": f + width})

    return series.groupBy(*group).applyInPandas(one, schema)


def pareto_front(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows that no other row beats (both smaller is better).

    Only the least y of each x can stand; along ascending x a row stands if its y is below the least y of all smaller x.
    The running minimum is taken inside ranges of x and carried over by the minimum of the ranges before."""
    best = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x).agg(F.min(y).alias("_y"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = stored(best.repartitionByRange(n, x).withColumn("_p", F.spark_partition_id()), "pareto")
    lows = r.groupBy("_p").agg(F.min("_y").alias("_m"))
    carry = lows.select("_p", F.min("_m").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_c"))
    w = Window.partitionBy("_p").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    stand = r.withColumn("_b", F.min("_y").over(w)).join(F.broadcast(carry), "_p").where(F.col("_y") < F.coalesce(F.least("_b", "_c"), F.lit(float("inf"))))
    return df.join(stand.select(F.col(x).alias("_x"), "_y"), (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y"))).drop("_x", "_y")


#: Quantile cells along each objective of ``skyline``.
CELLS = 8


def _front(points: np.ndarray) -> np.ndarray:
    """Places of the points that no other one dominates (all coordinates at most as large, one smaller)."""
    order = np.argsort(points.sum(axis=1), kind="stable")
    left = order
    kept = []
    while len(left):
        p = points[left[0]]  # least sum of what is left: nothing dominates it
        kept.append(left[0])
        worse = (points[left] >= p).all(axis=1)
        left = left[~worse]
    return np.array(kept, dtype=np.int64)


def skyline(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that no other row beats in all objectives (smaller is better; equal rows all stand).

    Distinct points fall into a grid of quantile cells; a cell that is behind a filled one in every objective goes whole.  Points are thinned to
    their batch's own front; those left are compared with the fronts of cells that are not behind them in any objective."""
    k = len(columns)
    points = df.where(" and ".join(f"`{c}` is not null and not isnan(`{c}`)" for c in columns)).select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]).distinct()

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
            yield b.take(pa.array(_front(values)))

    local = stored(points.mapInArrow(thin, points.schema), "skyline-local")
    cuts = local.approxQuantile([f"v{i}" for i in range(k)], [j / CELLS for j in range(1, CELLS)], 0.01)
    cell = lambda i: sum(((F.col(f"v{i}") > x).cast("int") for x in sorted(set(cuts[i]))), F.lit(0))
    local = stored(local.withColumns({f"c{i}": cell(i) for i in range(k)}), "skyline-cells")
    filled = stored(local.select(*[f"c{i}" for i in range(k)]).distinct(), "skyline-filled")  # CELLS^k rows at most
    ahead = filled.select(*[F.col(f"c{i}").alias(f"d{i}") for i in range(k)])
    behind = " and ".join(f"d{i} < c{i}" for i in range(k))
    live = filled.join(F.broadcast(ahead), F.expr(behind), "left_anti")
    open_ = stored(local.join(F.broadcast(live), [f"c{i}" for i in range(k)]), "skyline-open")
    rivals = open_.select(*[F.col(f"v{i}").alias(f"w{i}") for i in range(k)], *[F.col(f"c{i}").alias(f"d{i}") for i in range(k)])
    # each live cell meets the live cells that are not behind it
    pairs = live.join(F.broadcast(live.select(*[F.col(f"c{i}").alias(f"d{i}") for i in range(k)])), F.expr(" and ".join(f"d{i} <= c{i}" for i in range(k))))
    met = open_.join(broadcast_if_small(stored(pairs, "skyline-pairs")), [f"c{i}" for i in range(k)])
    beaten = met.join(rivals, [f"d{i}" for i in range(k)]).where(F.expr(" and ".join(f"w{i} <= v{i}" for i in range(k))) & F.expr(" or ".join(f"w{i} < v{i}" for i in range(k))))
    gone = stored(beaten.select(*[f"v{i}" for i in range(k)]).distinct(), "skyline-beaten")
    front = open_.join(broadcast_if_small(gone), [f"v{i}" for i in range(k)], "left_anti").select(*[f"v{i}" for i in range(k)])
    same = [F.col(c).cast("double") == F.col(f"v{i}") for i, c in enumerate(columns)]
    return df.join(broadcast_if_small(stored(front, "skyline-front")), same, "left_semi")
