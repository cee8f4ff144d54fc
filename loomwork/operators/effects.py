"""Effects of an intervention beyond the point estimate: difference in differences with covariates, fixed effects and its checks, regression
adjustment with overlap and robustness, interrupted series with seasons, counterfactual and placebo dates, and refuters.

Sums and Gram matrices come from Spark aggregations; what is solved in the driver has one row a term or one a group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tails
from ..tables import broadcast_if_small, stored
from .stats import _gram, design, ols
from .steps import StepError

#: p below which a check has failed: parallel trends, and a placebo date.
TREND_P, PLACEBO_P = 0.10, 0.05


def _flags(df: DataFrame, treated: str, after) -> DataFrame:
    out = df.withColumns({"_t": F.col(treated).cast("double"), "_a": after.cast("double")})
    return out.withColumn("_ta", F.col("_t") * F.col("_a"))


def cells(df: DataFrame, y: str, treated: str, time: str, at: float) -> DataFrame:
    """(treated, after, n, mean) of the four cells; an empty one is an error."""
    src = _flags(df.where(F.col(y).isNotNull() & F.col(time).isNotNull()), treated, F.col(time) >= at)
    out = stored(src.groupBy("_t", "_a").agg(F.count("*").alias("n"), F.avg(y).alias("mean")), "did-cells")
    if out.count() < 4:
        raise StepError(f"one of the four cells of treated and after {at} has no rows")
    return out.select(F.col("_t").cast("int").alias("treated"), F.col("_a").cast("int").alias("after"), "n", "mean")


def did_covariates(df: DataFrame, y: str, treated: str, time: str, at: float, covariates: list[str], unit: str | None = None) -> DataFrame:
    """(estimate, se, p) of treated x after beside covariates; errors by unit if one is given, else HC3."""
    src = _flags(df, treated, F.col(time) >= at)
    fit = ols(src, y, ["_t", "_a", "_ta", *covariates], "cluster" if unit else "HC3", unit)
    return fit.where("term = '_ta'").select(F.col("beta").alias("estimate"), "se", "p")


def within(df: DataFrame, columns: list[str], effects: list[str], close: float = 1e-9, turns: int = 500) -> DataFrame:
    """Written rows with ``columns`` freed of all fixed effects, by taking means off one effect after the other until the means of every effect
    vanish against the spread; balanced panels need one turn.  No convergence within ``turns`` is an error, not a result."""
    at = stored(df, "within")
    spread = at.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    for _ in range(turns):
        for e in effects:
            means = stored(at.groupBy(e).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns]), "within-means")
            at = at.join(broadcast_if_small(means), e).withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in columns}).select(df.columns)
        at = stored(at, "within")
        left = at.groupBy(effects[0]).agg(*[F.avg(c).alias(c) for c in columns]).agg(*[F.max(F.abs(c)).alias(c) for c in columns]).first()
        if all((left[c] or 0.0) <= close * (spread[c] or 1.0) for c in columns):
            return at
    raise StepError(f"fixed effects did not converge in {turns} turns")


def did_fixed(df: DataFrame, y: str, treated: str, time: str, at: float, unit: str, covariates: list[str] | None = None) -> DataFrame:
    """(term, beta, se, t, p): treated x after, with unit and period effects taken out (Frisch-Waugh-Lovell), errors clustered by unit."""
    xs = ["_ta", *(covariates or [])]
    src = design(_flags(df, treated, F.col(time) >= at), y, xs).where(F.col(unit).isNotNull() & F.col(time).isNotNull())
    rows = within(src.select(y, *xs, unit, time), [y, *xs], [unit, time])
    gram, b, _, n = _gram(rows, y, xs)
    inv = np.linalg.inv(gram[1:, 1:])
    beta = inv @ b[1:]
    e = F.col(y) - sum((float(v) * F.col(x) for v, x in zip(beta, xs)), F.lit(0.0))
    scores = rows.groupBy(unit).agg(*[F.sum(e * F.col(x)).alias(f"_s{i}") for i, x in enumerate(xs)])
    k = len(xs)
    made = [F.sum(F.col(f"_s{i}") * F.col(f"_s{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]
    r = scores.agg(*made, F.count("*").alias("g")).first()
    meat = np.array([[r[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    scale = r.g / (r.g - 1) * (n - 1) / max(1, n - k)
    se = np.sqrt(np.maximum(np.diag(scale * inv @ meat @ inv), 0))
    out = [(x, float(v), float(s), float(v / s) if s else None, tails.t_tail(float(v / s), r.g - 1) if s else None) for x, v, s in zip(["treated_after", *xs[1:]], beta, se)]
    return df.sparkSession.createDataFrame(out, "term string, beta double, se double, t double, p double")


def did_pretrend(df: DataFrame, y: str, treated: str, time: str, at: float, unit: str | None = None) -> DataFrame:
    """(slope, se, p, implied_bias): how much faster the treated rose per unit of time before ``at``, and what that would add up to from the
    mean time before to the mean time after."""
    t = F.col(time).cast("double")
    means = df.where(F.col(y).isNotNull()).agg(F.avg(F.when(t < at, t)).alias("before"), F.avg(F.when(t >= at, t)).alias("after")).first()
    pre = df.where(t < at).withColumns({"_t": F.col(treated).cast("double"), "_c": t - (means.before or 0.0)})
    pre = pre.withColumn("_tc", F.col("_t") * F.col("_c"))
    fit = ols(pre, y, ["_t", "_c", "_tc"], "cluster" if unit else "HC3", unit).where("term = '_tc'")
    ahead = (means.after - means.before) if means.after is not None and means.before is not None else math.nan
    return fit.select(F.col("beta").alias("slope"), "se", "p", (F.col("beta") * ahead).alias("implied_bias"))


def did_event_study(df: DataFrame, y: str, treated: str, time: str, at: float) -> DataFrame:
    """(time, estimate, se): difference of the groups per period, less that of the last period before ``at``; one aggregation of cells."""
    v, t = F.col(y).cast("double"), F.col(treated).cast("int")
    side = lambda s, f: f(F.when(t == s, v))
    per = df.where(v.isNotNull()).groupBy(F.col(time).alias("time")).agg(
        (side(1, F.avg) - side(0, F.avg)).alias("gap"), (side(1, F.var_samp) / side(1, F.count) + side(0, F.var_samp) / side(0, F.count)).alias("var")
    )
    per = stored(per.where("gap is not null"), "event-study")
    last = per.where(F.col("time") < at).agg(F.max_by(F.struct("time", "gap", "var"), "time").alias("r")).select(F.col("r.time").alias("rt"), F.col("r.gap").alias("rg"), F.col("r.var").alias("rv"))
    same = F.col("time") == F.col("rt")
    return per.join(F.broadcast(last)).select("time", (F.col("gap") - F.col("rg")).alias("estimate"), F.when(same, 0.0).otherwise(F.sqrt(F.col("var") + F.col("rv"))).alias("se"))


def pre_times(df: DataFrame, time: str, at: float) -> list[float]:
    """Distinct times before the intervention: as many as there are periods."""
    return sorted(float(r.t) for r in df.where(F.col(time) < at).select(F.col(time).cast("double").alias("t")).distinct().collect())


def did_placebo(df: DataFrame, y: str, treated: str, time: str, at: float, unit: str | None = None, covariates: list[str] | None = None, placebo_at: float | None = None) -> DataFrame:
    """(placebo_at, estimate, se, p): the same estimate at a date (the middle one if none is given) before the intervention, on rows before it."""
    if placebo_at is None:
        times = pre_times(df, time, at)
        if len(times) < 4:
            raise StepError("a placebo date needs four periods before the intervention")
        placebo_at = times[len(times) // 2]
    out = did_covariates(df.where(F.col(time) < at), y, treated, time, placebo_at, covariates or [], unit)
    return out.select(F.lit(float(placebo_at)).alias("placebo_at"), "estimate", "se", "p")


def did_checks(df: DataFrame, y: str, treated: str, time: str, at: float, unit: str | None = None) -> DataFrame:
    """(assumption, status): parallel trends and a placebo date passed, failed or not_testable (too few periods); what data can't test is said so."""
    cells(df, y, treated, time, at)
    times = pre_times(df, time, at)
    out = [("parallel_trends", "not_testable"), ("placebo_date", "not_testable")]
    if len(times) >= 3:
        out[0] = ("parallel_trends", "failed" if did_pretrend(df, y, treated, time, at, unit).first().p < TREND_P else "passed")
    if len(times) >= 4:
        out[1] = ("placebo_date", "failed" if did_placebo(df, y, treated, time, at, unit).first().p < PLACEBO_P else "passed")
    out += [(x, "not_testable") for x in ("no_other_change", "no_spillover", "same_composition")]
    return df.sparkSession.createDataFrame(out, "assumption string, status string")


# ---- regression adjustment


def robustness_value(t: float, dof: float, off: float = 0.0) -> float:
    """Share of the rest of both treatment and outcome that an unseen confounder must explain to move t to ``off`` (Cinelli and Hazlett, 2020)."""
    f = max(abs(t) / math.sqrt(dof) - off / math.sqrt(dof), 0.0)
    return 0.5 * (math.sqrt(f**4 + 4 * f**2) - f**2)


def adjust_effect(df: DataFrame, y: str, treated: str, confounders: list[str]) -> DataFrame:
    """(naive, estimate, se, p, shift, robustness, robustness_bound, strongest, partial_r2): effect of the treatment beside the confounders with HC3
    errors; the robustness values of the estimate and of its interval's end; the confounder that explains most."""
    src = design(df, y, [treated, *confounders])
    naive = ols(src, y, [treated]).where(F.col("term") == treated).first().beta
    fit = {r.term: r for r in ols(src, y, [treated, *confounders], "HC3").collect()}
    dof = src.count() - len(confounders) - 2
    own = fit[treated]
    shares = sorted(((fit[c].t ** 2 / (fit[c].t ** 2 + dof), c) for c in confounders), reverse=True)
    bound = robustness_value(own.t, dof, tails.t_quantile(0.95, dof))
    row = (naive, own.beta, own.se, own.p, own.beta - naive, robustness_value(own.t, dof), bound, shares[0][1] if shares else None, shares[0][0] if shares else None)
    return df.sparkSession.createDataFrame([row], "naive double, estimate double, se double, p double, shift double, robustness double, robustness_bound double, strongest string, partial_r2 double")


def adjust_path(df: DataFrame, y: str, treated: str, confounders: list[str]) -> DataFrame:
    """(adjusted_for, n_confounders, estimate, se): the effect as confounders are added one by one, and without each of them.  All are sub-blocks of
    one Gram matrix, so the rows are read once."""
    src = design(df, y, [treated, *confounders])
    gram, b, yy, n = _gram(src, y, [treated, *confounders])
    sets = [list(range(k)) for k in range(len(confounders) + 1)] + [[i for i in range(len(confounders)) if i != j] for j in range(len(confounders))]
    out = {}
    for some in sets:
        at = [0, 1, *[2 + i for i in some]]
        inv = np.linalg.inv(gram[np.ix_(at, at)])
        beta = inv @ b[at]
        s2 = max(yy - float(beta @ b[at]), 0.0) / (n - len(at))
        out[",".join(confounders[i] for i in some)] = (len(some), float(beta[1]), math.sqrt(inv[1, 1] * s2))
    return df.sparkSession.createDataFrame([(k, *v) for k, v in out.items()], "adjusted_for string, n_confounders int, estimate double, se double")


def adjust_range(df: DataFrame, treated: str, confounders: list[str]) -> DataFrame:
    """(confounder, outside): share of the treated rows outside the range of the others."""
    is_treated = F.col(treated).cast("int") == 1
    ends = df.agg(*[f(F.when(~is_treated, F.col(c).cast("double"))).alias(f"{c}_{n}") for c in confounders for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = [F.avg(F.when(is_treated & F.col(c).isNotNull(), ((F.col(c) < ends[f"{c}_lo"]) | (F.col(c) > ends[f"{c}_hi"])).cast("double"))).alias(c) for c in confounders]
    one = df.agg(*out)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("confounder"), F.col(c).alias("outside")) for c in confounders])).alias("r")).select("r.*")


def propensity(df: DataFrame, treated: str, confounders: list[str], penalty: float = 1e-3) -> DataFrame:
    """Rows with ``score``, the fitted probability of treatment (logistic regression on standardised confounders, almost no penalty)."""
    src = design(df, treated, confounders)
    made = VectorAssembler(inputCols=confounders, outputCol="_x").transform(src)
    made = StandardScaler(inputCol="_x", outputCol="_z", withMean=True).fit(made).transform(made)
    model = LogisticRegression(featuresCol="_z", labelCol=treated, regParam=penalty / max(1, src.count()), probabilityCol="_p", tol=1e-10, maxIter=500).fit(made)
    return model.transform(made).withColumn("score", vector_to_array("_p")[1]).drop("_x", "_z", "_p", "rawPrediction", "prediction")


def adjust_overlap(df: DataFrame, treated: str, confounders: list[str], bins: int = 10) -> DataFrame:
    """(bin, treated, control, low, high, outside): propensity scores of both groups in bins; common support from ``low`` to ``high`` and the share outside."""
    scored = stored(propensity(df, treated, confounders).select(F.col(treated).cast("int").alias("t"), "score"), "propensity")
    side = lambda s, f: f(F.when(F.col("t") == s, F.col("score")))
    ends = scored.agg(F.greatest(side(0, F.min), side(1, F.min)).alias("low"), F.least(side(0, F.max), side(1, F.max)).alias("high"))
    both = scored.join(F.broadcast(ends))
    outside = both.agg(F.avg(((F.col("score") < F.col("low")) | (F.col("score") > F.col("high"))).cast("double")).alias("outside"))
    per = both.groupBy(F.least(F.lit(bins - 1), F.floor(F.col("score") * bins)).cast("int").alias("bin"), "low", "high").agg(F.count_if(F.col("t") == 1).alias("treated"), F.count_if(F.col("t") == 0).alias("control"))
    return per.join(F.broadcast(outside)).select("bin", "treated", "control", "low", "high", "outside")


# ---- interrupted series


def _per_time(df: DataFrame, y: str, time: str, group: list[str]) -> DataFrame:
    """One row a time of each series: the mean of what shares it."""
    v, t = F.col(y).cast("double"), F.col(time).cast("double")
    return df.where(v.isNotNull() & t.isNotNull()).groupBy(*group, t.alias("time")).agg(F.avg(v).alias("y"))


def _season(c: str, step: float, season: int | None) -> dict:
    place = F.pmod(F.round(F.col(c) / step).cast("long"), F.lit(season or 1))
    return {f"_s{i}": (place == i).cast("double") for i in range(1, season or 1)}


def its_scan(df: DataFrame, y: str, time: str, group: list[str], season: int | None = None, step: float = 1.0, margin: int = 3) -> DataFrame:
    """(group, time, level, slope, se, p): change of level and slope at every time of a series, ``margin`` points from its ends at least.

    With b = (1, time, seasons), all sums that the design of a break at c needs are sums of b b' and b y over all times and over those from c on.
    The latter are running sums along the series, so every candidate date costs one small solve and no further scan."""
    if not group:
        raise StepError("a series needs a group column")
    rows = _per_time(df, y, time, group)
    first = Window.partitionBy(*group)
    rows = rows.withColumn("_o", F.min("time").over(first)).withColumn("_k", F.col("time") - F.col("_o")).withColumns(_season("_k", step, season))
    terms = [F.lit(1.0), F.col("_k"), *[F.col(f"_s{i}") for i in range(1, season or 1)]]
    m = len(terms)
    ahead = first.orderBy("time").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    made = [(terms[i] * terms[j]) for i in range(m) for j in range(i, m)] + [x * F.col("y") for x in terms] + [F.col("y") ** 2]
    sums = {"_all": F.array(*[F.sum(c).over(whole) for c in made]), "_late": F.array(*[F.sum(c).over(ahead) for c in made])}
    place = {"_no": F.row_number().over(first.orderBy("time")), "_n": F.count("*").over(whole)}
    cand = rows.select(*group, "time", "_k", *[c.alias(n) for n, c in (sums | place).items()]).where((F.col("_no") > margin) & (F.col("_no") <= F.col("_n") - margin + 1))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = [(i, j) for i in range(m) for j in range(i, m)]

        def blocks(values: list[float]) -> tuple[np.ndarray, np.ndarray, float]:
            g = np.zeros((m, m))
            for (i, j), v in zip(upper, values):
                g[i, j] = g[j, i] = v
            return g, np.array(values[len(upper) : len(upper) + m]), values[-1]

        for batch in batches:
            out = []
            for c, total, late, n in zip(*[batch.column(x).to_pylist() for x in ("_k", "_all", "_late", "_n")]):
                g, b, yy = blocks(total)
                gl, bl, _ = blocks(late)
                # rows of post and post x (time - c) from the late sums
                level, ramp = gl[0], gl[1] - c * gl[0]
                corner = np.array([[level[0], ramp[0]], [ramp[0], ramp[1] - c * ramp[0]]])
                gram = np.block([[g, np.array([level, ramp]).T], [np.array([level, ramp]), corner]])
                rhs = np.append(b, [bl[0], bl[1] - c * bl[0]])
                dof = n - m - 2
                if dof < 1 or np.linalg.matrix_rank(gram) < m + 2:
                    out.append((None,) * 4)
                    continue
                inv = np.linalg.inv(gram)
                beta = inv @ rhs
                se = math.sqrt(inv[m, m] * max(yy - float(beta @ rhs), 0.0) / dof)
                out.append((float(beta[m]), float(beta[m + 1]), se, tails.t_tail(float(beta[m] / se), dof) if se else None))
            columns = [pa.array([r[i] for r in out], pa.float64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in (*group, "time")], *columns], [*group, "time", "level", "slope", "se", "p"])

    kinds = ", ".join(f"`{g}` {cand.schema[g].dataType.simpleString()}" for g in group)
    return cand.mapInArrow(solve, f"{kinds}, time double, level double, slope double, se double, p double").where("level is not null")


def its_placebo(df: DataFrame, y: str, time: str, at: float, group: list[str], season: int | None = None, step: float = 1.0) -> DataFrame:
    """``its_scan`` of the times before the intervention alone, where no break should be."""
    return its_scan(df.where(F.col(time) < at), y, time, group, season, step, 4)


def its_counterfactual(df: DataFrame, y: str, time: str, at: float, group: list[str], season: int | None = None, step: float = 1.0) -> DataFrame:
    """(group, time, y, fitted, counterfactual, effect): what each series would have been had the trend (and seasons) before ``at`` gone on."""
    if not group:
        raise StepError("a series needs a group column")
    rows = stored(_per_time(df, y, time, group), "its-rows")
    one = Window.partitionBy(*group)
    made = rows.withColumn("_k", F.col("time") - F.min("time").over(one)).withColumns({"_post": (F.col("time") >= at).cast("double"), **_season("_k", step, season)})
    made = made.withColumn("_ramp", F.col("_post") * (F.col("time") - at))
    xs = ["_k", "_post", "_ramp", *[f"_s{i}" for i in range(1, season or 1)]]
    k = len(xs) + 1
    terms = [F.lit(1.0), *[F.col(x) for x in xs]]
    sums = [F.sum(terms[i] * terms[j]) for i in range(k) for j in range(i, k)] + [F.sum(t * F.col("y")) for t in terms]
    grams = made.groupBy(*group).agg(F.array(*sums).alias("_sums"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = [(i, j) for i in range(k) for j in range(i, k)]
        for batch in batches:
            betas = []
            for v in batch.column("_sums").to_pylist():
                g = np.zeros((k, k))
                for (i, j), x in zip(upper, v):
                    g[i, j] = g[j, i] = x
                betas.append(np.linalg.lstsq(g, np.array(v[len(upper) :]), rcond=None)[0].tolist())
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in group], pa.array(betas, pa.list_(pa.float64()))], [*group, "_beta"])

    kinds = ", ".join(f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in group)
    beta = stored(grams.mapInArrow(solve, f"{kinds}, _beta array<double>"), "its-beta")
    full = sum((F.get("_beta", F.lit(i)) * terms[i] for i in range(1, k)), F.get("_beta", F.lit(0)))
    moved = F.get("_beta", F.lit(2)) * F.col("_post") + F.get("_beta", F.lit(3)) * F.col("_ramp")
    out = made.join(broadcast_if_small(beta), group)
    return out.select(*group, "time", "y", full.alias("fitted"), (full - moved).alias("counterfactual"), (F.col("y") - (full - moved)).alias("effect"))


# ---- refuters


def _weighted_effects(df: DataFrame, y: str, treated: str, confounders: list[str], weights: list, extra: list | None = None) -> list[float]:
    """Effect of the treatment in each replicate: Gram matrices of all replicates in one aggregation.  A replicate has a weight a row, and a column of
    its own (``extra``) if it is given one."""
    made, sizes = [], []
    for r, w in enumerate(weights):
        terms = [F.lit(1.0), F.col(treated), *[F.col(c) for c in confounders], *([extra[r]] if extra else [])]
        k = len(terms)
        sizes.append(k)
        sums = [F.sum(w * terms[i] * terms[j]) for i in range(k) for j in range(i, k)] + [F.sum(w * t * F.col(y)) for t in terms]
        made.append(F.array(*sums).alias(f"r{r}"))
    one = df.agg(*made).first()
    out = []
    for r, k in enumerate(sizes):
        g, v = np.zeros((k, k)), list(one[f"r{r}"])
        for (i, j), x in zip([(i, j) for i in range(k) for j in range(i, k)], v):
            g[i, j] = g[j, i] = x
        out.append(float(np.linalg.lstsq(g, np.array(v[k * (k + 1) // 2 :]), rcond=None)[0][1]))
    return out


def _uniform(key: list[str], seed: int, replicate: int):
    """Uniform number of a row in a replicate, by a hash of its key."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(replicate), *key), F.lit(1 << 30)) + 0.5) / float(1 << 30)


def refute_common_cause(df: DataFrame, y: str, treated: str, confounders: list[str], key: list[str], k: int = 20, seed: int = 7) -> DataFrame:
    """(replicate, effect): the adjusted effect beside a random confounder, a new one per replicate (normal, by a hash of the row key); it should not move."""
    src = stored(design(df, y, [treated, *confounders]), "refute-rows")
    noise = [F.sqrt(-2 * F.log(_uniform(key, seed, i))) * F.cos(2 * math.pi * _uniform(key, seed + 1, i)) for i in range(k)]
    effects = _weighted_effects(src, y, treated, confounders, [F.lit(1.0)] * k, noise)
    return df.sparkSession.createDataFrame(list(enumerate(effects)), "replicate int, effect double")


def refute_subsets(df: DataFrame, y: str, treated: str, confounders: list[str], key: list[str], share: float = 0.8, k: int = 20, seed: int = 7) -> DataFrame:
    """(replicate, effect): the adjusted effect in random subsets of the rows, drawn by a hash of the row key."""
    src = stored(design(df, y, [treated, *confounders]), "refute-rows")
    effects = _weighted_effects(src, y, treated, confounders, [(_uniform(key, seed, i) < share).cast("double") for i in range(k)])
    return df.sparkSession.createDataFrame(list(enumerate(effects)), "replicate int, effect double")
