"""Statistical tests, drift, story findings and least squares: sums by Spark, tails on the few numbers that are left."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tails
from ..tables import stored
from .ranks import mid_ranks, running_sum, quantiles


def one_row(source: DataFrame, /, **values) -> DataFrame:
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'double')}" for k, v in values.items())
    return source.sparkSession.createDataFrame([tuple(values.values())], schema)


def moments(df: DataFrame, column: str, group: str | None = None) -> DataFrame:
    v = F.col(column).cast("double")
    return df.where(v.isNotNull()).groupBy(*([group] if group else [])).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"))


def describe(df: DataFrame, column: str, confidence: float = 0.95) -> DataFrame:
    v = F.col(column).cast("double")
    q = quantiles(df, {"v": v}, [0.25, 0.5, 0.75])["v"]
    r = df.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.skewness(v).alias("skew")).first()
    half = tails.t_quantile(confidence, r.n - 1) * r.sd / math.sqrt(r.n) if r.n > 1 else math.nan
    return one_row(df, n=r.n, mean=r.mean, sd=r.sd, median=q[1], iqr=q[2] - q[0], skew=r.skew, ci_low=r.mean - half, ci_high=r.mean + half)


def ttest_1samp(df: DataFrame, column: str, mu: float) -> DataFrame:
    m = moments(df, column).first()
    t = (m.mean - mu) / math.sqrt(m["var"] / m.n)
    return one_row(df, t=t, df=float(m.n - 1), p=tails.t_tail(t, m.n - 1))


def ttest_rel(df: DataFrame, a: str, b: str) -> DataFrame:
    return ttest_1samp(df.select((F.col(a) - F.col(b)).alias("d")), "d", 0.0)


def welch(a, b) -> tuple[float, float, float]:
    """(t, df, p) of two (n, mean, var)."""
    va, vb = a["var"] / a.n, b["var"] / b.n
    t = (a.mean - b.mean) / math.sqrt(va + vb)
    df = (va + vb) ** 2 / (va**2 / (a.n - 1) + vb**2 / (b.n - 1))
    return t, df, tails.t_tail(t, df)


def ttest_ind(df: DataFrame, column: str, group: str) -> DataFrame:
    """Welch's test and Cohen's d of the two groups, in their order."""
    a, b = moments(df, column, group).orderBy(group).limit(3).collect()
    t, dof, p = welch(a, b)
    pooled = math.sqrt(((a.n - 1) * a["var"] + (b.n - 1) * b["var"]) / (a.n + b.n - 2))
    return one_row(df, t=t, df=dof, p=p, cohen_d=(a.mean - b.mean) / pooled)


def mannwhitney(df: DataFrame, column: str, group: str) -> DataFrame:
    """U of the first group; normal approximation with tie and continuity correction."""
    src = df.where(F.col(column).isNotNull() & F.col(group).isNotNull())
    ranked = mid_ranks(src.select(group, F.col(column).cast("double").alias("v")), "v", "r")
    a, b = ranked.groupBy(group).agg(F.count("*").alias("n"), F.sum("r").alias("r")).orderBy(group).collect()
    ties = src.groupBy(column).count().agg(F.sum(F.col("count").cast("double") ** 3 - F.col("count")).alias("t")).first().t
    n = a.n + b.n
    u = a.r - a.n * (a.n + 1) / 2
    sd = math.sqrt(a.n * b.n / 12 * ((n + 1) - ties / (n * (n - 1))))
    z = (abs(u - a.n * b.n / 2) - 0.5) / sd
    return one_row(df, u=float(u), p=min(1.0, tails.normal_tail(max(z, 0.0))))


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """Signed ranks of the differences that are not 0; normal approximation with tie correction."""
    d = df.select((F.col(a) - F.col(b)).cast("double").alias("d")).where("d <> 0").withColumn("v", F.abs("d"))
    r = mid_ranks(d, "v", "r").agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0)).alias("w")).first()
    ties = d.groupBy("v").count().agg(F.sum(F.col("count").cast("double") ** 3 - F.col("count")).alias("t")).first().t
    sd = math.sqrt(r.n * (r.n + 1) * (2 * r.n + 1) / 24 - ties / 48)
    return one_row(df, w=float(min(r.w, r.n * (r.n + 1) / 2 - r.w)), p=tails.normal_tail((r.w - r.n * (r.n + 1) / 4) / sd))


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    r = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("r"), F.count("*").alias("n")).first()
    t = r.r * math.sqrt((r.n - 2) / (1 - r.r**2))
    return one_row(df, r=r.r, n=r.n, p=tails.t_tail(t, r.n - 2))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    src = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    return pearson(mid_ranks(mid_ranks(src, "a", "ra"), "b", "rb"), "ra", "rb")


def linregress(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def chi2_contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(chi2, df, p) of the table of two columns; its cells come from one grouping."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    rows, cols = cells.groupBy(a).agg(F.sum("n").alias("ra")), cells.groupBy(b).agg(F.sum("n").alias("cb"))
    total = cells.agg(F.sum("n").alias("t"))
    grid = rows.crossJoin(cols).crossJoin(total).join(cells, [a, b], "left").fillna(0, ["n"])  # all cells of a small table
    e = F.col("ra") * F.col("cb") / F.col("t")
    r = grid.agg(F.sum((F.col("n") - e) ** 2 / e).alias("x"), F.countDistinct(a).alias("ka"), F.countDistinct(b).alias("kb")).first()
    dof = (r.ka - 1) * (r.kb - 1)
    return one_row(df, chi2=r.x, df=float(dof), p=tails.chi2_tail(r.x, dof))


def fisher_exact(df: DataFrame, a: str, b: str) -> DataFrame:
    """(odds ratio, p) of two boolean columns."""
    r = df.agg(*[F.count_if((F.col(a) == x) & (F.col(b) == y)).alias(f"n{int(x)}{int(y)}") for x in (True, False) for y in (True, False)]).first()
    n11, n10, n01, n00 = r.n11, r.n10, r.n01, r.n00
    row, col, n = n11 + n10, n11 + n01, n11 + n10 + n01 + n00
    log = lambda k: math.lgamma(k + 1)
    def prob(k: int) -> float:
        return log(row) - log(k) - log(row - k) + log(n - row) - log(col - k) - log(n - row - col + k) - (log(n) - log(col) - log(n - col))
    here = prob(n11)
    p = sum(math.exp(prob(k)) for k in range(max(0, row + col - n), min(row, col) + 1) if prob(k) <= here + 1e-7)
    return one_row(df, odds=n11 * n00 / (n10 * n01) if n10 * n01 else math.inf, p=min(1.0, p))


def proportion_ci(df: DataFrame, condition: str, z: float = 1.959963984540054) -> DataFrame:
    """Wilson interval of the share of rows that meet a condition."""
    n, k = F.count("*"), F.count_if(F.expr(condition))
    r = df.agg(n.alias("n"), k.alias("k"))
    p = F.col("k") / F.col("n")
    mid, half = (p + z * z / (2 * F.col("n"))) / (1 + z * z / F.col("n")), z * F.sqrt(p * (1 - p) / F.col("n") + z * z / (4 * F.col("n") ** 2)) / (1 + z * z / F.col("n"))
    return r.select("n", "k", F.round(p, 6).alias("share"), F.round(mid - half, 6).alias("low"), F.round(mid + half, 6).alias("high"))


def binom_test(df: DataFrame, condition: str, p0: float) -> DataFrame:
    r = df.agg(F.count("*").alias("n"), F.count_if(F.expr(condition)).alias("k")).first()
    return one_row(df, k=r.k, n=r.n, p=tails.binom_two_sided(r.k, r.n, p0))


# drift


def drift(a: DataFrame, b: DataFrame, column: str, alpha: float = 0.05, psi_limit: float = 0.2) -> DataFrame:
    """Two-sample KS, PSI on the reference's deciles (floor 1e-6), Wasserstein distance and shifts of mean and sd.

    Counts of both sides are merged by value and summed along range partitions; only a row of figures is left."""
    x = a.select(F.col(column).cast("double").alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).where("v is not null")
    y = b.select(F.col(column).cast("double").alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b")).where("v is not null")
    counts = x.unionByName(y).groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    run = running_sum(running_sum(counts, ["v"], "a", "ca"), ["v"], "b", "cb", "part")
    m = x.agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).first()
    deciles = quantiles(x, {"v": "v"}, [i / 10 for i in range(1, 10)])["v"]
    k = y.agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).first()
    gap = F.abs(F.col("ca") / m.n - F.col("cb") / k.n)
    # the distance is the area between the two step functions: each value's gap holds to the next value
    p = run.withColumn("gap", gap)
    w = Window.partitionBy("part").orderBy("v")
    inner = p.withColumn("next", F.lead("v").over(w))
    within = inner.where("next is not null").agg(F.sum(F.col("gap") * (F.col("next") - F.col("v"))).alias("w")).first().w or 0.0
    edge = sorted((r.lo, r.hi, r.g) for r in p.groupBy("part").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max_by("gap", "v").alias("g")).collect())
    between = sum(g * (nxt[0] - hi) for (_, hi, g), nxt in zip(edge, edge[1:]))
    ks = p.agg(F.max("gap").alias("d")).first().d
    en = math.sqrt(m.n * k.n / (m.n + k.n))
    lam = (en + 0.12 + 0.11 / en) * ks
    p_value = min(1.0, max(0.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * lam * lam) for j in range(1, 101)))) if lam > 0.2 else 1.0
    cuts = sorted(set(deciles))
    place = sum((F.when(F.col("v") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    bins = {r.k: (r.a, r.b) for r in counts.groupBy(place.alias("k")).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()}
    psi = 0.0
    for i in range(len(cuts) + 1):
        fa, fb = (max(v / n, 1e-6) for v, n in zip(bins.get(i, (0, 0)), (m.n, k.n)))
        psi += (fb - fa) * math.log(fb / fa)
    return one_row(a, ks=float(ks), p=p_value, psi=psi, wasserstein=float(within + between), mean_shift=k.m - m.m, sd_shift=k.s - m.s, drifted=bool(p_value < alpha or psi > psi_limit))


# story findings


def trend(df: DataFrame, date: str, value: str) -> DataFrame:
    """(period, n, total, mean, r): by year, month or day as the span asks; r is the correlation of the total with the period's number."""
    span = df.agg(F.datediff(F.max(date), F.min(date)).alias("d")).first().d or 0
    grain = "year" if span > 1100 else "month" if span > 120 else "day"
    g = df.groupBy(F.date_trunc(grain, date).cast("date").alias("period")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean")).where("n >= 5")
    number = F.datediff("period", F.lit("1970-01-01").cast("date"))
    r = g.agg(F.round(F.corr(number.cast("double"), "total"), 6).alias("r"))
    return g.crossJoin(F.broadcast(r)).select("period", "n", F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"), "r")


def trend_findings(df: DataFrame, date: str, value: str, group: str, top: int = 5, alpha: float = 0.05, least: float = 0.5) -> DataFrame:
    """(group, grain, periods, r, p, found) of the whole table (a null group) and of its ``top`` groups by total.

    Periods have five rows or more; from three of them on r is the correlation of their totals with their numbers and p its two-sided t test.  A
    trend is found in five periods or more where p is below ``alpha`` and |r| at least ``least``.  Rows without a group count for the whole only."""
    span = df.where(F.col(value).isNotNull()).agg(F.datediff(F.max(date), F.min(date)).alias("d")).first().d or 0
    grain = "year" if span > 1100 else "month" if span > 120 else "day"
    cells = df.where(F.col(date).isNotNull() & F.col(value).isNotNull()).groupBy(F.date_trunc(grain, date).cast("date").alias("period"), F.col(group).alias("_g"))
    cells = stored(cells.agg(F.count("*").alias("n"), F.sum(value).cast("double").alias("total")), "trend-cells")
    leaders = cells.where("_g is not null").groupBy("_g").agg(F.sum("total").alias("t")).orderBy(F.desc("t"), "_g").limit(top).select("_g")
    whole = cells.groupBy("period").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).select("period", F.lit(None).cast(cells.schema["_g"].dataType).alias("_g"), "n", "total")
    series = whole.unionByName(cells.join(F.broadcast(leaders), "_g").select("period", "_g", "n", "total")).where("n >= 5")
    number = F.datediff("period", F.lit("1970-01-01").cast("date")).cast("double")
    rows = []
    for x in series.groupBy("_g").agg(F.count("*").alias("k"), F.corr(number, "total").alias("r")).collect():  # top + 1 rows
        r = None if x.r is None or x.k < 3 or math.isnan(x.r) else max(-1.0, min(1.0, x.r))
        p = None if r is None else 0.0 if abs(r) == 1 else tails.t_tail(abs(r) * math.sqrt((x.k - 2) / (1 - r * r)), x.k - 2)
        rows.append((x["_g"], grain, x.k, r, p, bool(p is not None and x.k >= 5 and p < alpha and abs(r) >= least)))
    kind = cells.schema["_g"].dataType.simpleString()
    return df.sparkSession.createDataFrame(rows, f"`{group}` {kind}, grain string, periods long, r double, p double, found boolean")


def group_gap(df: DataFrame, group: str, value: str) -> DataFrame:
    """Best against worst group by mean: Welch's p and the relative gap."""
    g = moments(df, value, group).where("n >= 5")
    best, worst = g.orderBy(F.desc("mean"), group).first(), g.orderBy("mean", group).first()
    t, _, p = welch(best, worst)
    gap = (best.mean - worst.mean) / abs(worst.mean) if worst.mean else math.inf
    return one_row(df, best=str(best[group]), worst=str(worst[group]), t=t, p=p, gap=gap, found=bool(p < 0.05 and gap >= 0.1))


def outlier_share(df: DataFrame, column: str) -> DataFrame:
    a, b = quantiles(df, {"v": column}, [0.25, 0.75])["v"]
    lo, hi = (F.lit(a - 1.5 * (b - a)), F.lit(b + 1.5 * (b - a))) if a is not None else (F.lit(None), F.lit(None))
    r = df.select(column).agg(F.count(column).alias("n"), F.count_if((F.col(column) < lo) | (F.col(column) > hi)).alias("outliers"))
    share = F.col("outliers") / F.col("n")
    return r.select("n", "outliers", F.round(share, 6).alias("share"), ((F.col("n") >= 20) & (share > 0) & (share <= 0.1)).alias("found"))


def concentration(df: DataFrame, group: str, value: str, top: int = 12) -> DataFrame:
    """Share of the first and of the first three of the ``top`` groups in the total."""
    g = df.groupBy(group).agg(F.sum(value).alias("s"))
    total = g.agg(F.sum("s").alias("t"))
    first = g.orderBy(F.desc("s"), group).limit(top).withColumn("i", F.row_number().over(Window.orderBy(F.desc("s"), group)))
    r = first.crossJoin(F.broadcast(total)).agg(F.round(F.sum(F.when(F.col("i") == 1, F.col("s") / F.col("t"))), 6).alias("top1"), F.round(F.sum(F.when(F.col("i") <= 3, F.col("s") / F.col("t"))), 6).alias("top3"))
    return r.withColumn("found", (F.col("top1") >= 0.4) | (F.col("top3") >= 0.6))


def change(df: DataFrame, date: str, value: str) -> DataFrame:
    """Before and after the median time: Welch's test and the relative gap."""
    t = F.unix_micros(F.col(date).cast("timestamp"))
    cut = quantiles(df, {"t": t}, [0.5])["t"][0]
    m = moments(df.withColumn("late", t > F.lit(cut)), value, "late")
    before, after = m.orderBy("late").collect()
    t_, _, p = welch(after, before)
    gap = (after.mean - before.mean) / abs(before.mean) if before.mean else math.inf
    return one_row(df, before=before.mean, after=after.mean, t=t_, p=p, gap=gap, found=bool(p < 0.05 and abs(gap) >= 0.1))


# least squares


def design(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    cols = [F.col(c).cast("double").alias(c) for c in (y, *xs)]
    out = df.select(*cols, *[c for c in df.columns if c not in (y, *xs)])
    return out.where(" and ".join(f"`{c}` is not null" for c in (y, *xs)))


def _gram(df: DataFrame, y: str, xs: list[str], weight: Column | None = None) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(X'X, X'y, y'y, n) with an intercept, in one aggregation."""
    terms: list[Column] = [F.lit(1.0), *[F.col(x) for x in xs]]
    w = weight if weight is not None else F.lit(1.0)
    k = len(terms)
    made = [F.sum(w * terms[i] * terms[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    made += [F.sum(w * terms[i] * F.col(y)).alias(f"b{i}") for i in range(k)]
    r = df.agg(*made, F.sum(w * F.col(y) ** 2).alias("yy"), F.count("*").alias("n")).first()
    gram = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    return gram, np.array([r[f"b{i}"] for i in range(k)]), r.yy, r.n


def fitted(beta: np.ndarray, xs: list[str]) -> Column:
    return sum((float(b) * F.col(x) for b, x in zip(beta[1:], xs)), F.lit(float(beta[0])))


def ols(df: DataFrame, y: str, xs: list[str], cov: str = "classical", groups: str | None = None, order_by: list[str] | None = None, lags: int = 1) -> DataFrame:
    """(term, beta, se, t, p): classical, HC3, cluster or HAC standard errors.  X'X is one aggregation, robust
    errors a second one over the rows; nothing row-wise leaves the executors."""
    src = design(df, y, xs)
    gram, b, yy, n = _gram(src, y, xs)
    k = len(xs) + 1
    inv = np.linalg.inv(gram)
    beta = inv @ b
    rows = src.withColumn("_e", F.col(y) - fitted(beta, xs))
    terms = [F.lit(1.0), *[F.col(x) for x in xs]]
    dof = n - k
    if cov == "classical":
        v = inv * max(yy - beta @ b, 0.0) / dof
    else:
        if cov == "HC3":
            lever = sum((float(inv[i, j]) * terms[i] * terms[j] for i in range(k) for j in range(k)), F.lit(0.0))
            s = [F.col("_e") / (1 - lever) * t for t in terms]
            pairs = {(i, j): F.sum(s[i] * s[j]) for i in range(k) for j in range(i, k)}
            scale, base = 1.0, rows
        elif cov == "cluster":
            base = rows.groupBy(groups).agg(*[F.sum(F.col("_e") * terms[i]).alias(f"_s{i}") for i in range(k)])
            pairs = {(i, j): F.sum(F.col(f"_s{i}") * F.col(f"_s{j}")) for i in range(k) for j in range(i, k)}
            g = base.count()
            scale, dof = g / (g - 1) * (n - 1) / (n - k), g - 1
        elif cov == "HAC":
            w = Window.partitionBy(*([groups] if groups else [])).orderBy(*order_by)
            base = rows.select(*[(F.col("_e") * terms[i]).alias(f"_s{i}") for i in range(k)], *order_by, *([groups] if groups else []))
            base = base.withColumns({f"_l{q}_{i}": F.lag(f"_s{i}", q).over(w) for q in range(1, lags + 1) for i in range(k)})
            pairs = {}
            for i in range(k):
                for j in range(i, k):
                    total = F.sum(F.col(f"_s{i}") * F.col(f"_s{j}"))
                    for q in range(1, lags + 1):
                        total = total + (1 - q / (lags + 1)) * F.coalesce(F.sum(F.col(f"_s{i}") * F.col(f"_l{q}_{j}") + F.col(f"_l{q}_{i}") * F.col(f"_s{j}")), F.lit(0.0))
                    pairs[i, j] = total
            scale = n / (n - k)
        else:
            raise ValueError(f"unknown covariance {cov}")
        m = base.agg(*[c.alias(f"m{i}_{j}") for (i, j), c in pairs.items()]).first()
        meat = np.array([[m[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        v = scale * inv @ meat @ inv
    se = np.sqrt(np.maximum(np.diag(v), 0))
    out = [(name, float(x), float(s), float(x / s) if s else math.nan, tails.t_tail(float(x / s), dof) if s else math.nan) for name, x, s in zip(["intercept", *xs], beta, se)]
    return df.sparkSession.createDataFrame(out, "term string, beta double, se double, t double, p double")


def residual_checks(df: DataFrame, column: str, order_by: list[str], lags: int = 3, group: str | None = None) -> DataFrame:
    """(lag, acf, ljung_box, p, durbin_watson) of a series, or pooled over series by group."""
    w = Window.partitionBy(*([group] if group else [])).orderBy(*order_by)
    mean = df.agg(F.avg(column).alias("_m"))
    d = df.crossJoin(F.broadcast(mean)).withColumn("_d", F.col(column) - F.col("_m"))
    d = d.withColumns({f"_l{q}": F.lag("_d", q).over(w) for q in range(1, lags + 1)})
    r = d.agg(F.sum(F.col("_d") ** 2).alias("s"), F.count("_d").alias("n"), F.sum((F.col("_d") - F.col("_l1")) ** 2).alias("dw"), *[F.sum(F.col("_d") * F.col(f"_l{q}")).alias(f"c{q}") for q in range(1, lags + 1)]).first()
    out, box = [], 0.0
    for q in range(1, lags + 1):
        acf = r[f"c{q}"] / r.s
        box += acf * acf / (r.n - q)
        stat = r.n * (r.n + 2) * box
        out.append((q, acf, stat, tails.chi2_tail(stat, q), r.dw / r.s))
    return df.sparkSession.createDataFrame(out, "lag int, acf double, ljung_box double, p double, durbin_watson double")


def did(df: DataFrame, y: str, treated: str, after: str, cluster: str | None = None) -> DataFrame:
    """2 x 2 difference in differences with covariates left to ``ols``: the interaction, its error and the four cell means."""
    src = df.withColumns({"_t": F.col(treated).cast("double"), "_a": F.col(after).cast("double")}).withColumn("_ta", F.col("_t") * F.col("_a"))
    fit = ols(src, y, ["_t", "_a", "_ta"], "cluster" if cluster else "HC3", cluster).where("term = '_ta'").select("beta", "se", "p")
    cells = src.groupBy("_t", "_a").agg(F.avg(y).alias("m")).agg(*[F.max(F.when((F.col("_t") == t) & (F.col("_a") == a), F.col("m"))).alias(f"mean_{t}{a}") for t in (0, 1) for a in (0, 1)])
    return fit.crossJoin(cells)


def balance(df: DataFrame, treated: str, columns: list[str]) -> DataFrame:
    """(column, smd): standardised mean differences of the treated and the others."""
    made = []
    for c in columns:
        for s in (0, 1):
            v = F.when(F.col(treated).cast("int") == s, F.col(c).cast("double"))
            made += [F.avg(v).alias(f"{c}_m{s}"), F.var_samp(v).alias(f"{c}_v{s}")]
    one = df.agg(*made)
    rows = [F.struct(F.lit(c).alias("column"), F.round((F.col(f"{c}_m1") - F.col(f"{c}_m0")) / F.sqrt((F.col(f"{c}_v1") + F.col(f"{c}_v0")) / 2), 6).alias("smd")) for c in columns]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def permuted_effects(df: DataFrame, y: str, treated: str, key: str, k: int = 50) -> DataFrame:
    """(replicate, effect): differences of means under k seeded reassignments, all in one aggregation."""
    share = df.agg(F.avg(F.col(treated).cast("double")).alias("_p"))
    coin = lambda i: F.pmod(F.xxhash64(key, F.lit(i)), F.lit(1_000_000)) / 1e6 < F.col("_p")
    made = [(F.avg(F.when(coin(i), F.col(y))) - F.avg(F.when(~coin(i), F.col(y)))).alias(f"e{i}") for i in range(k)]
    one = df.crossJoin(F.broadcast(share)).agg(*made)
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("replicate"), F.col(f"e{i}").alias("effect")) for i in range(k)])).alias("r")).select("r.*")


def factorial_effects(df: DataFrame, factors: list[str], y: str) -> DataFrame:
    """(term, effect): main effects and two-factor interactions of factors coded -1 and 1."""
    terms = {f: F.col(f) for f in factors} | {f"{a}:{b}": F.col(a) * F.col(b) for i, a in enumerate(factors) for b in factors[i + 1 :]}
    one = df.agg(*[(F.avg(F.when(c > 0, F.col(y))) - F.avg(F.when(c < 0, F.col(y)))).alias(n) for n, c in terms.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("term"), F.round(F.col(f"`{n}`"), 6).alias("effect")) for n in terms])).alias("r")).select("r.*")
