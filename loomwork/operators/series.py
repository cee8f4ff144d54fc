"""Series: gaps, smoothing, curve figures and bias, longest regular run, imputation previews, regressions in time."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tails
from ..tables import broadcast_if_small, stored
from .stats import design, fitted, ols
from .steps import StepError, forward_fill

#: A step longer than so many median steps is a gap.
GAP = 2.5
#: Points at which two curves are compared.
GRID = 50


def _ordered(group: list[str], x: str) -> Window:
    """The rows of a series in order; a series is one group, so it needs a key to be split over tasks."""
    if not group:
        raise StepError("a series needs a group column")
    return Window.partitionBy(*group).orderBy(x)


def _steps(df: DataFrame, group: list[str], x: str) -> DataFrame:
    """Rows with the number ``_x``, the step from the row before and the group's median step."""
    number = F.col(x).cast("double") if dict(df.dtypes)[x] not in ("timestamp", "timestamp_ntz", "date") else F.unix_micros(F.col(x).cast("timestamp")) / 1e6
    rows = df.where(F.col(x).isNotNull()).withColumn("_x", number)
    rows = rows.withColumn("_step", F.col("_x") - F.lag("_x").over(_ordered(group, "_x")))
    middle = rows.groupBy(*group).agg(F.median("_step").alias("_median"))
    return rows.join(broadcast_if_small(stored(middle, "series-steps")), group)


def gaps(df: DataFrame, group: list[str], x: str, factor: float = GAP) -> DataFrame:
    """(group, x_before, x_after, size) of the steps of more than ``factor`` median steps."""
    far = F.col("_step") > factor * F.col("_median")
    return _steps(df, group, x).where(far & (F.col("_median") > 0)).select(*group, (F.col("_x") - F.col("_step")).alias("x_before"), F.col("_x").alias("x_after"), F.col("_step").alias("size"))


def smooth(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Rows with ``smooth``, the centred mean over max(3, n // 20) rows of the group, fewer at its ends.

    The width differs from group to group, so the means are differences of running sums at two places."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    w = _ordered(group, x)
    rows = rows.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(*group)))
    rows = rows.withColumn("_sum", F.sum(F.col(y).cast("double")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = stored(rows.withColumn("_w", F.greatest(F.lit(3), F.floor(F.col("_n") / 20)).cast("int")), "series-sums")
    rows = rows.withColumn("_from", F.col("_i") - F.floor(F.col("_w") / 2) - 1).withColumn("_to", F.least(F.col("_n"), F.col("_i") + F.floor((F.col("_w") - 1) / 2)))
    at = rows.select(*group, "_i", "_sum")
    low = at.withColumnsRenamed({"_i": "_from", "_sum": "_low"})
    high = at.withColumnsRenamed({"_i": "_to", "_sum": "_high"})
    out = rows.join(low, [*group, "_from"], "left").join(high, [*group, "_to"])
    mean = (F.col("_high") - F.coalesce("_low", F.lit(0.0))) / (F.col("_to") - F.greatest(F.col("_from"), F.lit(0)))
    return out.select(*df.columns, mean.alias("smooth"))


def curves(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """(group, n, gaps, noise_ratio, growth_mean, growth_median, growth_std) of each series: noise is what smoothing leaves."""
    rows = smooth(df.select(*group, x, y), group, x, y)
    before = F.lag(y).over(_ordered(group, x))
    rows = rows.withColumn("_growth", F.try_divide(F.col(y) - before, before))
    one = rows.groupBy(*group).agg(
        F.count("*").alias("n"), (F.stddev_pop(F.col(y) - F.col("smooth")) / F.coalesce(F.nullif(F.stddev_pop(y), F.lit(0.0)), F.lit(1.0))).alias("noise_ratio"),
        F.avg("_growth").alias("growth_mean"), F.median("_growth").alias("growth_median"), F.stddev_pop("_growth").alias("growth_std"),
    )
    many = gaps(df.where(F.col(y).isNotNull()).select(*group, x), group, x).groupBy(*group).agg(F.count("*").alias("gaps"))
    return one.join(many, group, "left").withColumn("gaps", F.coalesce("gaps", F.lit(0)))


def curve_bias(df: DataFrame, group: str, x: str, y: str, a: str, b: str) -> DataFrame:
    """(mean_bias, std_bias, max_abs_bias) of curve ``b`` less curve ``a`` at GRID even places of their common range,
    by linear interpolation: for each place the nearest point on either side, from one aggregation."""
    rows = df.where(F.col(group).isin(a, b) & F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(group).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ends = rows.groupBy("g").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    grid = ends.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))).alias("i")).where("hi > lo")
    grid = grid.select("i", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (GRID - 1)).alias("at"))
    point = F.struct("x", "y")
    sides = rows.crossJoin(F.broadcast(grid)).groupBy("g", "i", "at").agg(
        F.max(F.when(F.col("x") <= F.col("at"), point)).alias("p"), F.min(F.when(F.col("x") >= F.col("at"), point)).alias("q")
    )
    p, q = F.coalesce("p", "q"), F.coalesce("q", "p")
    between = F.when(q["x"] == p["x"], p["y"]).otherwise(p["y"] + (q["y"] - p["y"]) * (F.col("at") - p["x"]) / (q["x"] - p["x"]))
    both = sides.select("g", "i", between.alias("v")).groupBy("i").agg((F.max(F.when(F.col("g") == b, F.col("v"))) - F.max(F.when(F.col("g") == a, F.col("v")))).alias("d"))
    return both.agg(F.avg("d").alias("mean_bias"), F.stddev_pop("d").alias("std_bias"), F.max(F.abs("d")).alias("max_abs_bias"))


def longest_run(df: DataFrame, group: list[str], x: str, values: list[str]) -> DataFrame:
    """(group, start, end, n) of the longest stretch of rows whose values are there and whose steps are 0.5 to 1.5 times the
    median positive step of the rows with values; the first of equally long ones."""
    good = F.lit(True)
    for v in values:
        good = good & F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double"))
    rows = df.where(F.col(x).isNotNull()).withColumn("_x", F.col(x).cast("double")).withColumn("_good", good)
    step = F.col("_x") - F.lag("_x").over(_ordered(group, "_x"))
    usual = rows.where("_good").withColumn("_step", step).where("_step > 0").groupBy(*group).agg(F.median("_step").alias("_dt"))
    rows = rows.join(broadcast_if_small(stored(usual, "series-usual")), group)
    w = _ordered(group, "_x")
    linked = F.col("_good") & F.lag("_good", 1, False).over(w) & (step > 0.5 * F.col("_dt")) & (step < 1.5 * F.col("_dt"))
    rows = rows.withColumn("_break", (~linked).cast("int")).withColumn("_island", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.where("_good").groupBy(*group, "_island").agg(F.min("_x").alias("start"), F.max("_x").alias("end"), F.count("*").alias("n")).where("n > 1")
    best = F.max(F.struct("n", (-F.col("start")).alias("s"), "start", "end")).alias("b")
    return runs.groupBy(*group).agg(best).select(*group, "b.start", "b.end", "b.n")


def imputation_preview(df: DataFrame, column: str, strategy: str = "mean", value=None, order_by: list[str] | None = None) -> DataFrame:
    """(stage, n, missing, mean, std, min, max) of a column before and after its nulls are filled: mean, median, mode, constant, or
    forward (then backward at the start) in ``order_by``."""
    c = F.col(column)
    if strategy == "forward":
        done = forward_fill(df.select(column, *(order_by or [])), column, order_by or [], [])
        first = done.where(c.isNotNull()).agg(F.min_by(c, F.struct(*order_by)).alias("_fill"))
        after = done.crossJoin(F.broadcast(first)).select(F.coalesce(c, F.col("_fill")).alias(column))
    else:
        made = {"mean": F.avg(c), "median": F.median(c), "mode": F.mode(c, True), "constant": F.first(F.lit(value))}
        if strategy not in made:
            raise StepError(f"unknown strategy {strategy}")
        if strategy == "constant" and value is None:
            raise StepError("a constant needs a value")
        fill = df.agg(made[strategy].alias("_fill"))
        after = df.select(column).crossJoin(F.broadcast(fill)).select(F.coalesce(c, F.col("_fill")).alias(column))

    def stats(rows: DataFrame, stage: str) -> DataFrame:
        v = F.col(column).cast("double")
        return rows.agg(F.count(v).alias("n"), F.count_if(F.col(column).isNull()).alias("missing"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")).select(F.lit(stage).alias("stage"), "*")

    return stats(df.select(column), "before").unionByName(stats(after, "after"))


def lagged(df: DataFrame, group: list[str], x: str, outputs: list[str], inputs: list[str], p: int, s: int) -> tuple[DataFrame, list[str]]:
    """Rows with p lags of the outputs and, from lag s on, of the inputs; rows without all of them go."""
    w, names, made = _ordered(group, x), [], {}
    for k in range(1, p + 1):
        for o in outputs:
            made[f"{o}_lag{k}"] = F.lag(o, k).over(w)
    for m in range(p):
        for i in inputs:
            made[f"{i}_lag{s + m}"] = F.lag(i, s + m).over(w) if s + m else F.col(i)
    names = list(made)
    return df.withColumns(made).where(" and ".join(f"`{n}` is not null" for n in names)), names


def arx(df: DataFrame, group: list[str], x: str, outputs: list[str], inputs: list[str], p: int = 1, s: int = 1) -> DataFrame:
    """(output, term, beta, se, t, p): each output regressed on its and the others' lags and on lagged inputs, pooled over the groups."""
    rows, names = lagged(df, group, x, outputs, inputs, p, s)
    rows = stored(rows, "series-lags")
    if rows.count() < 4 * (len(names) + 1):
        raise StepError("too few rows for so many lags")
    out = None
    for o in outputs:
        one = ols(rows, o, names).select(F.lit(o).alias("output"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def prais_winsten(df: DataFrame, y: str, xs: list[str], group: list[str], order_by: str, iters: int = 15) -> DataFrame:
    """(term, beta, se, t, p, rho): least squares with AR(1) errors.  Each turn is two aggregations; the first row of a series is weighted
    by sqrt(1 - rho^2), the others are differences to rho times the row before."""
    src = stored(design(df, y, xs), "series-design")
    w = _ordered(group, order_by)
    src = stored(src.withColumns({f"_p_{c}": F.lag(c).over(w) for c in (y, *xs)}), "series-before")

    def gram(rho: float) -> tuple[np.ndarray, np.ndarray, float, int]:
        first, weight = F.col(f"_p_{y}").isNull(), float(np.sqrt(1 - rho * rho))
        turn = lambda now, then: F.when(first, weight * now).otherwise(now - rho * then)
        terms = [turn(F.lit(1.0), F.lit(1.0)), *[turn(F.col(c), F.col(f"_p_{c}")) for c in xs]]
        target, k = turn(F.col(y), F.col(f"_p_{y}")), len(xs) + 1
        made = [F.sum(terms[i] * terms[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(terms[i] * target).alias(f"b{i}") for i in range(k)]
        r = src.agg(*made, F.sum(target**2).alias("yy"), F.count("*").alias("n")).first()
        return np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]), np.array([r[f"b{i}"] for i in range(k)]), r.yy, r.n

    g, b, yy, n = gram(0.0)
    beta, rho = np.linalg.solve(g, b), 0.0
    for _ in range(iters):
        e = F.col(y) - fitted(beta, xs)
        before = F.col(f"_p_{y}") - fitted(beta, [f"_p_{c}" for c in xs])
        r = src.agg(F.sum(e * before).alias("a"), F.sum(before**2).alias("d")).first()
        new = max(min(r.a / r.d if r.d else 0.0, 0.98), -0.98)
        g, b, yy, n = gram(new)
        beta, moved, rho = np.linalg.solve(g, b), abs(new - rho), new
        if moved < 1e-6:
            break
    dof = n - len(beta) - 1
    se = np.sqrt(np.maximum(np.diag(np.linalg.inv(g)) * max(yy - beta @ b, 0.0) / dof, 0.0))
    rows = [(t, float(v), float(s), float(v / s) if s else None, tails.t_tail(float(v / s), dof) if s else None, rho) for t, v, s in zip(["intercept", *xs], beta, se)]
    return df.sparkSession.createDataFrame(rows, "term string, beta double, se double, t double, p double, rho double")


def interrupted(df: DataFrame, y: str, time: str, at: float, group: list[str], errors: str = "ar1", lags: int = 1) -> DataFrame:
    """Interrupted time series: level and slope change at ``at`` beside the trend before it; AR(1) errors, or HAC ones of ``lags``."""
    t = F.col(time).cast("double")
    after = (t >= at).cast("double")
    rows = df.withColumns({"time": t, "level": after, "slope": after * (t - at)})
    xs = ["time", "level", "slope"]
    if errors == "ar1":
        return prais_winsten(rows, y, xs, group, "time")
    return ols(rows, y, xs, "HAC", group[0] if group else None, ["time"], lags)


def ranked_findings(found: DataFrame, limit: int = 8) -> DataFrame:
    """(kind, key, strength, rank) of findings (kind, key, p, size): strength is -log10 p plus the absolute size up to 1; the
    strongest of each kind and key, the ``limit`` strongest of those."""
    strength = -F.log10(F.greatest(F.col("p"), F.lit(1e-300))) + F.least(F.abs("size"), F.lit(1.0))
    best = found.groupBy("kind", "key").agg(F.max(strength).alias("strength"))
    top = best.orderBy(F.desc("strength"), "kind", "key").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("strength"), "kind", "key")))


#: Parts of column names that speak for a role; a name is cut at case changes, digits and signs.
NAME_PARTS = {
    "case": {"case", "order", "ticket", "session", "visit", "journey"},
    "activity": {"activity", "event", "step", "action", "type"},
    "timestamp": {"timestamp", "time", "ts", "at", "finished", "completed"},
    "start": {"started", "start", "begin", "opened"},
    "resource": {"worker", "user", "agent", "clerk", "team"},
    "cost": {"cost", "price", "amount", "fee"},
}
#: Share of the values that must be times for a text column to count as one.
TIMES = 0.95


def name_parts(name: str) -> set[str]:
    return {p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", name)}


def suggest_mapping(df: DataFrame) -> DataFrame:
    """(role, column, score): which columns may be the case, activity, time, start, resource and cost of an event log.

    Half of a score is evidence from the values, half whether a part of the name speaks for the role.  With spread = ln(distinct) / ln(rows),
    0 for a constant and 1 for a key: a case repeats, but has many values (4 spread (1 - spread)); activities are few (1 - spread); resources
    lie between (1 - |2 spread - 0.6|); a time is the share of values that are times; a start is the share of rows in which it is not after another time of the
    row; a cost is the share of numbers that are not negative.  All counts come from one aggregation over all rows."""
    kinds = dict(df.dtypes)
    number = {c for c, k in kinds.items() if k.startswith("decimal") or k in ("tinyint", "smallint", "int", "bigint", "float", "double")}
    flat = [c for c, k in kinds.items() if not k.startswith(("array", "map", "struct"))]
    time = {c: F.col(c).try_cast("timestamp") for c in flat if c not in number and kinds[c] != "boolean"}
    made: list[Column] = [F.count("*").alias("n")]
    for i, c in enumerate(flat):
        made += [F.count(c).alias(f"k{i}"), F.approx_count_distinct(c, 0.02).alias(f"d{i}")]
        made.append((F.count_if(F.col(c) >= 0) if c in number else F.count(time[c]) if c in time else F.lit(0)).alias(f"v{i}"))
        for j, other in enumerate(flat):
            if i != j and c in time and other in time:
                made.append(F.count_if(time[c] <= time[other]).alias(f"b{i}_{j}"))
    one = df.agg(*made).first()
    n, rows = one["n"], []
    share = {c: one[f"v{i}"] / one[f"k{i}"] if one[f"k{i}"] else 0.0 for i, c in enumerate(flat)}
    times = [i for i, c in enumerate(flat) if c in time and share[c] >= TIMES]
    for i, c in enumerate(flat):
        d = min(one[f"d{i}"], n)
        spread = math.log(d) / math.log(n) if n > 1 and d > 0 else 0.0
        label = i not in times and 1 < d < n
        evidence = {
            "case": 4 * spread * (1 - spread) if label else None,
            "activity": 1 - spread if label and c not in number else None,
            "resource": max(0.0, 1 - abs(2 * spread - 0.6)) if label and c not in number else None,
            "timestamp": share[c] if i in times else None,
            "start": max(one[f"b{i}_{j}"] for j in times if j != i) / n if i in times and len(times) > 1 else None,
            "cost": share[c] if c in number and one[f"k{i}"] else None,
        }
        parts = name_parts(c)
        rows += [(role, c, round(0.5 * e + 0.5 * bool(parts & NAME_PARTS[role]), 3)) for role, e in evidence.items() if e is not None]
    return df.sparkSession.createDataFrame(rows, "role string, column string, score double")
