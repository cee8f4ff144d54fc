"""The tables behind charts, frequencies, pages and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGGS = {"sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max, "median": F.median}


def _value(y: str | None, agg: str) -> Column:
    return F.count("*") if y is None else AGGS[agg](y)


def _where(df: DataFrame, filter: str | None) -> DataFrame:
    return df.where(F.expr(filter)) if filter else df


def match_rate(left: DataFrame, right: DataFrame, on: list[dict]) -> DataFrame:
    """Left rows, those with a match, and their share."""
    keys = right.select(*[F.col(p["right"]).alias(f"_k{i}") for i, p in enumerate(on)], F.lit(True).alias("_m")).distinct()
    cond = [F.col(p["left"]) == F.col(f"_k{i}") for i, p in enumerate(on)]
    both = left.join(keys, cond, "left").agg(F.count("*").alias("rows"), F.count("_m").alias("matched"))
    return both.withColumn("rate", F.round(F.try_divide("matched", "rows"), 4))


def frequencies(df: DataFrame, column: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """Counts with nulls and percent; most frequent first, nulls last among equals."""
    total = df.agg(F.count("*").alias("_n"))
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    page_ = counts.orderBy(F.desc("n"), F.asc_nulls_last("value")).offset(offset).limit(limit)
    return page_.crossJoin(F.broadcast(total)).select("value", "n", F.round(100.0 * F.col("n") / F.col("_n"), 4).alias("percent"))


def top_values(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(n)


def histogram(df: DataFrame, x: str, bins: int = 20, filter: str | None = None) -> DataFrame:
    src = _where(df, filter).where(F.col(x).isNotNull()).select(F.col(x).alias("x"))
    ends = src.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    place = F.floor(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")) * bins)
    return src.crossJoin(F.broadcast(ends)).groupBy(F.least(F.lit(bins - 1).cast("long"), place).alias("bin")).agg(F.count("*").alias("n"))


def box(df: DataFrame, y: str, x: str | None = None, filter: str | None = None) -> DataFrame:
    """Least, quartiles and greatest, per group if one is given."""
    q = F.percentile(y, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    keys = [F.col(x).alias("x")] if x else []
    made = _where(df, filter).groupBy(*keys).agg(F.min(y).alias("low"), q.alias("q"), F.max(y).alias("high"))
    parts = [F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("q1", "median", "q3"))]
    return made.select(*(["x"] if x else []), "low", *parts, "high")


def series(df: DataFrame, x: str, y: str | None = None, agg: str = "sum", color: str | None = None, filter: str | None = None) -> DataFrame:
    keys = [F.col(x).alias("x"), *([F.col(color).alias("color")] if color else [])]
    return _where(df, filter).groupBy(*keys).agg(F.round(_value(y, agg), 4).alias("y")).orderBy("x")


def heatmap(df: DataFrame, x: str, y: str, color: str | None = None, agg: str = "sum") -> DataFrame:
    return df.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(_value(color, agg).alias("value"))


def top_share(df: DataFrame, x: str, y: str | None = None, agg: str = "sum", n: int = 20) -> DataFrame:
    counts = df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("x")).agg(_value(y, agg).cast("double").alias("y"))
    return counts.orderBy(F.desc("y"), "x").limit(n)


def pareto(df: DataFrame, x: str, y: str | None = None, agg: str = "sum", n: int = 20) -> DataFrame:
    """The top categories with their cumulative percent of the top's total."""
    w = Window.orderBy(F.desc("y"), "x")
    share = 100 * F.sum("y").over(w) / F.sum("y").over(Window.partitionBy())
    return top_share(df, x, y, agg, n).withColumn("cumulative", F.round(share, 4))


def kpi(df: DataFrame, expr: str) -> DataFrame:
    return df.agg(F.expr(expr).alias("value"))


def scatter(df: DataFrame, x: str, y: str, color: str | None = None, limit: int = 5000) -> DataFrame:
    """At most ``limit`` points, those with the least row hash: the same at every run."""
    cols = [x, y, *([color] if color else [])]
    return df.select(*cols).orderBy(F.xxhash64(*cols), *cols).limit(limit)


def page(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page and one row more, by which the caller sees whether there are further ones."""
    return df.offset(offset).limit(limit + 1)


def compare_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset difference both ways over the columns of one name and type."""
    shared = [c for c, t in a.dtypes if (c, t) in b.dtypes]
    a, b = a.select(*shared), b.select(*shared)
    only_a = a.exceptAll(b).select(F.lit("only_a").alias("side"), "*")
    return only_a.unionByName(b.exceptAll(a).select(F.lit("only_b").alias("side"), "*"))
