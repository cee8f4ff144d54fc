"""Profiles of tables: one aggregation for all columns, one for quartiles, one for fences."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranks import mid_ranks, quantiles


def column_roles(schema: T.StructType) -> dict[str, str]:
    """numeric, temporal or categorical."""
    out = {}
    for f in schema.fields:
        if isinstance(f.dataType, T.NumericType):
            out[f.name] = "numeric"
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out[f.name] = "temporal"
        else:
            out[f.name] = "categorical"
    return out


def _stack(one: DataFrame, columns: list[str], fields: list[str]) -> DataFrame:
    """One row with <column>__<field> columns -> one row per column."""
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}__{f}`").alias(f) for f in fields]) for c in columns]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def null_profile(df: DataFrame) -> DataFrame:
    """(column, rows, nulls, null_percent, distinct approximately) in one scan."""
    made = []
    for c in df.columns:
        made += [F.count("*").alias(f"{c}__rows"), F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"), F.approx_count_distinct(c).alias(f"{c}__distinct")]
    out = _stack(df.agg(*made), df.columns, ["rows", "nulls", "distinct"])
    return out.withColumn("null_percent", F.round(100 * F.try_divide("nulls", "rows"), 4))


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, low, high, mean, sd, median, q1, q3, outliers): three scans whatever the number of columns."""
    made, quarters = [], quantiles(df, {c: c for c in columns}, [0.25, 0.5, 0.75])
    for c in columns:
        v = F.col(c).cast("double")
        q = F.array(*[F.lit(x).cast("double") for x in quarters[c]])
        made += [F.min(v).alias(f"{c}__low"), F.max(v).alias(f"{c}__high"), F.avg(v).alias(f"{c}__mean"), F.stddev_samp(v).alias(f"{c}__sd"), q.alias(f"{c}__q")]
    stats = df.agg(*made)
    out = _stack(stats, columns, ["low", "high", "mean", "sd", "q"])
    beyond = []
    for c in columns:
        q1, q3 = F.col(f"`{c}__q`")[0], F.col(f"`{c}__q`")[2]
        beyond.append(F.count_if((F.col(c) < q1 - 1.5 * (q3 - q1)) | (F.col(c) > q3 + 1.5 * (q3 - q1))).alias(f"{c}__outliers"))
    outliers = _stack(df.select(*columns).crossJoin(F.broadcast(stats.select(*[f"`{c}__q`" for c in columns]))).agg(*beyond), columns, ["outliers"])
    out = out.join(F.broadcast(outliers), "column")
    return out.select(
        "column", "low", "high", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), F.round(F.col("q")[1], 4).alias("median"),
        F.round(F.col("q")[0], 4).alias("q1"), F.round(F.col("q")[2], 4).alias("q3"), "outliers",
    )


def temporal_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, low, high, days): ends of each date or time column and the days between them, in one scan."""
    columns = columns or [c for c, r in column_roles(df.schema).items() if r == "temporal"]
    made = []
    for c in columns:
        v = F.col(c).cast("timestamp_ntz")
        made += [F.min(v).alias(f"{c}__low"), F.max(v).alias(f"{c}__high")]
    return _stack(df.agg(*made), columns, ["low", "high"]).withColumn("days", F.datediff("high", "low"))


def text_profile(df: DataFrame, columns: list[str], top: int = 5) -> DataFrame:
    """(column, value, n, rank): the most frequent values of each text column; ties by value.  One count of (column, value) pairs serves all columns, and the
    first ones are picked per partition before any column comes together."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    counts = df.select(cells.alias("x")).where("x.value is not null").groupBy("x.column", "x.value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def rank_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r): Spearman's coefficient of every pair, over the rows that are whole; ranks come from counts along range partitions."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).where(" and ".join(f"`{c}` is not null" for c in columns))
    for c in columns:
        rows = mid_ranks(rows, c, "_r").drop(c).withColumnRenamed("_r", c)
    return correlation(rows, columns)


def top_pairs(pairs: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` pairs of a correlation table that go together most, either way."""
    return pairs.where(F.col("r").isNotNull() & ~F.isnan("r")).orderBy(F.desc(F.abs("r")), "a", "b").limit(k)


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of every pair, in one scan; pairs drop rows with a null on either side."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.corr(F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double"))).alias(f"{a}__{b}") for a, b in pairs])
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"`{a}__{b}`"), 6).alias("r")) for a, b in pairs]
    return one.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def compare_profiles(a: DataFrame, b: DataFrame) -> DataFrame:
    """(column, status, null_delta) of two versions: added, removed, type_changed or shared."""

    def described(df: DataFrame, side: str) -> DataFrame:
        types = dict(df.dtypes)
        rows = null_profile(df).select("column", F.col("nulls").alias(f"nulls_{side}"))
        kinds = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.lit(types[c]))])
        return rows.withColumn(f"type_{side}", kinds[F.col("column")])

    both = described(a, "a").join(described(b, "b"), "column", "full")
    status = F.when(F.col("type_a").isNull(), "added").when(F.col("type_b").isNull(), "removed")
    status = status.when(F.col("type_a") != F.col("type_b"), "type_changed").otherwise("shared")
    return both.select("column", status.alias("status"), (F.col("nulls_b") - F.col("nulls_a")).alias("null_delta"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-independent print of a table: rows and the sum of row hashes."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("print"))


def suggest_semantics(df: DataFrame, max_values: int = 50) -> dict:
    """A first semantic model: months of the first temporal column, sum and mean of numbers, few-valued text as dimensions."""
    roles = column_roles(df.schema)
    few = {r["column"] for r in null_profile(df).where(F.col("distinct") <= max_values).collect()}
    time = next((c for c, r in roles.items() if r == "temporal"), None)
    metrics = {f"{fn}_{c}": f"{fn}(`{c}`)" for c, r in roles.items() if r == "numeric" for fn in ("sum", "avg")}
    return {"time_dimension": time, "dimensions": {c: f"`{c}`" for c, r in roles.items() if r == "categorical" and c in few}, "metrics": metrics}


# exploration


def null_patterns(df: DataFrame, columns: list[str], least: float = 0.05) -> DataFrame:
    """(a, b, r) of the null indicators that go together."""
    marks = df.select(*[F.col(c).isNull().cast("int").alias(c) for c in columns])
    return correlation(marks, columns).where(F.abs("r") > least)


def outliers_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, iqr_outliers, z_outliers, low_whisker, high_whisker): three scans."""
    made, quarters = [], quantiles(df, {c: c for c in columns}, [0.25, 0.75])
    for c in columns:
        made += [F.array(*[F.lit(x).cast("double") for x in quarters[c]]).alias(f"{c}__q"), F.avg(c).alias(f"{c}__m"), F.stddev_samp(c).alias(f"{c}__s")]
    stats = df.agg(*made)
    second = []
    for c in columns:
        q = F.col(f"`{c}__q`")
        lo, hi = q[0] - 1.5 * (q[1] - q[0]), q[1] + 1.5 * (q[1] - q[0])
        inside = (F.col(c) >= lo) & (F.col(c) <= hi)
        z = F.abs(F.try_divide(F.col(c) - F.col(f"`{c}__m`"), F.col(f"`{c}__s`")))
        second += [
            F.count_if(~inside).alias(f"{c}__iqr_outliers"), F.count_if(z > 3).alias(f"{c}__z_outliers"),
            F.min(F.when(inside, F.col(c).cast("double"))).alias(f"{c}__low_whisker"), F.max(F.when(inside, F.col(c).cast("double"))).alias(f"{c}__high_whisker"),
        ]
    return _stack(df.select(*columns).crossJoin(F.broadcast(stats)).agg(*second), columns, ["iqr_outliers", "z_outliers", "low_whisker", "high_whisker"])


def encoding_suggestions(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, suggestion) by skew and cardinality."""
    roles, made = column_roles(df.schema), [F.count("*").alias("_n")]
    for c in columns:
        number = roles[c] == "numeric"
        made += [F.countDistinct(c).alias(f"{c}__d"), (F.skewness(c) if number else F.lit(None).cast("double")).alias(f"{c}__k")]
        made.append((F.min(c).cast("double") if number else F.lit(None).cast("double")).alias(f"{c}__lo"))
    one, rows = df.agg(*made), []
    for c in columns:
        d, k, lo = (F.col(f"`{c}__{x}`") for x in ("d", "k", "lo"))
        if roles[c] == "numeric":
            what = F.when(F.abs(k) < 0.5, "standard").when(F.abs(k) < 1, "minmax").when(lo > 0, "log").otherwise("yeo_johnson")
        else:
            what = F.when((d > 30) & (d > 0.05 * F.col("_n")), "id_like").when(d <= 12, "one_hot").otherwise("target_or_frequency")
        rows.append(F.struct(F.lit(c).alias("column"), d.alias("distinct"), what.alias("suggestion")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# Texts that stand for a missing value.
PLACEHOLDERS = ["null", "n/a", "na", "none", "unknown", "unk", "?", "-", "--", "missing", "#n/a", "nan"]


def quality_score(df: DataFrame) -> DataFrame:
    """Validity: share of texts that are no placeholder; outliers: a quarter of outliers on average counts 0.

    0 to 100: completeness .30, uniqueness .20, validity .20, outliers .15, constants .15; at most 99 unless all are perfect."""
    numbers = [c for c, r in column_roles(df.schema).items() if r == "numeric"]
    cells = [F.count("*").alias("n")]
    for c in df.columns:
        cells += [F.count(c).alias(f"{c}__k"), (F.min(c) == F.max(c)).alias(f"{c}__one")]
    texts = [c for c, k in column_roles(df.schema).items() if k == "categorical"]
    for c in texts:
        cells.append(F.count_if(F.lower(F.trim(F.col(c).cast("string"))).isin("", *PLACEHOLDERS)).alias(f"{c}__bad"))
    one = df.agg(*cells)
    rows = df.distinct().agg(F.count("*").alias("unique_rows"))
    out = one.crossJoin(F.broadcast(rows))
    if numbers:
        seen = df.agg(*[F.count(c).alias(c) for c in numbers]).unpivot([], numbers, "column", "seen")
        report = outliers_report(df, numbers).join(seen, "column").where("seen >= 4")
        report = report.agg(F.coalesce(F.avg(F.col("iqr_outliers") / F.col("seen")), F.lit(0.0)).alias("out"))
        out = out.crossJoin(F.broadcast(report))
    else:
        out = out.withColumn("out", F.lit(0))
    n, width = F.col("n"), len(df.columns)
    add = lambda xs: reduce(lambda a, b: a + b, xs, F.lit(0))
    complete = add([F.col(f"`{c}__k`") for c in df.columns]) / (n * width)
    valid = 1 - add([F.col(f"`{c}__bad`") for c in texts]) / F.greatest(F.lit(1), add([F.col(f"`{c}__k`") for c in texts]))
    inside = 1 - F.least(F.lit(1.0), 4 * F.col("out"))
    varied = 1 - add([F.coalesce(F.col(f"`{c}__one`"), F.lit(True)).cast("int") for c in df.columns]) / width
    unique = F.col("unique_rows") / n
    score = 100 * (0.3 * complete + 0.2 * unique + 0.2 * valid + 0.15 * inside + 0.15 * varied)
    perfect = (complete == 1) & (unique == 1) & (valid == 1) & (inside == 1) & (varied == 1)
    parts = [F.round(x, 6).alias(name) for x, name in ((complete, "completeness"), (unique, "uniqueness"), (valid, "validity"), (inside, "outliers"), (varied, "constants"))]
    return out.select(*parts, F.round(F.when(perfect, score).otherwise(F.least(F.lit(99.0), score)), 4).alias("score"))
