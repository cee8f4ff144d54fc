"""Reconcile two tables by key: every row of both falls into exactly one bucket, every compared cell into one category."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def key(cols: list[str], trim: bool = True, lower: bool = True, numeric: bool = False, empty_missing: bool = True) -> Column:
    """Composite key text; null if any part is missing."""
    parts = []
    for c in cols:
        v = F.col(c).cast("string")
        v = F.trim(v) if trim else v
        v = F.lower(v) if lower else v
        v = v.try_cast("double").cast("string") if numeric else v
        parts.append(F.nullif(v, F.lit("")) if empty_missing else v)
    missing = reduce(lambda a, b: a | b, [p.isNull() for p in parts])
    return F.when(~missing, F.concat_ws("\x1f", *parts))


def statuses(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column) -> tuple[DataFrame, DataFrame]:
    """Both tables with ``_key`` and ``_status``: paired, only_left or only_right, ambiguous, missing_key."""
    a, b = left.withColumn("_key", left_key), right.withColumn("_key", right_key)
    na = a.where("_key is not null").groupBy("_key").agg(F.count("*").alias("_na"))
    nb = b.where("_key is not null").groupBy("_key").agg(F.count("*").alias("_nb"))
    counts = na.join(nb, "_key", "full")

    def marked(df: DataFrame, alone: str) -> DataFrame:
        status = F.when(F.col("_key").isNull(), "missing_key").when(F.col("_na").isNull() | F.col("_nb").isNull(), alone)
        status = status.when((F.col("_na") > 1) | (F.col("_nb") > 1), "ambiguous").otherwise("paired")
        return df.join(counts, "_key", "left").withColumn("_status", status).drop("_na", "_nb")

    return marked(a, "only_left"), marked(b, "only_right")


def category(a: Column, b: Column, tolerance: float = 0.0, numeric: bool = False) -> Column:
    """Category of a pair of cells, in this order.  Texts are compared as they are; as numbers too if ``numeric`` (a side is a
    number column), within the tolerance if it is so or a tolerance is given."""
    ta, tb = a.cast("string"), b.cast("string")
    na, nb = ta.try_cast("double"), tb.try_cast("double")
    none_a, none_b = a.isNull(), b.isNull()
    zero = (none_a & (nb == 0)) | (none_b & (na == 0))
    empty = (none_a & (tb == "")) | (none_b & (ta == ""))
    out = F.when(none_a & none_b, "both_missing").when(zero, "zero_vs_missing").when(empty, "empty_vs_missing")
    out = out.when(none_b, "only_left_value").when(none_a, "only_right_value").when(ta == tb, "equal")
    out = out.when(na == nb, "equal") if numeric else out
    out = out.when(F.abs(na - nb) <= tolerance, "equal_within_tolerance") if numeric or tolerance else out
    return out.otherwise("different")


def cells(left: DataFrame, right: DataFrame, compare: list[tuple[str, str]], tolerance: float = 0.0) -> DataFrame:
    """(field, category, n) over the paired rows of two tables with statuses, all fields in one pass."""
    a = left.where("_status = 'paired'").select("_key", *[F.col(x).alias(f"_l{i}") for i, (x, _) in enumerate(compare)])
    b = right.where("_status = 'paired'").select("_key", *[F.col(y).alias(f"_r{i}") for i, (_, y) in enumerate(compare)])
    number = [any(isinstance(t, T.NumericType) for t in (left.schema[x].dataType, right.schema[y].dataType)) for x, y in compare]
    rows = [F.struct(F.lit(x).alias("field"), category(F.col(f"_l{i}"), F.col(f"_r{i}"), tolerance, number[i]).alias("category")) for i, (x, _) in enumerate(compare)]
    return a.join(b, "_key").select(F.explode(F.array(*rows)).alias("c")).groupBy("c.field", "c.category").agg(F.count("*").alias("n"))


def bucket_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    def of(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(F.col("_status").alias("status")).agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "status", "n")

    return of(left, "left").unionByName(of(right, "right"))


def rows_table(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """(key, left_id, right_id, status): pairs once, every other row of both sides by itself."""
    a = left.select("_key", F.col(left_id).alias("left_id"), "_status")
    b = right.select("_key", F.col(right_id).alias("right_id"), "_status")
    paired = a.where("_status = 'paired'").join(b.where("_status = 'paired'").drop("_status"), "_key")
    none = F.lit(None).cast("long")
    rest = a.where("_status <> 'paired'").withColumn("right_id", none)
    rest_b = b.where("_status <> 'paired'").withColumn("left_id", none)
    cols = [F.col("_key").alias("key"), "left_id", "right_id", F.col("_status").alias("status")]
    return paired.select(cols).unionByName(rest.select(cols)).unionByName(rest_b.select(cols))


def profile(df: DataFrame) -> DataFrame:
    """(column, rows, missing, empty, zeros, distinct, is_unique) in one scan."""
    made = []
    for c in df.columns:
        text = F.trim(F.col(c).cast("string"))
        made.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(F.col(c).isNull()).alias("missing"), F.count_if(text == "").alias("empty"),
                             F.count_if(text.try_cast("double") == 0).alias("zeros"), F.countDistinct(c).alias("distinct")))
    out = df.agg(F.array(*made).alias("a")).select(F.explode("a").alias("r")).select("r.*")
    return out.withColumn("is_unique", (F.col("distinct") == F.col("rows") - F.col("missing")) & (F.col("rows") > 0))


def suggest(left: DataFrame, right: DataFrame, top: int = 3) -> DataFrame:
    """(left, right, score) candidates of matching columns: 0.4 name likeness, 0.5 containment of values, 0.1 same family."""

    def melted(df: DataFrame, name: str) -> DataFrame:
        pairs = [F.struct(F.lit(c).alias(name), F.lower(F.trim(F.col(c).cast("string"))).alias("v")) for c in df.columns]
        return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("v is not null and v <> ''").distinct()

    import difflib

    a, b = melted(left, "l"), melted(right, "r")
    size = a.groupBy("l").agg(F.count("*").alias("n"))
    common = a.join(b, "v").groupBy("l", "r").agg(F.count("*").alias("k"))
    family = lambda t: "number" if t in ("int", "bigint", "double", "float", "smallint") or t.startswith("decimal") else t
    lt, rt = dict(left.dtypes), dict(right.dtypes)
    names = [(x, y, difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio(), float(family(lt[x]) == family(rt[y]))) for x in left.columns for y in right.columns]
    table = left.sparkSession.createDataFrame(names, "l string, r string, name double, same double")
    scored = F.broadcast(table).join(common, ["l", "r"], "left").join(size, "l", "left")
    inside = F.coalesce(F.col("k") / F.col("n"), F.lit(0.0))
    out = scored.select(F.col("l").alias("left"), F.col("r").alias("right"), F.round(0.4 * F.col("name") + 0.5 * inside + 0.1 * F.col("same"), 4).alias("score"), F.round(inside, 4).alias("containment"))
    from pyspark.sql import Window

    w = Window.partitionBy("left").orderBy(F.desc("score"), "right")
    return out.where("score >= 0.25").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r")
