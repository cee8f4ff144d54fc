"""Quality rules: each gives the failing rows, or a scalar test; a suite fuses the row-local rules into one scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fails(rule: dict) -> Column | None:
    """Predicate of a row-local rule's failing rows; null passes all but not_null."""
    kind = rule["kind"]
    if kind == "not_null":
        return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in rule["columns"]])
    c = F.col(rule["column"]) if "column" in rule else None
    if kind == "accepted_values":
        bad = ~c.isin(rule["values"])
    elif kind == "range":
        lo, hi = rule.get("min"), rule.get("max")
        bad = (c < lo if lo is not None else F.lit(False)) | (c > hi if hi is not None else F.lit(False))
    elif kind == "regex":
        bad = ~c.cast("string").rlike(f"^(?:{rule['pattern']})$")
    else:
        return None
    return F.coalesce(bad, F.lit(False))


def failing_rows(df: DataFrame, rule: dict, refs: dict[str, DataFrame] | None = None) -> DataFrame:
    kind = rule["kind"]
    bad = fails(rule)
    if bad is not None:
        return df.where(bad)
    if kind == "unique":
        keys = rule["columns"]
        some = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        twice = df.where(some).groupBy(*keys).count().where("count > 1").drop("count")
        return df.join(twice, keys, "left_semi")
    if kind == "referential":
        ref = refs[rule["ref_table"]].select(F.col(rule["ref_column"]).alias("_ref"))
        return df.where(F.col(rule["column"]).isNotNull()).join(ref, F.col(rule["column"]) == F.col("_ref"), "left_anti")
    if kind == "custom_sql":
        return df.sparkSession.sql(rule["sql"], t=df)
    raise ValueError(f"no failing rows for {kind}")


def unique_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Duplicate groups, extra copies, and rows that stay after dedupe; null keys count as a group here."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.agg(F.count_if(F.col("n") > 1).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"), F.count("*").alias("after"))


def scalar_rule(df: DataFrame, rule: dict, today: str | None = None) -> DataFrame:
    """(checked, failed) of row_count and freshness; an empty table is not fresh."""
    if rule["kind"] == "row_count":
        n = F.count("*")
        lo, hi = rule.get("min"), rule.get("max")
        ok = (n >= lo if lo is not None else F.lit(True)) & (n <= hi if hi is not None else F.lit(True))
        return df.agg(n.alias("checked"), F.when(ok, 0).otherwise(1).cast("long").alias("failed"))
    now = F.to_date(F.lit(today)) if today else F.current_date()
    days = F.datediff(now, F.max(rule["column"]))
    return df.agg(F.count("*").alias("checked"), F.when(days <= rule["max_age_days"], 0).otherwise(1).cast("long").alias("failed"))


ROW_LOCAL = ("not_null", "accepted_values", "range", "regex")


def run_suite(df: DataFrame, rules: dict[str, dict], refs: dict[str, DataFrame] | None = None, today: str | None = None) -> DataFrame:
    """(rule, checked, failed, passed) of every rule; row-local rules share one scan."""
    local = {n: r for n, r in rules.items() if r["kind"] in ROW_LOCAL}
    parts = []
    if local:
        one = df.agg(F.count("*").alias("_n"), *[F.count_if(fails(r)).alias(n) for n, r in local.items()])
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("failed")) for n in local]))
        parts.append(one.select("_n", pairs.alias("r")).select("r.rule", F.col("_n").alias("checked"), "r.failed"))
    for name, rule in rules.items():
        if rule["kind"] in ("row_count", "freshness"):
            parts.append(scalar_rule(df, rule, today).select(F.lit(name).alias("rule"), "checked", "failed"))
        elif name not in local:
            failed = failing_rows(df, rule, refs).agg(F.count("*").alias("failed"))
            parts.append(df.agg(F.count("*").alias("checked")).crossJoin(failed).select(F.lit(name).alias("rule"), "checked", "failed"))
    return reduce(DataFrame.unionByName, parts).withColumn("passed", F.col("failed") == 0)
