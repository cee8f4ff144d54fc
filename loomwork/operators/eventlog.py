"""Event logs: parsing, exclusions, duplicates, lifecycle pairing, order and case status.

A log is a DataFrame (case, activity, end, start, resource, cost, row_id); start, resource and cost may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import quantiles


def parse_timestamp(raw: Column, zone: str = "UTC") -> Column:
    """struct(ts UTC, problem): ISO (with or without offset) or day-first text in the declared zone.

    problem: missing, unparseable or nonexistent (a local time that the zone skipped); of an
    ambiguous local time the first occurrence is taken."""
    s = F.trim(raw)
    has_offset = s.rlike(r"(Z|[+-]\d\d:?\d\d)$") & s.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d")
    absolute = F.coalesce(*[F.try_to_timestamp(F.replace(s, F.lit("T"), F.lit(" ")), F.lit(p)) for p in ("yyyy-MM-dd HH:mm:ss[.SSSSSS]XXX", "yyyy-MM-dd HH:mmXXX")])
    # local times are read as if in UTC (the session's zone), then moved
    patterns = ("yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "dd-MM-yyyy HH:mm", "dd.MM.yyyy HH:mm")
    plain = F.replace(s, F.lit("T"), F.lit(" "))
    local = F.coalesce(*[F.try_to_timestamp(plain, F.lit(p)) for p in patterns])
    moved = F.to_utc_timestamp(local, zone)
    skipped = F.from_utc_timestamp(moved, zone) != local
    ts = F.when(has_offset, absolute).when(~skipped, moved)
    problem = (
        F.when(raw.isNull() | (s == ""), "missing").when(has_offset & absolute.isNotNull(), None)
        .when(local.isNull(), "unparseable").when(skipped, "nonexistent")
    )
    return F.struct(ts.alias("ts"), problem.alias("problem"))


def exclusions(df: DataFrame, lifecycle: bool = False) -> DataFrame:
    """``df`` (case, activity, end[, start_raw, lifecycle]) with ``reason``: the first that holds, else null."""
    reason = F.when(F.col("case").isNull() | (F.trim(F.col("case").cast("string")) == ""), "missing_case")
    reason = reason.when(F.col("activity").isNull() | (F.trim("activity") == ""), "missing_activity").when(F.col("end").isNull(), "invalid_timestamp")
    if "start" in df.columns:
        reason = reason.when(F.col("start") > F.col("end"), "invalid_start")
    if lifecycle:
        reason = reason.when(~F.lower("lifecycle").isin("start", "complete"), "unknown_lifecycle")
    return df.withColumn("reason", reason)


def dedupe(log: DataFrame, keys: list[str]) -> DataFrame:
    """Exact duplicates keep the first row by row_id."""
    w = Window.partitionBy(*keys).orderBy("row_id")
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def pair(log: DataFrame) -> DataFrame:
    """(case, activity, start, end, resource, matched): lifecycle starts and completes of each case and activity.

    A complete takes the oldest open start of its resource, else the oldest open one.  A complete without a
    start and a start without a complete come out unmatched."""
    event = F.struct("ts", "row_id", F.lower("lifecycle").alias("kind"), "resource")
    groups = log.groupBy("case", "activity").agg(F.array_sort(F.collect_list(event)).alias("ev"))
    empty = F.struct(
        F.array().cast("array<struct<ts:timestamp_ntz,resource:string>>").alias("open"),
        F.array().cast("array<struct<start:timestamp_ntz,end:timestamp_ntz,resource:string>>").alias("done"),
    )

    def step(acc: Column, e: Column) -> Column:
        opened = acc["open"]
        same = F.array_position(F.transform(opened, lambda o: o["resource"].eqNullSafe(e["resource"])), True)
        at = F.when(same > 0, same).otherwise(F.lit(1).cast("long"))
        taken = F.get(opened, (at - 1).cast("int"))
        rest = F.filter(opened, lambda o, i: i != (at - 1).cast("int"))
        finished = F.struct(F.when(F.size(opened) > 0, taken["ts"]).alias("start"), e["ts"].alias("end"), e["resource"].alias("resource"))
        return F.when(
            e["kind"] == "start",
            F.struct(F.concat(opened, F.array(F.struct(e["ts"].alias("ts"), e["resource"].alias("resource")))).alias("open"), acc["done"].alias("done")),
        ).otherwise(F.struct(rest.alias("open"), F.concat(acc["done"], F.array(finished)).alias("done")))

    unmatched = lambda a: F.transform(a["open"], lambda o: F.struct(o["ts"].alias("start"), F.lit(None).cast("timestamp_ntz").alias("end"), o["resource"].alias("resource")))
    folded = groups.select("case", "activity", F.aggregate("ev", empty, step, lambda a: F.concat(a["done"], unmatched(a))).alias("p"))
    out = folded.select("case", "activity", F.explode("p").alias("i")).select("case", "activity", "i.*")
    return out.withColumn("matched", F.col("start").isNotNull() & F.col("end").isNotNull())


def ordered(log: DataFrame) -> DataFrame:
    """With ``pos`` (by end, then row_id) and ``tied`` (another event of the case has the same end)."""
    w = Window.partitionBy("case").orderBy("end", "row_id")
    return log.withColumn("pos", F.row_number().over(w)).withColumn("tied", F.count("*").over(Window.partitionBy("case", "end")) > 1)


def status(log: DataFrame, end_activities: list[str]) -> DataFrame:
    """(case, last_activity, closed)."""
    last = log.groupBy("case").agg(F.max_by("activity", F.struct("end", "row_id")).alias("last_activity"))
    return last.withColumn("closed", F.col("last_activity").isin(end_activities))


def missing(log: DataFrame, end_activities: list[str], expected: list[str]) -> DataFrame:
    """(case, activity): expected activities that a closed case lacks."""
    closed = status(log, end_activities).where("closed").select("case")
    wanted = closed.select("case", F.explode(F.array(*[F.lit(a) for a in expected])).alias("activity"))
    return wanted.join(log.select("case", "activity").distinct(), ["case", "activity"], "left_anti")


def zones(raw: DataFrame, column: str) -> DataFrame:
    """(case, offsets): cases whose written offset changes; times without one say nothing."""
    offset = F.nullif(F.regexp_extract(column, r"(Z|\d[+-]\d\d:?\d\d)$", 1), F.lit(""))
    offset = F.regexp_replace(offset, r"^\d", "")
    seen = raw.groupBy("case").agg(F.array_sort(F.collect_set(offset)).alias("offsets"))
    return seen.where(F.size("offsets") > 1)


def split_cases(log: DataFrame, holdout: float = 0.3) -> DataFrame:
    """(case, start, part): train or holdout by the case's start; the cut is the start at 1 - holdout of the cases."""
    cases = log.groupBy("case").agg(F.min(F.coalesce("start", "end")).alias("start"))
    micros = F.unix_micros(F.col("start").cast("timestamp"))
    cut = quantiles(cases, {"t": micros}, [1 - holdout])["t"][0]
    return cases.select("case", "start", F.when(micros >= F.lit(cut), "holdout").otherwise("train").alias("part"))
