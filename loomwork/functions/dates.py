"""Calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _months(start: str, end: str) -> Column:
    """Whole calendar months from start to end; the end of a month clamps."""
    apart = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    return F.when(F.add_months(start, apart) > F.col(end), apart - 1).otherwise(apart).cast("long")


def diff(start: str, end: str) -> list[Column]:
    days = F.datediff(end, start).cast("long")
    months = _months(start, end)
    return [days.alias("days"), F.floor(days / 7).alias("weeks"), months.alias("months"), F.floor(months / 12).alias("years")]


def add(start: str, days: int = 0, weeks: int = 0, months: int = 0, years: int = 0) -> Column:
    """Months first (the end of a month clamps), then days."""
    return F.date_add(F.add_months(start, months + 12 * years), days + 7 * weeks)


def weekday(d: str) -> list[Column]:
    iso = F.weekday(d) + 1
    return [iso.alias("iso_weekday"), (iso >= 6).alias("weekend"), F.extract(F.lit("YEAROFWEEK"), F.col(d)).alias("iso_year"), F.weekofyear(d).alias("iso_week")]


def age(birth: str, on: str) -> list[Column]:
    months = _months(birth, on)
    return [F.floor(months / 12).alias("years"), (months % 12).alias("months"), F.datediff(on, birth).cast("long").alias("total_days")]


#: (month, day) of the holidays that every year has.
FIXED_HOLIDAYS = ((1, 1), (12, 25))


def business_calendar(spark, first: str, last: str, holidays=FIXED_HOLIDAYS) -> DataFrame:
    """(day, n): running number of business days up to and with each day."""
    days = spark.sql(f"SELECT explode(sequence(date'{first}', date'{last}')) AS day")
    off = F.weekday("day") >= 5
    for m, d in holidays:
        off = off | ((F.month("day") == m) & (F.dayofmonth("day") == d))
    running = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.select("day", F.sum(F.when(off, 0).otherwise(1)).over(running).alias("n"), (~off).cast("int").alias("open"))


def business_days(df: DataFrame, start: str, end: str, holidays=FIXED_HOLIDAYS) -> DataFrame:
    """Business days from start to end, both counted, swapped when reversed: two equi-joins with a calendar
    of the days between the table's first and last date."""
    ends = df.agg(F.min(F.least(start, end)).alias("lo"), F.max(F.greatest(start, end)).alias("hi")).first()
    if ends.lo is None:
        return df.withColumn("business_days", F.lit(None).cast("long"))
    cal = business_calendar(df.sparkSession, str(ends.lo), str(ends.hi), holidays)
    a = cal.select(F.col("day").alias("_a"), F.col("n").alias("_na"), F.col("open").alias("_oa"))
    b = cal.select(F.col("day").alias("_b"), F.col("n").alias("_nb"))
    out = df.join(F.broadcast(a), F.least(start, end) == F.col("_a"), "left").join(F.broadcast(b), F.greatest(start, end) == F.col("_b"), "left")
    return out.withColumn("business_days", F.col("_nb") - F.col("_na") + F.col("_oa")).drop("_a", "_na", "_oa", "_b", "_nb")
