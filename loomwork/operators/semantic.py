"""Semantic layer: named metrics and dimensions over a table, with period offsets."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAINS = ("day", "week", "month", "quarter", "year")


@dataclass(frozen=True)
class Model:
    """Expressions by name; a metric is an aggregate expression or (metric, offset)."""

    dimensions: dict[str, str]
    metrics: dict[str, str | tuple[str, str]]
    time_dimension: str | None = None
    filters: tuple = field(default=())


def months_of(offset: str) -> tuple[int, int]:
    """(months, days) of an offset such as ``-1 month``."""
    m = re.fullmatch(r"([+-]?\d+) (day|week|month|quarter|year)s?", offset)
    if not m:
        raise ValueError(f"bad offset {offset!r}; such as '-1 month'")
    n = int(m[1])
    return {"month": (n, 0), "quarter": (3 * n, 0), "year": (12 * n, 0), "day": (0, n), "week": (0, 7 * n)}[m[2]]


def shift(c: Column, offset: str, sign: int = 1) -> Column:
    months, days = months_of(offset)
    return F.date_add(F.add_months(c, sign * months), sign * days)


def predicate(model: Model, f: dict) -> Column | None:
    """eq, in, between, gte, lte, contains; an empty value or ``all`` is no filter."""
    value, op = f.get("value"), f["op"]
    if value in (None, "", [], "all"):
        return None
    c = F.expr(model.dimensions[f["dim"]])
    made = {
        "eq": lambda: c == value, "in": lambda: c.isin(value), "between": lambda: c.between(*value), "gte": lambda: c >= value, "lte": lambda: c <= value,
        "contains": lambda: c.cast("string").ilike(f"%{value}%"),
    }
    return made[op]()


def query(df: DataFrame, model: Model, metrics: list[str], dimensions: list[str] = (), filters: list[dict] = (), order: list[str] = (), limit: int | None = None, grain: str | None = None) -> DataFrame:
    """Metrics by dimensions; the time dimension is truncated to ``grain``.

    An offset metric beside the time dimension is the value of the shifted period (a left join on all dimensions; the filter
    is not shifted, so the first period inside one has none); without it the values of the time filter are shifted."""
    plain = {m: model.metrics[m] for m in metrics if isinstance(model.metrics[m], str)}
    offset = {m: model.metrics[m] for m in metrics if not isinstance(model.metrics[m], str)}

    def dim(name: str) -> Column:
        c = F.expr(model.dimensions[name])
        return F.date_trunc(grain, c).cast("date").alias(name) if grain and name == model.time_dimension else c.alias(name)

    def grouped(wanted: dict[str, str], where: list[dict]) -> DataFrame:
        found = [p for p in (predicate(model, f) for f in where) if p is not None]
        src = df.where(reduce(lambda a, b: a & b, found)) if found else df
        return src.groupBy(*[dim(d) for d in dimensions]).agg(*[F.expr(x).alias(n) for n, x in wanted.items()])

    base = plain or {"_rows": "count(*)"}
    out = grouped(base, list(filters))
    for name, (of, by) in offset.items():
        if model.time_dimension in dimensions:
            prev = grouped({name: model.metrics[of]}, list(filters)).withColumn(model.time_dimension, shift(F.col(model.time_dimension), by, -1))
            cond = [F.col(f"a.{d}").eqNullSafe(F.col(f"b.{d}")) for d in dimensions]
            out = out.alias("a").join(prev.alias("b"), cond, "left").select("a.*", f"b.{name}")
        else:
            moved = [{**f, "value": shifted_value(f, by)} if f["dim"] == model.time_dimension else f for f in filters]
            prev = grouped({name: model.metrics[of]}, moved)
            out = out.join(prev, list(dimensions), "left") if dimensions else out.crossJoin(prev)
    out = out.select(*dimensions, *metrics)
    if order:
        out = out.orderBy(*[F.desc_nulls_last(o[1:]) if o.startswith("-") else F.asc_nulls_last(o) for o in order])
    return out.limit(limit) if limit is not None else out


def shifted_value(f: dict, by: str):
    values = f["value"] if isinstance(f["value"], (list, tuple)) else [f["value"]]
    made = [shift(F.to_date(F.lit(str(v))), by) for v in values]
    return made if isinstance(f["value"], (list, tuple)) else made[0]


def delta(df: DataFrame, value: str, compare: str) -> DataFrame:
    """Percent change beside a metric and its comparison; none where that is 0."""
    return df.withColumn("delta_percent", F.when(F.col(compare) != 0, 100 * (F.col(value) - F.col(compare)) / F.col(compare)))


def top_loop(df: DataFrame, model: Model, dimension: str, by: str, n: int, metrics: list[str], inner: str) -> DataFrame:
    """For the top n values of a dimension: metrics by a second dimension, all in one grouped query."""
    top = query(df, model, [by], [dimension], order=[f"-{by}", dimension], limit=n).select(F.col(dimension).alias("_top"))
    kept = df.join(F.broadcast(top), F.expr(model.dimensions[dimension]) == F.col("_top"), "left_semi")
    return query(kept, model, metrics, [dimension, inner])


def options(df: DataFrame, model: Model, dimension: str) -> DataFrame:
    c = F.expr(model.dimensions[dimension]).alias("value")
    return df.select(c).where("value is not null").distinct().orderBy("value")


def validate(df: DataFrame, model: Model) -> list[str]:
    """What is wrong with a model over a table; no job runs."""
    wrong = []
    for kind, names in (("dimension", model.dimensions), ("metric", {n: x for n, x in model.metrics.items() if isinstance(x, str)})):
        for name, expr in names.items():
            try:
                (df.agg(F.expr(expr)) if kind == "metric" else df.select(F.expr(expr))).schema
            except Exception as e:  # analysis errors of any kind are the finding
                wrong.append(f"{kind} {name}: {str(e).splitlines()[0]}")
    for name, x in model.metrics.items():
        if not isinstance(x, str):
            if x[0] == name or x[0] not in model.metrics:
                wrong.append(f"metric {name}: refers to {x[0]}")
            try:
                months_of(x[1])
            except ValueError as e:
                wrong.append(f"metric {name}: {e}")
    return wrong
