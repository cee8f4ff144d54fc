"""The step catalogue: pure functions ``(DataFrame, params) -> DataFrame``, with a checked parameter contract.

Steps that depend on row order (forward fill, windows) take an explicit order, for a distributed table has none.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_accents, title_case
from ..tables import stored


class StepError(ValueError):
    """A step's parameters don't fit its contract or the table."""


def need_columns(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        close = {n: difflib.get_close_matches(n, df.columns, 1) for n in missing}
        raise StepError(f"unknown columns {missing}; close: {close}; there are {df.columns}")


def filter_rows(df: DataFrame, expr: str) -> DataFrame:
    """Rows for which the predicate holds; null drops the row."""
    return df.where(F.expr(expr))


def select(df: DataFrame, columns: list[str]) -> DataFrame:
    need_columns(df, columns)
    return df.select(*columns)


def drop(df: DataFrame, columns: list[str]) -> DataFrame:
    need_columns(df, columns)
    if not set(df.columns) - set(columns):
        raise StepError("a table needs a column")
    return df.drop(*columns)


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    need_columns(df, list(mapping))
    after = [mapping.get(c, c) for c in df.columns]
    if len(set(after)) < len(after):
        raise StepError("two columns would have one name")
    return df.withColumnsRenamed(mapping)


#: Types that a column can be cast to.
CAST_TO = {
    "integer": "bigint", "double": "double", "decimal": "decimal(18,4)", "text": "string", "date": "date", "timestamp": "timestamp_ntz",
    "boolean": "boolean", "smallint": "int",
}
#: strptime directives and their pattern letters.
STRPTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%f": "SSSSSS", "%b": "MMM", "%B": "MMMM", "%p": "a", "%I": "hh"}


def java_pattern(fmt: str) -> str:
    """The date pattern of a strptime format; other letters are quoted."""
    out, i = "", 0
    while i < len(fmt):
        two = fmt[i : i + 2]
        if two in STRPTIME:
            out, i = out + STRPTIME[two], i + 2
        else:
            out, i = out + (f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i]), i + 1
    return out


def cast(df: DataFrame, column: str, to: str, spanish_number: bool = False, date_format: str | None = None) -> DataFrame:
    """Cast; what cannot be cast becomes null.  On the way to an integer doubles round halves to even, decimals and text away from zero;
    text of digits alone is read exactly."""
    need_columns(df, [column])
    if to not in CAST_TO:
        raise StepError(f"cannot cast to {to}; one of {sorted(CAST_TO)}")
    c: Column = F.col(column)
    kind = dict(df.dtypes)[column]
    if spanish_number:
        c, kind = F.replace(F.replace(F.trim(c), F.lit("."), F.lit("")), F.lit(","), F.lit(".")), "string"
    if date_format:
        c = F.try_to_timestamp(c, F.lit(java_pattern(date_format)))
    elif to == "integer" and kind == "string":
        whole = F.when(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(c).try_cast("bigint"))
        c = F.coalesce(whole, F.round(c.try_cast("double"), 0).try_cast("bigint"))
    elif to == "integer" and kind in ("double", "float"):
        c = F.bround(c, 0)
    elif to == "integer" and kind.startswith("decimal"):
        c = F.round(c, 0)
    return df.withColumn(column, c.try_cast(CAST_TO[to]))


def fill_null(df: DataFrame, column: str, strategy: str = "value", value=None, order_by: list[str] | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Replace nulls by a value, by a statistic of the whole column, or by the last value before (``forward``)."""
    need_columns(df, [column])
    if strategy == "value":
        return df.withColumn(column, F.coalesce(F.col(column), F.lit(value)))
    if strategy == "forward":
        return forward_fill(df, column, order_by or [], partition_by or [])
    stat = {"mean": F.avg(column), "mode": F.mode(column, True)}
    if strategy not in (*stat, "median"):
        raise StepError(f"unknown strategy {strategy}")
    if strategy == "median":
        from .ranks import quantiles

        return df.withColumn(column, F.coalesce(F.col(column), F.lit(quantiles(df, {"v": column}, [0.5])["v"][0])))
    one = df.agg(stat[strategy].alias("_fill"))
    return df.crossJoin(F.broadcast(one)).withColumn(column, F.coalesce(F.col(column), F.col("_fill"))).drop("_fill")


def forward_fill(df: DataFrame, column: str, order_by: list[str], partition_by: list[str]) -> DataFrame:
    """Last non-null value at or before the row in the given order.

    Without a partition the table is range-partitioned: each range is filled on its own, and the last value of the
    ranges before (one row per range) is joined to what is left."""
    if not order_by:
        raise StepError("forward fill needs an order")
    order = [F.col(c).asc_nulls_last() for c in order_by]
    if partition_by:
        w = Window.partitionBy(*partition_by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(column, F.last(column, True).over(w))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "forward-fill")
    key = F.struct(*[F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")) for c in order_by])
    last = ranged.where(F.col(column).isNotNull()).groupBy("_range").agg(F.max_by(F.col(column), key).alias("_v"))
    ranges = df.sparkSession.range(n).select(F.col("id").cast("int").alias("_range"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = ranges.join(last, "_range", "left").select("_range", F.last("_v", True).over(before).alias("_carry"))
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = ranged.withColumn(column, F.last(column, True).over(w)).join(F.broadcast(carry), "_range", "left")
    return filled.withColumn(column, F.coalesce(F.col(column), F.col("_carry"))).drop("_range", "_carry")


def drop_duplicates(df: DataFrame, subset: list[str] | None = None, order_by: list[str] | None = None) -> DataFrame:
    """One row per key: the first in ``order_by`` (any, if none is given)."""
    need_columns(df, subset or [])
    if not order_by:
        return df.dropDuplicates(subset)
    w = Window.partitionBy(*(subset or df.columns)).orderBy(*[F.col(c).asc_nulls_last() for c in order_by])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def derive(df: DataFrame, name: str, expr: str) -> DataFrame:
    return df.withColumn(name, F.expr(expr))


def split_column(df: DataFrame, column: str, into: list[str], delimiter: str = ",") -> DataFrame:
    """One column per part; an empty part is null, the source column stays."""
    need_columns(df, [column])
    parts = {n: F.nullif(F.split_part(F.col(column), F.lit(delimiter), F.lit(i)), F.lit("")) for i, n in enumerate(into, 1)}
    return df.withColumns(parts)


TEXT_OPS: dict[str, Callable[[Column], Column]] = {
    "trim": F.trim,
    "upper": F.upper,
    "lower": F.lower,
    "collapse_spaces": lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")),
    "title": title_case,
    "strip_accents": strip_accents,
}


def text(df: DataFrame, column: str, op: str, new_column: str | None = None) -> DataFrame:
    need_columns(df, [column])
    if op not in TEXT_OPS:
        raise StepError(f"unknown text operation {op}; one of {sorted(TEXT_OPS)}")
    return df.withColumn(new_column or column, TEXT_OPS[op](F.col(column)))


def replace(df: DataFrame, column: str, pattern: str, replacement: str = "", regex: bool = False) -> DataFrame:
    """All matches of a literal or of a pattern; ``\\1`` in the replacement is group 1."""
    need_columns(df, [column])
    if not regex:
        return df.withColumn(column, F.replace(F.col(column), F.lit(pattern), F.lit(replacement)))
    java = "".join(f"${p[0]}{p[1:]}" if i and p[:1].isdigit() else (p if not i else "\\" + p) for i, p in enumerate(replacement.replace("$", r"\$").split("\\")))
    return df.withColumn(column, F.regexp_replace(F.col(column), pattern, java))


def bin_edges(df: DataFrame, column: str, edges: list[float], new_column: str, labels: list[str] | None = None) -> DataFrame:
    """Half-open bins [lo, hi); outside is null."""
    need_columns(df, [column])
    out = F.lit(None).cast("string")
    for i in range(len(edges) - 2, -1, -1):
        label = labels[i] if labels else f"[{edges[i]}, {edges[i + 1]})"
        out = F.when((F.col(column) >= edges[i]) & (F.col(column) < edges[i + 1]), label).otherwise(out)
    return df.withColumn(new_column, out)


def bin_width(df: DataFrame, column: str, new_column: str, bins: int = 5) -> DataFrame:
    """Number of the equal-width bin, 0 to bins - 1; a constant column falls into the last."""
    need_columns(df, [column])
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    place = F.floor(F.try_divide(F.col(column) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins)
    made = F.when(F.col(column).isNotNull(), F.least(F.lit(bins - 1).cast("long"), place))
    return df.crossJoin(F.broadcast(ends)).withColumn(new_column, made).drop("_lo", "_hi")


DATE_PARTS: dict[str, Callable[[Column], Column]] = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "dow": lambda c: F.dayofweek(c) - 1, "quarter": F.quarter, "week": F.weekofyear,
    "hour": F.hour, "minute": F.minute,
}


def date_parts(df: DataFrame, column: str, parts: list[str]) -> DataFrame:
    need_columns(df, [column])
    return df.withColumns({f"{column}_{p}": DATE_PARTS[p](F.col(column)) for p in parts})


def sql(df: DataFrame, query: str) -> DataFrame:
    """One statement over the table ``{prev}``."""
    return df.sparkSession.sql(query, prev=df)


AGGREGATES: dict[str, Callable[[str], Column]] = {
    "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "count_distinct": F.countDistinct, "median": F.median,
    "stddev": F.stddev_samp,
}


def group(df: DataFrame, group_by: list[str], aggregations: list[dict]) -> DataFrame:
    """Aggregates {fn, column, alias} per key; no key is the grand total; count without a column counts rows."""
    need_columns(df, group_by)
    made = []
    for a in aggregations:
        fn, column = a["fn"], a.get("column")
        if fn not in AGGREGATES:
            raise StepError(f"unknown aggregate {fn}")
        value = F.count("*") if fn == "count" and not column else AGGREGATES[fn](column)
        made.append(value.alias(a.get("alias") or (f"{fn}_{column}" if column else fn)))
    return df.groupBy(*group_by).agg(*made)


def pivot(df: DataFrame, on: str, value: str, fn: str = "sum", group_by: list[str] | None = None) -> DataFrame:
    """The values of ``on``, sorted, as columns; null values of ``on`` give no column."""
    need_columns(df, [on, value, *(group_by or [])])
    keys = group_by or [c for c in df.columns if c not in (on, value)]
    # a list of columns: as long as the result is wide
    values = [r[0] for r in df.where(F.col(on).isNotNull()).select(on).distinct().orderBy(on).collect()]
    return df.groupBy(*keys).pivot(on, values).agg(AGGREGATES[fn](value))


def unpivot(df: DataFrame, on: list[str], name_col: str = "key", value_col: str = "value") -> DataFrame:
    """The listed columns as rows of name and value; null values are left out."""
    need_columns(df, on)
    return df.unpivot([c for c in df.columns if c not in on], on, name_col, value_col).where(F.col(value_col).isNotNull())


def join(df: DataFrame, other: DataFrame, on: list[dict], how: str = "left") -> DataFrame:
    """Equi join; the right keys go, names that clash get ``_1``; a right-only row has a null left key."""
    left, right = df.alias("l"), other.alias("r")
    need_columns(df, [p["left"] for p in on])
    need_columns(other, [p["right"] for p in on])
    cond = None
    for p in on:
        one = F.col(f"l.`{p['left']}`") == F.col(f"r.`{p['right']}`")
        cond = one if cond is None else cond & one
    keys = {p["right"] for p in on}
    kept = [F.col(f"l.`{c}`") for c in df.columns]
    kept += [F.col(f"r.`{c}`").alias(f"{c}_1" if c in df.columns else c) for c in other.columns if c not in keys]
    return left.join(right, cond, how).select(*kept)


def union(df: DataFrame, other: DataFrame, distinct: bool = False) -> DataFrame:
    """By name; what a side lacks is null."""
    out = df.unionByName(other, allowMissingColumns=True)
    return out.distinct() if distinct else out


def sort(df: DataFrame, by: list) -> DataFrame:
    keys = [(k, False) if isinstance(k, str) else (k["column"], k.get("desc", False)) for k in by]
    need_columns(df, [k for k, _ in keys])
    return df.orderBy(*[F.col(k).desc_nulls_last() if d else F.col(k).asc_nulls_last() for k, d in keys])


def sample(df: DataFrame, n: int | None = None, frac: float | None = None, seed: int = 42) -> DataFrame:
    """A fixed number of rows, the least by a seeded hash of the row, or a Bernoulli share."""
    if (n is None) == (frac is None):
        raise StepError("give n or frac")
    if frac is not None:
        return df.sample(fraction=frac, seed=seed)
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns), *df.columns).limit(n)


WINDOW_FNS = ("lag", "lead", "rolling_mean", "rolling_sum", "row_number", "rank")


def window(
    df: DataFrame, fn: str, order_by: list[str], column: str | None = None, partition_by: list[str] | None = None, offset: int = 1, window_size: int = 3,
    new_column: str | None = None,
) -> DataFrame:
    if fn not in WINDOW_FNS:
        raise StepError(f"unknown window function {fn}; one of {WINDOW_FNS}")
    need_columns(df, [*order_by, *(partition_by or []), *([column] if column else [])])
    name = new_column or (f"{fn}_{column}" if column else fn)
    if not partition_by:
        return _whole_table_window(df, fn, order_by, column, offset, window_size, name)
    w = Window.partitionBy(*partition_by).orderBy(*[F.col(c).asc_nulls_last() for c in order_by])
    return df.withColumn(name, _window_value(fn, w, column, offset, window_size))


def _window_value(fn: str, w, column: str | None, offset: int, window_size: int) -> Column:
    rolling = w.rowsBetween(-(window_size - 1), 0)
    made = {
        "lag": lambda: F.lag(column, offset).over(w), "lead": lambda: F.lead(column, offset).over(w),
        "rolling_mean": lambda: F.avg(column).over(rolling), "rolling_sum": lambda: F.sum(column).over(rolling),
        "row_number": lambda: F.row_number().over(w), "rank": lambda: F.rank().over(w),
    }
    return made[fn]()


def _whole_table_window(df: DataFrame, fn: str, order_by: list[str], column: str | None, offset: int, window_size: int, name: str) -> DataFrame:
    """A window without partitions, but not in one task: row numbers along range partitions; the others in blocks of consecutive rows that
    hold the rows their windows reach back or forward to."""
    from .ranks import blocked, global_rank

    if fn == "row_number":
        return global_rank(df, order_by, name).withColumn(name, F.col(name).cast("int"))
    if fn == "rank":
        rows = stored(global_rank(df, order_by, "_i"), "window-ranks")
        first = rows.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(order_by)]).agg(F.min("_i").cast("int").alias(name))
        same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(order_by)]
        cond = same[0]
        for s in same[1:]:
            cond = cond & s
        return rows.join(first, cond).select(*df.columns, name)
    before = offset if fn == "lag" else window_size - 1 if fn.startswith("rolling") else 0
    rows = blocked(df, order_by, before, offset if fn == "lead" else 0)
    w = Window.partitionBy("_block").orderBy("_i")
    return rows.withColumn(name, _window_value(fn, w, column, offset, window_size)).where("_own").select(*df.columns, name)


#: Step name -> (function, required parameters, optional parameters).
CATALOGUE: dict[str, tuple[Callable, set[str], set[str]]] = {
    "filter": (filter_rows, {"expr"}, set()),
    "select": (select, {"columns"}, set()),
    "drop": (drop, {"columns"}, set()),
    "rename": (rename, {"mapping"}, set()),
    "cast": (cast, {"column", "to"}, {"spanish_number", "date_format"}),
    "fill_null": (fill_null, {"column"}, {"strategy", "value", "order_by", "partition_by"}),
    "drop_duplicates": (drop_duplicates, set(), {"subset", "order_by"}),
    "derive": (derive, {"name", "expr"}, set()),
    "split_column": (split_column, {"column", "into"}, {"delimiter"}),
    "text": (text, {"column", "op"}, {"new_column"}),
    "replace": (replace, {"column", "pattern"}, {"replacement", "regex"}),
    "bin_edges": (bin_edges, {"column", "edges", "new_column"}, {"labels"}),
    "bin_width": (bin_width, {"column", "new_column"}, {"bins"}),
    "date_parts": (date_parts, {"column", "parts"}, set()),
    "group": (group, {"group_by", "aggregations"}, set()),
    "pivot": (pivot, {"on", "value"}, {"fn", "group_by"}),
    "unpivot": (unpivot, {"on"}, {"name_col", "value_col"}),
    "join": (join, {"other", "on"}, {"how"}),
    "union": (union, {"other"}, {"distinct"}),
    "sort": (sort, {"by"}, set()),
    "sample": (sample, set(), {"n", "frac", "seed"}),
    "window": (window, {"fn", "order_by"}, {"column", "partition_by", "offset", "window_size", "new_column"}),
    "sql": (sql, {"query"}, set()),
}


def apply_step(df: DataFrame, op: str, params: dict) -> DataFrame:
    """Check the contract of a step, then apply it."""
    if op not in CATALOGUE:
        raise StepError(f"unknown step {op}; close: {difflib.get_close_matches(op, CATALOGUE, 3)}")
    fn, required, optional = CATALOGUE[op]
    unknown = set(params) - required - optional
    if unknown:
        close = {u: difflib.get_close_matches(u, required | optional, 1) for u in unknown}
        raise StepError(f"{op} takes no {sorted(unknown)}; close: {close}")
    if missing := required - set(params):
        raise StepError(f"{op} needs {sorted(missing)}")
    return fn(df, **params)
