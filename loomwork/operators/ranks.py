"""Ranks and running sums over a whole table without a one-task window: range partitions and their offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stored


def _ranged(df: DataFrame, order_by: list[str]) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(c).asc_nulls_last() for c in order_by]).withColumn("_p", F.spark_partition_id())
    return stored(ranged, "ranges")


def _offsets(ranged: DataFrame, value) -> DataFrame:
    """(_p, _o): sum of ``value`` over the partitions before; a row per partition."""
    sums = ranged.groupBy("_p").agg(value.alias("_s"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sums.select("_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o")))


def global_rank(df: DataFrame, order_by: list[str], name: str = "rank") -> DataFrame:
    """Row number over the whole table."""
    r = _ranged(df, order_by)
    w = Window.partitionBy("_p").orderBy(*[F.col(c).asc_nulls_last() for c in order_by])
    out = r.withColumn(name, F.row_number().over(w)).join(_offsets(r, F.count("*")), "_p")
    return out.withColumn(name, F.col(name) + F.col("_o")).drop("_p", "_o")


def running_sum(df: DataFrame, order_by: list[str], column: str, name: str, part: str | None = None) -> DataFrame:
    """Sum of ``column`` up to and with each row in the order; ``part`` names a column for the range of the row."""
    r = _ranged(df, order_by)
    w = Window.partitionBy("_p").orderBy(*[F.col(c).asc_nulls_last() for c in order_by]).rowsBetween(Window.unboundedPreceding, 0)
    out = r.withColumn(name, F.sum(column).over(w)).join(_offsets(r, F.sum(column)), "_p")
    out = out.withColumn(name, F.col(name) + F.col("_o")).drop("_o")
    return out.withColumnRenamed("_p", part) if part else out.drop("_p")


def mid_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """Mean rank of equal values (nulls get none)."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_k"))
    ends = running_sum(counts, [column], "_k", "_e")
    ranks = ends.select(F.col(column).alias("_v"), (F.col("_e") - (F.col("_k") - 1) / 2).alias(name))
    return df.join(ranks, F.col(column) == F.col("_v"), "left").drop("_v")


def quantiles(df: DataFrame, columns: dict[str, Column | str], shares: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of whole columns with linear interpolation, as ``percentile`` gives them, without a task that holds all values of a
    column: the values of all columns are counted, summed along range partitions, and the two around each place are picked.
    A row per column reaches the driver."""
    cells = [F.struct(F.lit(n).alias("name"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("v")) for n, c in columns.items()]
    counts = df.select(F.explode(F.array(*cells)).alias("x")).where("x.v is not null").groupBy("x.name", "x.v").agg(F.count("*").alias("k"))
    r = _ranged(counts, ["name", "v"])
    sums = r.groupBy("name", "_p").agg(F.sum("k").alias("_s"))
    before = Window.partitionBy("name").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(sums.select("name", "_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"), F.sum("_s").over(Window.partitionBy("name")).alias("n")))
    w = Window.partitionBy("_p", "name").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ends = r.withColumn("e", F.sum("k").over(w)).join(offsets, ["name", "_p"]).withColumn("e", F.col("e") + F.col("_o"))
    made = [F.max("n").alias("n")]
    for i, share in enumerate(shares):
        place = F.lit(share) * (F.col("n") - 1)  # from 0
        for side, at in (("l", F.floor(place)), ("h", F.ceil(place))):
            made.append(F.max(F.when((at < F.col("e")) & (at >= F.col("e") - F.col("k")), F.col("v"))).alias(f"{side}{i}"))
    out: dict[str, list[float | None]] = {n: [None] * len(shares) for n in columns}
    for x in ends.groupBy("name").agg(*made).collect():
        places = [s * (x.n - 1) for s in shares]
        out[x.name] = [x[f"l{i}"] + (at - int(at)) * (x[f"h{i}"] - x[f"l{i}"]) if x[f"h{i}"] != x[f"l{i}"] else x[f"l{i}"] for i, at in enumerate(places)]
    return out


#: Rows of a block of ``blocked``.
BLOCK_ROWS = 100_000


def blocked(df: DataFrame, order_by: list[str], before: int, after: int) -> DataFrame:
    """Rows with ``_i`` (row number in the order), ``_block`` and ``_own``: each block of BLOCK_ROWS consecutive rows also holds ``before`` rows
    of the block before and ``after`` rows of the next, as context (``_own`` false), so windows of that reach can run per block."""
    rows = global_rank(df, order_by, "_i").withColumn("_b", F.floor((F.col("_i") - 1) / BLOCK_ROWS))
    first = F.floor((F.col("_i") - 1 - after) / BLOCK_ROWS)
    last = F.floor((F.col("_i") - 1 + before) / BLOCK_ROWS)
    rows = rows.withColumn("_block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    return rows.withColumn("_own", F.col("_block") == F.col("_b")).drop("_b")
