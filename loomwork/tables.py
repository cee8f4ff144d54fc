"""Access to the tables of a folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a side of a join is broadcast after they were counted.
BROADCAST_BYTES = 24_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one that the session names; only where it names none, a temporary one is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("name a shared folder in spark.checkpoint.dir: executors don't share a temporary one")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what depends on how rows were dealt (range
    partitions are sampled anew by every run) stays as it was, and a lost executor costs a re-read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _width(kind: T.DataType, c: Column) -> Column:
    """Bytes of a value in a row, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        return 8 * F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) + 24
    if isinstance(kind, T.StructType):
        return sum((_width(f.dataType, c[f.name]) for f in kind.fields), F.lit(16))
    return F.lit(8)


def broadcast_if_small(df: DataFrame, size: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint behind a count of the bytes (``df`` should be a written table, so that the
    count is cheap); beyond ``size`` Spark joins by a shuffle."""
    width = sum((_width(f.dataType, F.col(f.name)) for f in df.schema.fields), F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(width.cast("long"))).first()[0] or 0) <= size else df
