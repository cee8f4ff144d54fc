"""Shared helpers of the training-data operators: shared folders, written tables,
size-checked broadcasts, connected components and ordered partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import broadcast_if_small, scratch, stored  # noqa: F401

#: Nodes of a key that are not yet connected to its least one beyond which ``connect`` draws some of them, and how many.
CROWD, DRAWS = 16, 8
#: Most bits of a sieve (32 MB); the fewest are SIEVE_LEAST.
SIEVE_BITS, SIEVE_LEAST = 28, 16

#: Rows for which a table of ids gets one more partition.
PART_ROWS = 20_000

#: Byte table that lower-cases A-Z and leaves every other byte of UTF-8 alone.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_dir(spark: SparkSession, name: str) -> str:
    return scratch(spark, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a
    lost executor costs a re-read instead of a recomputation."""
    return stored(df, name)


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as many partitions as so many rows of ids need, at most those it has: a small table is not hundreds of files, nor are its shuffles."""
    return df.coalesce(max(1, min(partitions_of(df.sparkSession), rows // PART_ROWS)))


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) long pairs -> (node, root) for every node of an edge; root is the least
    node of its component.  Alternates large-star and small-star steps (Kiveris et al.,
    2014) until every node hangs on its root; each round is written to the shared folder,
    nothing but a flag per round reaches the driver.

    An edge (u, v) has u > v.  Large-star hangs u on the least neighbour of v; those are written first, so Spark may
    split the many edges of a hub v.  Small-star hangs u and its other smaller neighbours on the least of them."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = written(e, name)
    size = e.count()

    def stars(e: DataFrame) -> bool:
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("high"))
        ends = ends.union(e.select("v", F.lit(0), F.lit(1)))
        sums = ends.groupBy("node").agg(F.sum("low").alias("low"), F.max("high").alias("high"))
        return sums.where("low > 1 or low = 1 and high = 1").isEmpty()

    while not stars(e):
        least = written(gathered(e.groupBy("u").agg(F.min("v").alias("m")), size), name)
        large = e.join(least.withColumnRenamed("u", "v"), "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        small = gathered(gathered(large, size).withColumn("m", F.min("v").over(Window.partitionBy("u"))), size)
        both = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = small.select(F.explode(both).alias("x")).select("x.u", "x.v").where("u <> v")
        e = written(gathered(small.distinct(), size), name)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())


def connect(
    members: DataFrame, near: Callable[[Column, Column], Column], name: str, dense: Callable[[DataFrame], DataFrame] | None = None, hot: int = 1024,
    verify: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Written (node, root) of all nodes that pairs of nodes connect which share a key and are ``near``; root is the least node.
    ``members`` is a written table (key, node, value); ``near`` takes two values (and may use the column ``key``).
    ``verify``, if given, takes pairs (a, b) that are near and gives those that count.

    1. Each key's least node is compared with its others, and what is near is connected.
    2. Only nodes that are still in another component than their key's least node go on.  In keys with more than CROWD of them,
       DRAWS of those, by a hash, are compared with all nodes of the key that are in other components.
    3. What is left over is compared with all nodes of the key that are in other components.  Keys with more than ``hot`` such
       nodes go to ``dense`` if that is given, which must find the components of (key, node, value) in a cheaper way.
    So no component is lost, and comparisons grow with a group of alike nodes, not with its square."""

    def counted(pairs: DataFrame) -> DataFrame:
        """(a, b) written, verified."""
        pairs = pairs.distinct()
        return written(verify(written(pairs, name + "-near")) if verify else pairs, name + "-links")

    first = members.groupBy("key").agg(F.min(F.struct("node", "value")).alias("x"), F.count("*").alias("n")).where("n > 1")
    first = written(first.select("key", F.col("x.node").alias("rep"), F.col("x.value").alias("rv"), "n"), name + "-first")
    if first.isEmpty():
        return members.select("node", F.col("node").alias("root")).where("false")
    star = members.join(first, "key").where((F.col("node") != F.col("rep")) & near(F.col("value"), F.col("rv")))
    links = counted(star.select(F.col("rep").alias("a"), F.col("node").alias("b")))
    comp = written(connected_components(links, name + "-parts"), name + "-parts")
    more = first.where("n > 2").select("key", "rep")  # keys of two nodes are done
    if more.isEmpty():
        return comp

    def opened() -> DataFrame:
        """(key, node, value, root, main, odd) of keys with ``odd`` nodes in other components than the least one's, main."""
        placed = members.select("key", "node").join(more, "key").join(comp, "node", "left")
        placed = written(placed.select("key", "node", "rep", F.coalesce("root", "node").alias("root")), name + "-placed")
        main = written(placed.where("node = rep").select("key", F.col("root").alias("main")), name + "-main")
        odd = placed.join(broadcast_if_small(main), "key").where("root <> main").groupBy("key", "main").agg(F.count("*").alias("odd"))
        odd = broadcast_if_small(written(odd, name + "-odd"))
        some = members.join(odd, "key").join(placed.select("key", "node", "root"), ["key", "node"])
        return written(some, name + "-open")

    def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
        """Components after further links: those of the roots."""
        own = comp.select(F.col("node").alias("a"), F.col("root").alias("b"))
        return written(connected_components(own.union(links), name + "-parts"), name + "-parts")

    some = opened()
    if some.isEmpty():
        return comp
    crowd = some.where((F.col("odd") > CROWD) & (F.col("root") != F.col("main")))
    if not crowd.isEmpty():
        order = Window.partitionBy("key").orderBy(F.xxhash64("node"))
        drawn = crowd.withColumn("no", F.row_number().over(order)).where(F.col("no") <= DRAWS)
        drawn = written(drawn.select("key", F.col("node").alias("a"), F.col("value").alias("va"), F.col("root").alias("ra")), name + "-drawn")
        pairs = some.join(broadcast_if_small(drawn), "key").where((F.col("root") != F.col("ra")) & near(F.col("va"), F.col("value")))
        comp = joined(comp, counted(pairs.select("a", F.col("node").alias("b"))))
        some = opened()
        if some.isEmpty():
            return comp
    small = some.where(F.col("odd") <= hot) if dense else some
    one = small.where("root <> main").select("key", F.col("node").alias("a"), F.col("value").alias("va"), F.col("root").alias("ra"))
    other = small.select("key", F.col("node").alias("b"), F.col("value").alias("vb"), F.col("root").alias("rb"), (F.col("root") == F.col("main")).alias("in_main"))
    pairs = one.join(other, "key").where((F.col("ra") != F.col("rb")) & (F.col("in_main") | (F.col("a") < F.col("b"))) & near(F.col("va"), F.col("vb")))
    links = counted(pairs.select("a", "b"))
    if dense and not (rest := some.where(F.col("odd") > hot)).isEmpty():
        links = links.union(dense(rest.select("key", "node", "value")).toDF("a", "b"))
    return comp if links.isEmpty() else joined(comp, links)


class Sieve:
    """A bitmap of hashes, by their high bits: of SIEVE_BITS bits at most, so beyond that it lets more through, never less."""

    def __init__(self, hashes: DataFrame, column: str):
        count = hashes.count()
        self.bits = min(SIEVE_BITS, max(SIEVE_LEAST, (64 * count).bit_length()))
        place = F.shiftrightunsigned(column, 64 - self.bits)
        bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - self.bits}) & 63 as int))")
        found = hashes.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
        bits = np.zeros(1 << (self.bits - 6), np.int64)
        bits[found["word"].to_numpy()] = found["bits"].to_numpy()
        self.shared = hashes.sparkSession.sparkContext.broadcast(bits)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        words = self.shared.value.view(np.uint64)
        at = hashes.view(np.uint64) >> _U(64 - self.bits)
        return (words[(at >> _U(6)).astype(np.int64)] >> (at & _U(63)) & _U(1)).astype(bool)


def order_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """Up to ``parts - 1`` ascending cut values of a long column: approximate quantiles,
    as a range partitioner takes them (a list as long as the number of partitions)."""
    if parts < 2:
        return []
    cuts = df.where(F.col(key).isNotNull()).agg(
        F.percentile_approx(key, [i / parts for i in range(1, parts)], 20 * parts).alias("q")
    ).first()["q"]
    return sorted(set(cuts or []))


def bucket_of(key: str, bounds: list[int]) -> Column:
    """Number of the bounds that are below the key (0 for null): a range bucket in key order."""
    if not bounds:
        return F.lit(0)
    cuts = np.asarray(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def bucket(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, k.to_numpy(dtype=np.int64), side="left").astype(np.int32))

    return bucket(F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)).cast("long")))


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def labelled_sample(docs: DataFrame, known: DataFrame, max_rows: int) -> list[tuple[bytes, int]]:
    """(whole text, y) of at most ``max_rows`` rows of ``known`` (doc_id, y), the first by a hash
    of doc_id; rows with a null id or y are left out, of repeated ids one row is taken."""
    picked = known.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id")
    return [((r.text or "").encode(), r.y) for r in rows.limit(max_rows).collect()]


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text of an Arrow column, null as empty."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


_U = np.uint64
#: Odd 64-bit multipliers.
WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
#: Bytes of a word beyond which it is hashed by itself.
LONG_WORD = 256


def mix64(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of unsigned 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * WEIGHTS[1]
    x = (x ^ (x >> _U(27))) * WEIGHTS[2]
    return x ^ (x >> _U(31))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each run of true values."""
    pad = np.zeros(len(inside) + 2, dtype=bool)
    pad[1:-1] = inside
    edge = np.flatnonzero(pad[1:] != pad[:-1])
    return edge[::2], edge[1::2]


def span_hashes(padded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each span of bytes, eight bytes at a time; ``padded`` ends in eight bytes more.
    Up to eight bytes the second is those bytes themselves."""
    eight = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    size = ends - starts
    g = eight[starts] & _MASKS[np.minimum(size, 8)]
    h = mix64(g + size.astype(np.uint64) * WEIGHTS[0])
    more, k = np.flatnonzero(size > 8), 8
    while len(more) and k < LONG_WORD:
        part = eight[starts[more] + k] & _MASKS[np.minimum(size[more] - k, 8)]
        h[more] = mix64(h[more] * WEIGHTS[1] + part)
        g[more] = g[more] * WEIGHTS[3] + part + _U(k)
        k += 8
        more = more[size[more] > k]
    for i in more.tolist():
        whole = padded[starts[i] : ends[i]].tobytes()
        h[i], g[i] = xxhash.xxh64_intdigest(whole), xxhash.xxh64_intdigest(whole, 1)
    return h, g


def slices(texts: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together; a longer text stands alone."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield at, to
        at = to
