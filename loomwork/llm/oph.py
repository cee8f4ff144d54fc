"""Document fingerprints by one-permutation MinHash.

Every word shingle of a text is hashed once; the top bits of a hash choose one of BINS bins and each bin
keeps its least hash.  Empty bins are filled by optimal densification (Shrivastava, 2017): bin j asks
the bins that a fixed hash of (j, attempt) names until one was filled by a shingle.  The low
LOW_BITS bits of each bin are packed into the fingerprint.  With b bits, bins that differ still agree
with probability 2^-b, so likeness is (agreement - 2^-b) / (1 - 2^-b), not below 0.

Shingles: SHINGLE words, A-Z lower-cased, cut at ASCII white space; a text of fewer words has one
shingle of all of them.

Edge cases: null, empty and wordless texts have the all-zero fingerprint, likeness 1 among themselves
and 0 to any other text; equal texts have equal fingerprints; a null doc_id comes last in descending
order; rows that share a doc_id follow each other by text; an only row is its own next; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_ASCII, bucket_of, mix64, order_bounds, partitions_of, read_table

SHINGLE = 5
BINS = 512
LOW_BITS = 4
#: Most rows of a task, on average.
RANGE_ROWS = 50_000
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
EMPTY = bytes(BINS * LOW_BITS // 8)


_WEIGHTS = mix64(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_hashes(text: bytes) -> np.ndarray:
    words = text.translate(LOWER_ASCII).split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if not len(h):
        return h
    width = min(SHINGLE, len(h))
    n = len(h) - width + 1
    total = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        total += h[i : i + n] * _WEIGHTS[i]
    return mix64(total)


def donors(attempt: int) -> np.ndarray:
    """The bin that each bin asks in an attempt: the same for every text."""
    return (mix64(np.arange(BINS, dtype=np.uint64) + np.uint64((attempt + 1) << 32)) % np.uint64(BINS)).astype(np.int64)


#: Attempts that are kept at hand, made as they are needed.
DONORS_KEPT = 4096
_donors = np.zeros((0, BINS), np.int16)


def asked(start: int, stop: int) -> np.ndarray:
    """``donors`` of these attempts, a row each."""
    global _donors
    if stop > DONORS_KEPT:
        return np.stack([donors(a) for a in range(start, stop)])
    if stop > len(_donors):
        _donors = np.concatenate([_donors, [donors(a).astype(np.int16) for a in range(len(_donors), stop)]])
    return _donors[start:stop]


def densified(low: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """``low`` with every empty bin as the first filled one that it asks; attempts are looked at in blocks, each twice as long."""
    empty, attempt, more = np.flatnonzero(~filled), 0, 4
    while len(empty):
        ask = asked(attempt, attempt + more)[:, empty]
        got = filled[ask]
        first, who = got.argmax(axis=0), np.arange(len(empty))
        has = got[first, who]
        low[empty[has]] = low[ask[first, who][has]]
        empty, attempt, more = empty[~has], attempt + more, min(2 * more, 512)
    return low


def fingerprint(text: bytes) -> bytes:
    """Packed low-order bits of all bins."""
    h = np.sort(shingle_hashes(text))
    if not len(h):
        return EMPTY
    bins = (h >> _SHIFT).astype(np.int64)
    first = np.ones(len(h), dtype=bool)
    first[1:] = bins[1:] != bins[:-1]
    low = np.zeros(BINS, dtype=np.uint8)
    filled = np.zeros(BINS, dtype=bool)
    low[bins[first]] = (h[first] & np.uint64((1 << LOW_BITS) - 1)).astype(np.uint8)
    filled[bins[first]] = True
    low = densified(low, filled)
    packed = np.packbits(np.unpackbits(low[:, None], axis=1, bitorder="little")[:, :LOW_BITS].ravel(), bitorder="little").tobytes()
    return packed if packed != EMPTY else b"\x01" + EMPTY[1:]


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard likeness of the shingle sets, 0 to 1."""
    if a == b:
        return 1.0
    if EMPTY in (a, b):
        return 0.0
    differ = np.bitwise_xor(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8))
    same = (np.unpackbits(differ, bitorder="little").reshape(BINS, LOW_BITS) == 0).all(axis=1).mean()
    chance = 0.5**LOW_BITS
    return max(0.0, float((same - chance) / (1 - chance)))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row of SCHEMA for every row, next to its successor in descending id order.

    Rows are dealt once into range buckets of the id.  The first row of each bucket (its largest
    id) is also sent to the bucket above it as that bucket's last successor, and the first of all to
    the lowest bucket; the table of those is as long as the number of buckets."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = max(partitions_of(spark), src.count() // RANGE_ROWS)
    bounds = order_bounds(src.select("id"), "id", 4 * parts)
    placed = src.withColumn("bucket", bucket_of("id", bounds))
    heads = {r.bucket: r.head for r in placed.select("bucket", "id").groupBy("bucket").agg(F.max("id").alias("head")).collect()}
    order = sorted(heads)
    above = [(b, heads[b], order[(i + 1) % len(order)]) for i, b in enumerate(order)]
    links = spark.createDataFrame(above, "bucket int, head long, above int")
    own = F.struct(F.col("bucket"), F.lit(False).alias("tail"))
    sent = F.struct(F.col("above").alias("bucket"), F.lit(True).alias("tail"))
    dealt = placed.join(F.broadcast(links), "bucket").select(
        "id", "text", F.explode(F.when(F.col("id").eqNullSafe(F.col("head")), F.array(own, sent)).otherwise(F.array(own))).alias("to")
    )
    dealt = dealt.select("id", "text", "to.bucket", "to.tail").repartition(parts, "bucket")
    dealt = dealt.sortWithinPartitions("bucket", "tail", F.col("id").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
        now, held = None, None  # bucket; (id, text, fingerprint) that waits for its successor
        out: list[tuple] = []

        def done(row: tuple, text: str, fp: bytes) -> tuple:
            new = edited(row[1], text)
            raw = new.encode()
            efp = fingerprint(raw)
            return (row[0], len(row[1]), hashlib.sha256(raw).hexdigest(), row[2].hex(), efp.hex(), likeness(row[2], efp), likeness(row[2], fp))

        for b in batches:
            for d, t, k, tail in zip(*[b.column(c).to_pylist() for c in ("id", "text", "bucket", "tail")]):
                if k != now:
                    now, held = k, None
                elif held is None:
                    continue  # rows that share the id of the tail that was taken
                fp = fingerprint((t or "").encode())
                if held is not None:
                    out.append(done(held, t or "", fp))
                held = None if tail else (d, t or "", fp)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*out), types)], names)
                out.clear()

    return dealt.mapInArrow(run, SCHEMA)


def op3_one_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read_table(spark, sf_dir, "documents"))


QUERIES = {"op3_one_permutation": op3_one_permutation}
