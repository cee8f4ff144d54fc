"""Substring dedup by paragraph MinHash banding.

Three kinds of paragraphs, each compared with its own kind only, for they overlap:

* LINE: a whole line; consecutive lines of fewer than MIN_WORDS words are one.
* PIECE: a line cut at content-defined places (a word whose hash is the least among the RADIUS words on
  either side starts a piece), so that a passage in the middle of other text falls into the same pieces
  wherever it stands.  RADIUS + 1 is MIN_WORDS, so no piece is shorter than that, if its line isn't.
  A line that is a single piece is both.
* JOINED: short lines that together stay below MIN_WORDS, with the line after (else before) them.  A text that is
  shorter than that as a whole is one LINE.

1. LINE and JOINED paragraphs get a MinHash key per band over their SHINGLE-word shingles; ``tune_bands`` picks the
   fewest bands of ROWS rows whose recall at THRESHOLD is at least RECALL.  A PIECE has one key, the hash of its
   words: pieces are so short that one changed word makes them unlike, so only equal ones are sought.
2. Keys are counted with map-side combination.  A key under which a single text occurs more than once names an
   exact repeat; a key under which different texts meet names candidates.
3. Candidates under one key are compared with a few of its texts by exact Jaccard likeness of their shingles inside the join,
   and then with what is not connected to them (see ``common.connect``), so no component is lost and a group of near copies
   costs some comparisons a member.  Keys with more than HOT such left-overs are not paired: their texts join on prefix tokens instead
   (the |x| - ceil(THRESHOLD |x|) + 1 rarest shingles, which two texts at the threshold must share one of), in the same way.
4. Links form components; in each the first occurrence (smallest doc_id, then row, then place) stays and the others are
   marked as removed, but for paragraphs of the same row that overlap the one that stays.  Repeats must agree in
   two independent 64-bit hashes of their words.

The texts are read three times (keys, shingles of candidates, places of what is repeated) instead of storing
every paragraph; the last two readings are sieved by a bitmap of the hashes that matter, of SIEVE_BITS bits at most, which lets
too much through rather than too little.  All hashing is done over whole Arrow batches in numpy.

Edge cases: null and empty texts have no paragraphs; a null doc_id comes after all others; repeated rows
are exact repeats of one another, of which one stays; a text of any length is read whole; fewer words than a shingle make
one shingle; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER_ASCII, WEIGHTS, Sieve, broadcast_if_small, connect, mix64, read_table, runs, slices, span_hashes, utf8, written

SHINGLE = 5
MIN_WORDS = 7
RADIUS = MIN_WORDS - 1
THRESHOLD = 0.8
RECALL = 0.99
#: Texts under one key, not connected to its least text, that are still compared with all others of the key: up to here
#: the pairs cost less than the jobs of the other way, which finds the same.
HOT = 4096
#: Kinds of paragraphs: the two low bits of a key.  A line that is a single piece has keys of LINE and PIECE.
LINE, PIECE, JOINED, BOTH = 0, 1, 2, 3
#: Bytes of text that are hashed at once; a longer text is hashed by itself.
SLICE = 1 << 20

BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64


def tune_bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = 2) -> tuple[int, int]:
    """(bands, rows): the fewest bands whose recall 1 - (1 - s^rows)^bands at the threshold is enough.  One row a band
    would need fewer keys, but makes a candidate of every pair that shares a little, and those grow with the square."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows


BANDS, ROWS = tune_bands()


_SALTS = mix64(np.arange(1, 65, dtype=np.uint64))


@dataclass
class Units:
    """Word hashes of some texts, and their paragraphs as ranges [a, z) of words."""

    h: np.ndarray
    text: np.ndarray
    para: np.ndarray
    a: np.ndarray
    z: np.ndarray
    kind: np.ndarray
    first: np.ndarray
    last: np.ndarray


def piece_starts(h: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places (but for the begins) at which pieces start in the blocks [begin, end) of words."""
    n = len(h) - 2 * RADIUS
    if n < 1 or not len(begins):
        return np.zeros(0, dtype=np.int64)
    mid = h[RADIUS : RADIUS + n]
    least = np.ones(n, dtype=bool)
    for d in range(1, RADIUS + 1):
        least &= mid < h[RADIUS - d : RADIUS - d + n]
        least &= mid <= h[RADIUS + d : RADIUS + d + n]
    at = np.flatnonzero(least) + RADIUS
    block = np.searchsorted(begins, at, side="right") - 1
    return at[(block >= 0) & (at - begins[block] >= MIN_WORDS) & (ends[block] - at >= MIN_WORDS)]


def units_of(texts: list[bytes]) -> Units:
    """The paragraphs of texts, in the order of the texts; first and last are code points of the text."""
    data = b"\n".join(texts).translate(LOWER_ASCII)
    size = len(data)
    bytes_of = np.frombuffer(data + bytes(8), dtype=np.uint8)
    starts, ends = runs(~BLANK[bytes_of[:size]])
    h, _ = span_hashes(bytes_of, starts, ends)
    n = len(h)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes + 1) - sizes - 1
    line = np.searchsorted(np.flatnonzero(bytes_of[:size] == 10), starts)
    first = np.flatnonzero(np.diff(line, prepend=-1))
    owner = np.searchsorted(begins, starts[first], side="right") - 1
    short = np.diff(np.append(first, n)) < MIN_WORDS
    fresh = np.ones(len(first), dtype=bool)
    fresh[1:] = ~(short[1:] & short[:-1] & (owner[1:] == owner[:-1]))
    ba, owner = first[fresh], owner[fresh]
    bz = np.append(ba[1:], n)[: len(ba)]
    same = owner[1:] == owner[:-1]
    after, before = np.append(same, False)[: len(ba)], np.append(False, same)[: len(ba)]
    loose = (bz - ba < MIN_WORDS) & (after | before)
    i = np.flatnonzero(loose)
    ja, jz = np.where(after[i], ba[i], ba[i - 1]), np.where(after[i], bz[np.minimum(i + 1, len(bz) - 1)], bz[i])
    wa, wz, wo = ba[~loose], bz[~loose], owner[~loose]
    pa_ = np.sort(np.concatenate([wa, piece_starts(h, wa, wz)]))
    block = np.searchsorted(wa, pa_, side="right") - 1
    pz = np.append(pa_[1:], n)[: len(pa_)]
    turn = np.append(block[1:] != block[:-1], True)[: len(pa_)]
    pz[turn] = wz[block[turn]]
    many = np.bincount(block, minlength=len(wa)) > 1
    cut = many[block] if len(block) else np.zeros(0, dtype=bool)
    a = np.concatenate([wa, pa_[cut], ja])
    z = np.concatenate([wz, pz[cut], jz])
    text = np.concatenate([wo, wo[block[cut]], owner[i]])
    kind = np.concatenate([np.where(many, LINE, BOTH), np.full(cut.sum(), PIECE), np.full(len(i), JOINED)])
    order = np.argsort(text, kind="stable")
    a, z, text, kind = a[order], z[order], text[order], kind[order]
    para = np.arange(len(a)) - np.searchsorted(text, text)
    lo, hi = starts[a], ends[z - 1] if len(z) else z
    if data.isascii():
        return Units(h, text, para, a, z, kind, lo - begins[text], hi - begins[text])
    point = np.zeros(size + 1, dtype=np.int64)
    np.cumsum((bytes_of[:size] & 0xC0) != 0x80, out=point[1:])
    return Units(h, text, para, a, z, kind, point[lo] - point[begins[text]], point[hi] - point[begins[text]])


def paragraphs(text: bytes) -> list[tuple[int, int, np.ndarray]]:
    """(first, last, word hashes) of each LINE and PIECE; JOINED ones would be alike to the lines in them."""
    u = units_of([text])
    return [(int(f), int(e), u.h[a:z]) for f, e, a, z, k in zip(u.first, u.last, u.a, u.z, u.kind) if k != JOINED]


def _rolled(h: np.ndarray) -> np.ndarray:
    """Hash of the shingle that starts at each word (the last ones are of no use but for texts shorter than that)."""
    total = np.zeros(len(h), dtype=np.uint64)
    for i in range(min(SHINGLE, len(h))):
        total[: len(h) - i] += h[i:] * WEIGHTS[i]
    return mix64(total)


def _few(u: Units) -> tuple[np.ndarray, np.ndarray]:
    """The paragraphs of fewer words than a shingle, and the hash of their single shingle."""
    few = np.flatnonzero(u.z - u.a < SHINGLE)
    total = np.zeros(len(few), dtype=np.uint64)
    for i in range(SHINGLE - 1):
        has = u.z[few] - u.a[few] > i
        total[has] += u.h[u.a[few[has]] + i] * WEIGHTS[i]
    return few, mix64(total)


def shingles(h: np.ndarray) -> np.ndarray:
    """Distinct shingle hashes of a paragraph."""
    return np.unique(_rolled(h)[: max(1, len(h) - SHINGLE + 1)])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def whole_hashes(u: Units, which: int = 0) -> np.ndarray:
    """Hash of all words of each paragraph in their order; ``which`` chooses one of two independent ones."""
    base = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)[which]
    h = u.h if which == 0 else mix64(u.h ^ WEIGHTS[4])
    total = np.append(_U(0), np.cumsum(h * _powers(base, len(h))[: len(h)], dtype=np.uint64))
    back = _powers(pow(base, -1, 1 << 64), len(h))
    return mix64((total[u.z] - total[u.a]) * back[u.a] + (u.z - u.a).astype(np.uint64) * WEIGHTS[2]).view(np.int64)


def band_keys(u: Units) -> np.ndarray:
    """(paragraphs, BANDS) MinHash keys, before ``of_kind``."""
    s = np.append(_rolled(u.h), _U(0))
    few, single = _few(u)
    cuts = np.stack([u.a, np.maximum(u.a + 1, u.z - SHINGLE + 1)], axis=1).ravel()
    keys = np.empty((len(u.a), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        key = np.full(len(u.a), b, dtype=np.uint64)
        for salt in _SALTS[b * ROWS : (b + 1) * ROWS]:
            odd = mix64(np.array([salt]))[0] | _U(1)
            least = np.minimum.reduceat((s ^ salt) * odd, cuts)[::2] if len(cuts) else np.zeros(0, np.uint64)
            least[few] = (single ^ salt) * odd
            key = mix64(key * WEIGHTS[0] + least)
        keys[:, b] = key
    return keys


def of_kind(keys: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
    """Keys (signed) under which only paragraphs of a kind meet."""
    kind = np.asarray(kind)
    return (mix64(keys.view(np.uint64) ^ WEIGHTS[kind + 1]) & ~_U(3) | kind.astype(np.uint64)).view(np.int64)


def _some(u: Units, at: np.ndarray) -> Units:
    return Units(u.h, u.text[at], u.para[at], u.a[at], u.z[at], u.kind[at], u.first[at], u.last[at])


def banded(u: Units) -> tuple[Units, np.ndarray, np.ndarray]:
    """(LINE and JOINED paragraphs, their hashes, their keys of shape (n, BANDS))."""
    lines = _some(u, np.flatnonzero(u.kind != PIECE))
    kind = np.where(lines.kind == JOINED, JOINED, LINE)
    return lines, whole_hashes(lines), of_kind(band_keys(lines), kind[:, None])


def _read(docs: DataFrame, id_col: str, text_col: str, make: Callable, schema: str) -> DataFrame:
    """``make(units, ids, rows)`` gives the columns of ``schema`` for a slice of rows, or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b.column(2))
            for at, to in slices(texts, SLICE):
                u = units_of(texts[at:to])
                if len(u.a):
                    made = make(u, b.column(0).slice(at, to - at), b.column(1).slice(at, to - at))
                    if made is not None:
                        yield pa.RecordBatch.from_arrays(made, [x.split()[0] for x in schema.split(", ")])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, schema)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, h) of every paragraph and band, and of every piece."""

    def make(u: Units, ids: pa.Array, rows: pa.Array) -> list[pa.Array]:
        _, h, keys = banded(u)
        same = whole_hashes(_some(u, np.flatnonzero((u.kind == PIECE) | (u.kind == BOTH))))
        key = np.concatenate([keys.ravel(), of_kind(same, PIECE)])
        return [pa.array(key), pa.array(np.concatenate([np.repeat(h, BANDS), same]))]

    return _read(docs, id_col, text_col, make, "key long, h long")


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat))


def candidates(docs: DataFrame, sieve: Sieve, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h, g, n, keys, s) of the texts with a key that passes the sieve: both hashes, occurrences in a slice, those keys
    and the sorted shingles.  A text has a row per slice of rows that it is in."""

    def make(u: Units, ids: pa.Array, rows: pa.Array) -> list[pa.Array] | None:
        lines, h, keys = banded(u)
        hit = sieve(keys)
        at = np.flatnonzero(hit.any(axis=1))
        if not len(at):
            return None
        _, one, n = np.unique(np.stack([h[at], lines.kind[at] == JOINED], axis=1), axis=0, return_index=True, return_counts=True)
        at = at[one]
        s = [shingles(u.h[lines.a[i] : lines.z[i]]).view(np.int64) for i in at]
        listed = _lists(np.concatenate(s), np.fromiter(map(len, s), np.int64, len(s)))
        g = whole_hashes(_some(lines, at), 1)
        return [pa.array(h[at]), pa.array(g), pa.array(n), _lists(keys[at][hit[at]], hit[at].sum(axis=1)), listed]

    return _read(docs, id_col, text_col, make, "h long, g long, n long, keys array<long>, s array<long>")


def places(docs: DataFrame, sieve: Sieve, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, para, first, last, n_words, h, g) of the paragraphs whose h passes the sieve."""

    def make(u: Units, ids: pa.Array, rows: pa.Array) -> list[pa.Array] | None:
        h = whole_hashes(u)
        at = np.flatnonzero(sieve(h))
        if not len(at):
            return None
        some = _some(u, at)
        text = pa.array(some.text)
        whole = [pa.array(x.astype(np.int64)) for x in (some.para, some.first, some.last, some.z - some.a)]
        return [ids.take(text), rows.take(text), *whole, pa.array(h[at]), pa.array(whole_hashes(some, 1))]

    return _read(docs, id_col, text_col, make, "id long, row long, para long, first long, last long, n_words long, h long, g long")


def _alike(a: Column, b: Column) -> Column:
    """Exact Jaccard likeness of two arrays of distinct values is at least THRESHOLD."""
    na, nb = F.size(a), F.size(b)
    fits = (na >= THRESHOLD * nb) & (nb >= THRESHOLD * na)
    common = F.size(F.array_intersect(a, b))
    return fits & (common >= THRESHOLD * (na + nb - common) - 1e-9)


def by_prefix_tokens(members: DataFrame) -> DataFrame:
    """Components of (key, node, value) through the tokens that alike texts must share, whatever their key."""
    crowd = members.select("node", "value", F.col("key").bitwiseAND(3).alias("kind")).dropDuplicates(["node", "kind"])
    tokens = written(crowd, "para-crowd").select("node", "value", "kind", F.explode("value").alias("token"))
    rarity = written(tokens.groupBy("token", "kind").agg(F.count("*").alias("k")).where("k > 1"), "para-rarity")
    rank = Window.partitionBy("node", "kind").orderBy("k", "token")
    ranked = tokens.join(rarity, ["token", "kind"], "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("r", F.row_number().over(rank))
    prefix = ranked.where((F.col("r") <= F.size("value") - F.ceil(F.lit(THRESHOLD) * F.size("value")) + 1) & (F.col("k") > 1))
    return connect(written(prefix.select(F.xxhash64("token", "kind").alias("key"), "node", "value"), "para-prefix"), _alike, "para-tokens")


def classes_of(members: DataFrame, hot: int | None = None) -> DataFrame:
    """Written (node, root) of text hashes that a likeness of THRESHOLD or more connects, of written ``members`` (key, node, value)."""
    return connect(members, _alike, "para", by_prefix_tokens, hot or HOT)


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, para, first, last, n_words, cluster, keep_id, keep_para, removed): every paragraph that is in a
    cluster of two or more occurrences."""
    counted = keyed(docs, id_col, text_col).groupBy("key").agg(F.min("h").alias("h"), F.max("h").alias("top"), F.count("*").alias("n"))
    counted = written(counted.where("n > 1"), "para-keys")
    exact = counted.where("h = top").select("h").distinct()
    mixed = written(counted.where("h <> top").select("key"), "para-mixed")
    found = written(candidates(docs, Sieve(mixed, "key"), id_col, text_col), "para-candidates")
    texts = found.groupBy("h").agg(F.min(F.struct("g", "s")).alias("x"), F.sum("n").alias("n"))
    texts = written(texts.select("h", "x.g", "x.s", "n"), "para-texts")
    members = found.select(F.explode("keys").alias("key"), "h").distinct().join(broadcast_if_small(mixed), "key")
    members = members.join(texts.select("h", "s"), "h").select("key", F.col("h").alias("node"), F.col("s").alias("value"))
    comp = classes_of(written(members, "para-members")).withColumnRenamed("node", "h")
    again = exact.union(texts.where("n > 1").select("h")).union(comp.select("h")).distinct()
    classes = again.join(comp, "h", "left").join(texts.select("h", "g"), "h", "left")
    classes = classes.select("h", F.coalesce("root", "h").alias("cluster"), F.when(F.col("root").isNotNull(), F.col("g")).alias("own"))
    classes = written(classes, "para-classes")
    found = places(docs, Sieve(classes, "h"), id_col, text_col).join(broadcast_if_small(classes), "h")
    # 0: the text that was compared; else the second hash, which repeats of the same text share
    part = F.when(F.col("own") == F.col("g"), 0).otherwise(F.col("g"))
    found = written(found.withColumn("part", part).drop("h", "g", "own"), "para-found")
    place = F.struct(F.col("id").isNull().alias("null"), "id", "row", "para", "first", "last")
    keep = found.groupBy("cluster", "part").agg(F.min(place).alias("keep"), F.count("*").alias("size")).where("size > 1")
    out = found.join(broadcast_if_small(written(keep.drop("size"), "para-keep")), ["cluster", "part"])
    here = (F.col("row") == F.col("keep.row")) & (F.col("first") < F.col("keep.last")) & (F.col("last") > F.col("keep.first"))
    return out.select(
        "id", "para", "first", "last", "n_words", "cluster", F.col("keep.id").alias("keep_id"), F.col("keep.para").alias("keep_para"), (~here).alias("removed")
    )


def op2_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op2_paragraph_minhash": op2_paragraph_minhash}
