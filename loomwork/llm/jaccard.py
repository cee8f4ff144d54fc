"""N-gram Jaccard join by a size-aware heavy-light scheme.

A text is the set of its distinct word shingles.  Two sets link when DEN x intersection >= NUM x union.

Light sets have at most ``boundary`` shingles.  If two light sets share exactly i shingles and link, together they have at most
(DEN - NUM) i / NUM more; so both enumerate their subsets of size i, and a pair that links has one in common.  Every subset is a join key.

Heavy sets scan inverted lists.  All shingles have one order, rarest first; of n shingles the first n - ceil(n NUM / DEN) + 1 are
indexed, and a pair that links has one of them in common.  Light sets large enough to link with a heavy one are indexed too.

The boundary is chosen by cost: what it takes to enumerate the subsets of the sets of a size against the lengths of the lists that they would scan.
Both are summed over all sets of at most LIGHT_MOST shingles.  Rarity and lengths come from a sketch of fixed size over all texts: 2^SKETCH_BITS counters of
shingle hashes; any order of the shingles gives the same links.

Equal sets collapse first to one node, by 128 bits of hash.  Only keys that two nodes share are joined, one of those that have the same nodes; each key's least node is compared with the others, first
under an eighth of the keys, and what is already connected is not compared again, so the links of a group of near copies don't grow with its square.

A node has a bitmap of one or two bits a shingle, the parity of the hashes that fall on each bit.  The bits in which two differ are at most the shingles that
only one has, so candidates that differ in more go without a look at their sets, and no pair is lost.  The sets of those that are left are
read from their texts, and every candidate's exact intersection decides.

Edge cases: null texts and texts without words have an empty set and link with nothing, component_id is their own doc_id; fewer words than a shingle make one
shingle of all; rows without a doc_id take part, their component is its least doc_id that is not null, or null; rows that share a doc_id are rows of
their own; texts of any length are read whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import (
    LOWER_ASCII, WEIGHTS, Sieve, broadcast_if_small, connected_components, gathered, mix64, partitions_of, read_table, runs, slices, span_hashes, utf8, written,
)

WIDTH, NUM, DEN = 4, 85, 100
#: Most shingles of a light set.
LIGHT_MOST = 16
#: Counters of the sketch, and of a piece of it.
SKETCH_BITS, PIECE_BITS = 22, 14
#: Bytes of text that are hashed at once; a longer text is hashed by itself.
SLICE = 1 << 20
#: One in so many keys is joined first, in the first and in the last turns; nodes drawn of each key that is still open.
SOME, DRAWS = 8, 8
_U = np.uint64
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each UTF-8 text, all texts at once."""
    data = b"\n".join(texts).translate(LOWER_ASCII)
    padded = np.frombuffer(data + bytes(8), dtype=np.uint8)
    starts, ends = runs(~BLANK[padded[: len(data)]])
    h, _ = span_hashes(padded, starts, ends)
    cuts = np.searchsorted(starts, np.cumsum([0, *[len(t) + 1 for t in texts]]))
    words = np.diff(cuts)
    n = np.where(words > 0, np.maximum(1, words - width + 1), 0)
    left = np.repeat(cuts[1:], words) - np.arange(len(h))  # words of the text from here on
    total = np.zeros(len(h), dtype=np.uint64)
    for i in range(min(width, len(h))):
        has = left[: len(h) - i] > i
        total[: len(h) - i][has] += h[i:][has] * mix64(WEIGHTS[:1] + _U(i))
    keep = np.arange(len(h)) - np.repeat(cuts[:-1], words) < np.repeat(n, words)
    s = mix64(total[keep])
    at = np.cumsum(n) - n
    return [np.unique(s[a : a + k]) for a, k in zip(at.tolist(), n.tolist())]


def set_hashes(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set."""
    both = np.array([s.sum(dtype=np.uint64) + _U(len(s)), mix64(s ^ WEIGHTS[2]).sum(dtype=np.uint64)], dtype=np.uint64)
    return tuple(mix64(both).view(np.int64).tolist())


def spare(i: int, num: int = NUM, den: int = DEN) -> int:
    """Shingles that two linked sets which share i have besides, at most."""
    return (den - num) * i // num


def prefix_length(n: int, num: int = NUM, den: int = DEN) -> int:
    return n + (-num * n) // den + 1


def removals(n: int, num: int = NUM, den: int = DEN) -> list[int]:
    """How many shingles a light set of n leaves out for the subsets it enumerates."""
    return [d for d in range(n) if d <= spare(n - d, num, den)]


def subset_keys(s: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """Hashes of the enumerated subsets of a set, with their sizes."""
    m, out = mix64(s + WEIGHTS[1]), []
    total = m.sum(dtype=np.uint64)
    for d in removals(len(s), num, den):
        out_of = np.array([m[list(c)].sum(dtype=np.uint64) for c in combinations(range(len(s)), d)], dtype=np.uint64)
        out.append(mix64((total - out_of) * WEIGHTS[3] + _U(len(s) - d)))
    return np.concatenate(out)


def prefix_keys(s: np.ndarray, counts: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """The rarest shingles of a set by the sketch's counts."""
    first = np.lexsort((s, counts[s >> _U(64 - SKETCH_BITS)]))[: prefix_length(len(s), num, den)]
    return mix64(s[first] ^ WEIGHTS[4])


def parity_bits(s: np.ndarray) -> np.ndarray:
    """Bitmap of a set: bit i is the parity of the number of hashes with i as their low bits; a power of two bits, 64 at least."""
    width = max(64, 1 << len(s).bit_length())
    ones = np.bincount((mix64(s ^ WEIGHTS[3]) & _U(width - 1)).view(np.int64), minlength=width) & 1
    return np.packbits(ones.astype(np.uint8), bitorder="little").view(np.uint64)


def bits_apart(a: str, b: str) -> Column:
    """Differing bits of two bitmaps, of which the wider one is folded to the width of the other (twice at most, as sizes that fit do)."""

    def folded(x: str, y: str) -> Column:
        half = lambda c: F.zip_with(F.slice(c, 1, F.size(c) / 2), F.slice(c, F.size(c) / 2 + 1, F.size(c) / 2), lambda u, v: u.bitwiseXOR(v))
        return F.when(F.size(x) > F.size(y), half(F.col(x))).otherwise(F.col(x))

    bits = F.zip_with(folded(a, b), folded(b, a), lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    return F.aggregate(bits, F.lit(0), lambda total, k: total + k)


def most_apart(a: str, b: str, num: int, den: int) -> Column:
    """Shingles that only one of two linked sets of these sizes has, at most."""
    both = F.col(a) + F.col(b)
    return both - 2 * F.ceil(num * both / (num + den) - 1e-9)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.append(0, np.cumsum([len(p) for p in parts], dtype=np.int64)).astype(np.int32)
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _read(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Written rows (id, n, h1, h2, small) and, with ``piece`` set, pieces of the sketch (piece, blob): each text is read once.
    ``small`` is the set itself, of light sets."""
    names = ["id", "n", "h1", "h2", "small", "piece", "blob"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size, seen = np.zeros(1 << SKETCH_BITS, np.uint32), [], 0, set()
        for b in batches:
            texts = utf8(b.column(1))
            for i, j in slices(texts, SLICE):
                sets = shingle_sets(texts[i:j], width)
                hashes = [set_hashes(s) for s in sets]
                small = _lists([s if len(s) <= LIGHT_MOST else s[:0] for s in sets])
                k = len(sets)
                columns = [b.column(0).slice(i, k), pa.array([len(s) for s in sets], pa.int64()), *[pa.array([h[x] for h in hashes], pa.int64()) for x in (0, 1)]]
                yield pa.RecordBatch.from_arrays([*columns, small, pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
                for s, h in zip(sets, hashes):
                    if h not in seen:  # copies within a task count once
                        seen.add(h)
                        held.append(s >> _U(64 - SKETCH_BITS))
                        size += len(s)
                if size > 1 << SKETCH_BITS:
                    counts += np.bincount(np.concatenate(held).view(np.int64), minlength=len(counts)).astype(np.uint32)
                    held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held).view(np.int64), minlength=len(counts)).astype(np.uint32)
        if seen:
            pieces = counts.reshape(-1, 1 << PIECE_BITS)
            some = np.flatnonzero(pieces.any(axis=1))
            pack = zstandard.ZstdCompressor(level=1).compress
            none = pa.nulls(len(some), pa.int64())
            blobs = pa.array([pack(pieces[p].tobytes()) for p in some], pa.binary())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(some), pa.list_(pa.int64())), pa.array(some.astype(np.int32)), blobs], names)

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, n long, h1 long, h2 long, small array<long>, piece int, blob binary"
    return written(src.mapInArrow(run, schema), "jaccard-read")


def sketch_counts(read: DataFrame) -> np.ndarray:
    """The sum of all tasks' sketches: 2^SKETCH_BITS counters, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for piece, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = sums.setdefault(piece, np.zeros(1 << PIECE_BITS, np.uint32))
                more = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint32)
                own += np.minimum(more, ~own)  # full counters stay full
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["piece", "blob"])

    pieces = read.where("piece is not null").select("piece", "blob")
    counts = np.zeros((1 << SKETCH_BITS - PIECE_BITS, 1 << PIECE_BITS), np.uint32)
    for r in pieces.repartition(partitions_of(read.sparkSession), "piece").mapInArrow(run, "piece int, blob binary").collect():
        counts[r.piece] = np.frombuffer(r.blob, np.uint32)
    return counts.reshape(-1)


def row_hashes(rows: DataFrame, width: int) -> DataFrame:
    """(no, h1, h2) of rows (no, text): the hashes of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b.column(1))
            for i, j in slices(texts, SLICE):
                hashes = [set_hashes(s) for s in shingle_sets(texts[i:j], width)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *[pa.array([h[x] for h in hashes], pa.int64()) for x in (0, 1)]], ["no", "h1", "h2"])

    return rows.mapInArrow(run, "no long, h1 long, h2 long")


def choose_boundary(nodes: DataFrame, counts, num: int = NUM, den: int = DEN) -> int:
    """Most shingles of a light set: the boundary of least cost.  A set costs its enumerated subsets if it is light, else its indexed shingles
    and the lengths of their lists (the sketch's counters beyond their mean)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean = float(counts.value.mean())
        for b in batches:
            cost = []
            for s in b.column(1).to_pylist():
                c = np.sort(counts.value[np.array(s, np.int64).view(np.uint64) >> _U(64 - SKETCH_BITS)])[: prefix_length(len(s), num, den)]
                cost.append(float((1 + np.maximum(1, c - mean)).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cost, pa.float64())], ["n", "cost"])

    small = nodes.where(F.col("n") <= LIGHT_MOST).select("n", "small").mapInArrow(run, "n long, cost double")
    by_size = {r.n: (r.k, r.cost) for r in small.groupBy("n").agg(F.count("*").alias("k"), F.sum("cost").alias("cost")).collect()}
    subsets = {n: sum(comb(n, d) for d in removals(n, num, den)) for n in range(1, LIGHT_MOST + 1)}
    light = lambda x: sum(k * subsets[n] for n, (k, _) in by_size.items() if n <= x)
    heavy = lambda x: sum(cost for n, (_, cost) in by_size.items() if n > x)
    return min(range(LIGHT_MOST + 1), key=lambda x: (light(x) + heavy(x), x))


def large_keys(docs: DataFrame, text_col: str, counts, width: int, num: int, den: int, more: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(h1, h2, keys, bits) of the sets too large to be light; copies within a task come once.  ``more`` gives further keys of a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            texts = utf8(b.column(0))
            for i, j in slices(texts, SLICE):
                new = []
                for s in shingle_sets(texts[i:j], width):
                    if len(s) > LIGHT_MOST and (h := set_hashes(s)) not in seen:
                        seen.add(h)
                        keys = prefix_keys(s, counts.value, num, den)
                        new.append((h, np.append(keys, more(s).view(np.uint64)) if more else keys, parity_bits(s)))
                columns = [pa.array([h[x] for h, *_ in new], pa.int64()) for x in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, *[_lists([x[i] for x in new]) for i in (1, 2)]], ["h1", "h2", "keys", "bits"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "h1 long, h2 long, keys array<long>, bits array<long>")


def small_keys(nodes: DataFrame, counts, boundary: int, num: int, den: int) -> DataFrame:
    """(node, n, keys, bits) of the sets small enough to be light: subsets up to the boundary, and prefixes where a heavy set can link."""
    least = -(-num * (boundary + 1) // den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sets = [], [np.array(s, np.int64).view(np.uint64) for s in b.column(2).to_pylist()]
            for s in sets:
                own = [subset_keys(s, num, den)] if len(s) <= boundary else []
                own += [prefix_keys(s, counts.value, num, den)] if len(s) >= least else []
                keys.append(np.concatenate(own))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(keys), _lists([parity_bits(s) for s in sets])], ["node", "n", "keys", "bits"])

    return nodes.where(F.col("n") <= LIGHT_MOST).select("node", "n", "small").mapInArrow(run, "node long, n long, keys array<long>, bits array<long>")


def shared_members(keyed: DataFrame, name: str) -> DataFrame | None:
    """Written (key, node, n) of written (node, n, keys), for keys of two nodes or more, one of those with the same nodes; None if there is none.
    Keys are counted with map-side combination; a bitmap of those that matter sieves the nodes' keys, so few others are shuffled."""
    keyed = keyed.select("node", "n", "keys")
    keys = keyed.select(F.explode("keys").alias("key"), "node").groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    shared = written(keys.where("a <> b").select("key"), name + "-shared")
    if shared.isEmpty():
        return None
    sieve = Sieve(shared, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            hit = sieve(flat)
            row = pa.array(row[hit])
            yield pa.RecordBatch.from_arrays([pa.array(flat[hit]), b.column(0).take(row), b.column(1).take(row)], ["key", "node", "n"])

    # keys that the sieve lets through by chance have one node and go with those of equal nodes
    return one_of_equal(written(keyed.mapInArrow(run, "key long, node long, n long"), name + "-hits"), name + "-members")


def one_of_equal(members: DataFrame, name: str) -> DataFrame:
    """Written ``members`` under one key of those that have the same two nodes or more; the others would give the same pairs.
    Equal sets of nodes agree in their least, their greatest, their number and 128 bits of hash."""
    hashes = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in (0, 1)]
    same = members.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("k"), *hashes).where("a <> b")
    kept = written(same.groupBy("a", "b", "k", "x0", "x1").agg(F.min("key").alias("key")).select("key"), name + "-kept")
    return written(members.join(broadcast_if_small(kept), "key", "left_semi"), name)


def sets_of(docs: DataFrame, text_col: str, wanted: DataFrame, width: int, name: str) -> DataFrame:
    """Written (node, n, v) of ``wanted`` (node, h1, h2, n, small); large sets are read from the texts once more."""
    sieve = Sieve(wanted, "h1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            texts = utf8(b.column(0))
            for i, j in slices(texts, SLICE):
                sets = [s for s in shingle_sets(texts[i:j], width) if len(s) > LIGHT_MOST]
                hashes = np.array([set_hashes(s) for s in sets], np.int64).reshape(-1, 2)
                at = [k for k in np.flatnonzero(sieve(hashes[:, 0].copy())).tolist() if (h := tuple(hashes[k].tolist())) not in seen and not seen.add(h)]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[at, 0]), pa.array(hashes[at, 1]), _lists([sets[k] for k in at])], ["h1", "h2", "s"])

    large = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "h1 long, h2 long, s array<long>").groupBy("h1", "h2").agg(F.min("s").alias("s"))
    large = large.join(broadcast_if_small(wanted.where(F.col("n") > LIGHT_MOST).select("node", "n", "h1", "h2")), ["h1", "h2"]).select("node", "n", "s")
    return written(large.union(wanted.where(F.col("n") <= LIGHT_MOST).select("node", "n", "small")).toDF("node", "n", "v"), name + "-sets")


def link(members: DataFrame, bits: DataFrame, values: DataFrame, good: Column, num: int, den: int, name: str) -> DataFrame | None:
    """Written (node, root) of the nodes that pairs connect which share a key of ``members``, fit in size and whose ``values`` (node, n, v)
    are ``good``, an expression in va, vb, na and nb; None if there are none.  ``bits`` (node, v) are their bitmaps.

    A key's least node (by root) is compared with those of other roots: under one key in SOME, then under all.  Of what is still of different roots under a key,
    DRAWS nodes drawn by a hash are compared with all others, twice; at last all with all, again under one key in SOME, for a pair of many common keys
    would come once for each, and then under all keys.  In these turns bitmaps decide within the join.  Keys of so few nodes that all were
    compared leave.  Components of all links come out, and what is connected isn't compared again."""

    def fits(a: str, b: str):
        return (den * F.least(a, b) >= num * F.greatest(a, b)) & (F.col("root") != F.col("ra"))

    alike = bits_apart("v", "va") <= most_apart("n", "na", num, den)

    def verified(pairs: DataFrame) -> DataFrame:
        one, other = (values.select(*[F.col(c).alias(d + x) for c, d in (("node", ""), ("n", "n"), ("v", "v"))]) for x in "ab")
        pairs = written(gathered(pairs.distinct(), size), name + "-near")
        # only values that are asked for move
        other = other.join(broadcast_if_small(pairs.select("b").distinct()), "b", "left_semi")
        return written(one.join(broadcast_if_small(pairs), "a").join(other, "b").where(good).select("a", "b"), name + "-links")

    comp, left, size = None, members, members.count()
    done = 1  # keys of so many nodes have no pair that is not yet compared
    turns = [("least", True), ("least", False), ("drawn", False), ("drawn", False), ("all", True), ("all", False)]
    for turn, (way, some) in enumerate(turns):
        at = left.where(F.pmod(F.shiftright("key", 20), F.lit(SOME)) == 0) if some else left
        labelled = at.withColumn("root", F.col("node"))
        if comp is not None:
            labelled = at.join(broadcast_if_small(comp), "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
        first = labelled.groupBy("key").agg(F.min(F.struct("root", "node", "n")).alias("x"), F.max("root").alias("top"), F.count("*").alias("k"))
        first = first.where((F.col("x.root") != F.col("top")) & (F.col("k") > done))
        first = written(gathered(first.select("key", F.col("x.root").alias("ra"), F.col("x.node").alias("a"), F.col("x.n").alias("na")), size), name + "-first")
        if first.isEmpty():
            if some:
                continue
            break
        labelled = written(gathered(labelled.join(broadcast_if_small(first.select("key")), "key", "left_semi"), size), name + "-open")
        if not some:  # a key whose nodes have one root, or are all compared, is done for good
            left = labelled.select("key", "node", "n")
            done = max(done, DRAWS if way == "drawn" else 2)
        if way == "least":
            pairs = labelled.join(first, "key").where(fits("n", "na"))
        else:
            if way == "drawn":
                odd = labelled.withColumn("no", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("node", F.lit(turn))))).where(F.col("no") <= DRAWS)
            else:
                odd = labelled.join(first.select("key", F.col("ra").alias("main")), "key").where("root <> main")
            main = F.col("main") if way == "all" else F.col("root")
            # ids are drawn and written; bitmaps come in on the way to the join by key, once for either side
            odd = written(gathered(odd.select("key", main.alias("main"), F.col("root").alias("ra"), F.col("node").alias("a"), F.col("n").alias("na")), size), name + "-odd")
            odd = odd.join(bits.select(F.col("node").alias("a"), F.col("v").alias("va")), "a")
            once = F.lit(True) if way == "drawn" else (F.col("root") == F.col("main")) | (F.col("a") < F.col("node"))
            pairs = labelled.join(bits, "node").join(odd, "key").where(fits("n", "na") & once & alike)
        links = verified(pairs.select("a", F.col("node").alias("b")))
        if links.isEmpty():
            continue
        edges = links if comp is None else links.union(comp.toDF("a", "b"))
        comp = written(connected_components(edges, name + "-parts"), name + "-parts")
    return comp


def jaccard_nodes(
    docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int, name: str, more: Callable[[np.ndarray], np.ndarray] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Written rows (id, n, h1, h2), distinct sets (node, h1, h2, n, low, copies; low is the least id) and components (node, root) of the sets that links
    connect, None if there are no links.  ``more`` gives further keys under which large sets are compared; links are the same without it."""
    read = _read(docs, id_col, text_col, width)
    rows = read.where("piece is null")
    nodes = rows.where("n > 0").groupBy("h1", "h2").agg(F.min("n").alias("n"), F.min("id").alias("low"), F.count("*").alias("copies"), F.min("small").alias("small"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), name + "-nodes")
    counts = docs.sparkSession.sparkContext.broadcast(sketch_counts(read))
    boundary = choose_boundary(nodes, counts, num, den)
    large = large_keys(docs, text_col, counts, width, num, den, more).groupBy("h1", "h2").agg(F.min("keys").alias("keys"), F.min("bits").alias("bits"))
    large = nodes.where(F.col("n") > LIGHT_MOST).select("h1", "h2", "node", "n").join(large, ["h1", "h2"]).select("node", "n", "keys", "bits")
    keyed = written(large.union(small_keys(nodes, counts, boundary, num, den)), name + "-keys")
    members, comp, close = shared_members(keyed, name), None, None
    if members is not None:
        bits = keyed.select("node", "n", F.col("bits").alias("v")).join(broadcast_if_small(members.select("node").distinct()), "node", "left_semi")
        bits = written(bits, name + "-bits")
        close = link(members, bits.select("node", "v"), bits, bits_apart("va", "vb") <= most_apart("na", "nb", num, den), num, den, name + "-close")
    if close is not None:
        wanted = broadcast_if_small(close.select("node"))
        sets = sets_of(docs, text_col, written(nodes.join(wanted, "node", "left_semi"), name + "-wanted"), width, name)
        common = F.size(F.array_intersect("va", "vb"))
        exact = den * common >= num * (F.col("na") + F.col("nb") - common)
        comp = link(one_of_equal(members.join(wanted, "node", "left_semi"), name + "-asked"), bits.select("node", "v"), sets, exact, num, den, name)
    return rows.select("id", "n", "h1", "h2"), nodes.drop("small"), comp


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """(id, n, component_id) per row."""
    name = "jaccard"
    rows, nodes, comp = jaccard_nodes(docs, id_col, text_col, width, num, den, name)
    grouped = nodes.select("h1", "h2", "node", "low", "copies")
    if comp is None:
        labels = grouped.where("copies > 1").select("h1", "h2", F.col("low").alias("component_id"))
    else:
        linked = written(grouped.join(broadcast_if_small(comp), "node", "left"), name + "-linked").where("copies > 1 or root is not null")
        least = written(linked.where("root is not null").groupBy("root").agg(F.min("low").alias("least")), name + "-least")
        labels = linked.join(broadcast_if_small(least), "root", "left").select("h1", "h2", F.when(F.col("root").isNull(), F.col("low")).otherwise(F.col("least")).alias("component_id"))
    labels = written(labels.withColumn("known", F.lit(1)), name + "-labels")
    out = rows.join(broadcast_if_small(labels), ["h1", "h2"], "left")
    # an empty set has the hash of no node
    return out.select("id", "n", F.when(F.col("known").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_components(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


ORACLE = {
    "op13_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))) END AS g FROM d
), k AS (
  SELECT *, CASE WHEN len(g) > 0 THEN sha256(array_to_string(g, chr(10))) END AS node FROM s
), nodes AS (
  SELECT node, min(doc_id) AS low, any_value(g) AS g, len(any_value(g)) AS n FROM k WHERE node IS NOT NULL GROUP BY node
), t AS (
  SELECT node, n, unnest(g) AS g FROM nodes
), links AS (
  SELECT a.node AS a, b.node AS b FROM t a JOIN t b ON a.g = b.g AND a.node <> b.node
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least_of AS (
  SELECT n.node, least(min(n.low), min(m.low)) AS low FROM nodes n LEFT JOIN reach ON reach.a = n.node LEFT JOIN nodes m ON m.node = reach.b GROUP BY n.node
)
SELECT doc_id, len(g) AS n_shingles, CASE WHEN node IS NULL THEN doc_id ELSE low END AS component_id FROM k LEFT JOIN least_of USING (node)
"""
}

QUERIES = {"op13_jaccard_join": op13_jaccard_join}
