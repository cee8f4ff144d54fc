"""SimHash near-duplicates with pigeonring filtering.

``simhash`` gives each text a 64-bit fingerprint; ``pigeonring_classes`` connects
fingerprints that differ in at most TAU bits; ``simhash_components`` labels each row.

Pigeonring (Qin and Xiao, 2018): cut the 64 bits into a ring of SEGMENTS segments.  If two
fingerprints differ in TAU bits in all, some segment starts a chain in which the first
l segments together hold at most floor(l * TAU / SEGMENTS) differences, for every l.  With
TAU = 4 and five segments these budgets are 0, 1, 2, 3, 4.  So the first segment of the chain
is equal, one of the two halves of the second is equal (at most one difference) and one of
the three thirds of the third is equal (at most two): that gives 5 x 2 x 3 join keys of about
24 bits.  A pair that meets in a key must then pass the budgets of the longer chains
before its full distance is taken.  No component can be lost.

Keys are counted first; only fingerprints whose key is shared (a bitmap tells) are joined.  In a key, fingerprints are compared
as ``connect_nodes`` says, so the links of a group of near copies do not grow with its square.

``dedup_simhash`` is for whole corpora: texts link at an exact Jaccard likeness of LIKE or more of their sets of DEDUP_WIDTH-word shingles.  Candidates
come from the pigeonring keys of RINGS fingerprints of 64 bits, made of the distinct shingles.  At that likeness fingerprints differ in far more than four bits and
the keys find a pair by chance only, so the exact key family of ``jaccard`` (subsets of small sets, rarest shingles of large ones) is added: no
link is missed.  Every link is checked against the sets themselves.

Edge cases: null texts and texts without words have fingerprint 0 and link like any other;
fewer words than the shingle width make one shingle of the whole sequence; rows with a
null id get a fingerprint and the component's smallest non-null id (null if there is none);
repeated rows stay repeated rows; texts of any length are read whole; an empty table gives an empty result; extra columns
of the input are ignored by the query and kept by ``dedup_simhash``.

Exact copies collapse to one fingerprint before any pairing, so a group of copies that
holds a third of all rows adds one row to the join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_ASCII, Sieve, broadcast_if_small, connected_components, mix64, read_table, utf8, written
from .jaccard import jaccard_nodes, row_hashes

TAU = 4
#: (first bit, bits) of the five segments.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Shingle hashes taken at once when bits are counted, so that long texts need little memory.
BLOCK = 1 << 15
#: ``dedup_simhash``: words of a shingle, fingerprints, least Jaccard likeness in hundredths.
DEDUP_WIDTH, RINGS, LIKE = 5, 2, (80, 100)
#: Low bits of a key that hold its number.
KEY_BITS = 7
#: Keys, all of one segment of one fingerprint, under which nodes are compared first.
FIRST_KEYS = 6


def fingerprint(text: bytes, width: int = 4) -> int:
    """Signed 64-bit SimHash over the word shingles (repeats included) of a UTF-8 text."""
    words = text.translate(LOWER_ASCII).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    n = max(1, len(words) - width + 1)
    stops = ends[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        h = np.array([digest(joined[s : e - 1], 42) for s, e in zip(starts[at : min(n, at + BLOCK)], stops[at : at + BLOCK])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, width) for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _mask(first: int, bits: int) -> int:
    return ((1 << bits) - 1) << first


def _cut(first: int, bits: int, parts: int) -> list[int]:
    edges = [first + bits * i // parts for i in range(parts + 1)]
    return [_mask(a, b - a) for a, b in zip(edges, edges[1:])]


def _keys() -> list[tuple[int, list[int]]]:
    """(mask of the join key, masks of the chain prefixes of 2, 3 and 4 segments)."""
    out = []
    for i in range(len(SEGMENTS)):
        ring = [SEGMENTS[(i + j) % len(SEGMENTS)] for j in range(len(SEGMENTS))]
        whole = [_mask(*s) for s in ring]
        chains = [whole[0] | whole[1], whole[0] | whole[1] | whole[2], whole[0] | whole[1] | whole[2] | whole[3]]
        for half in _cut(*ring[1], 2):
            for third in _cut(*ring[2], 3):
                out.append((whole[0] | half | third, chains))
    return out


KEYS = _keys()
_MASKS = np.array([m for m, _ in KEYS], dtype=np.uint64)


def _key_columns(fps: np.ndarray) -> np.ndarray:
    """(n, rings) unsigned fingerprints -> (n, rings x 30) keys; the low KEY_BITS are the number of the key."""
    cut = fps[:, :, None] & _MASKS
    no = np.arange(cut.shape[1] * len(_MASKS), dtype=np.uint64)
    flat = cut.reshape(len(fps), -1) + mix64(no + np.uint64(1))
    return (mix64(flat) & ~np.uint64((1 << KEY_BITS) - 1) | no).view(np.int64)


def _keys_of(b: pa.RecordBatch, few: bool) -> np.ndarray:
    """(rows, keys) of a batch (node, value, root)."""
    rings = len(b.column(1)[0])
    flat = b.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, rings)
    keys = _key_columns(flat)
    return keys[:, :FIRST_KEYS] if few else keys


def open_members(nodes: DataFrame, name: str, few: bool) -> DataFrame | None:
    """Written (key, node, value, root) of written ``nodes`` (node, value array<long>, root), for the keys (``few``: the first ones only) that nodes
    of different roots share; None if there is no such key.  Keys are counted with map-side combination, and a bitmap of those that
    matter sieves the nodes' keys; what it lets through by chance has one root."""

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                keys = _keys_of(part, few)
                root = np.repeat(part.column(2).to_numpy(zero_copy_only=False), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(root)], ["key", "root"])

    counted = nodes.mapInArrow(every, "key long, root long").groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"))
    shared = written(counted.where("a <> b").select("key"), name + "-keys")
    if shared.isEmpty():
        return None
    sieve = Sieve(shared, "key")

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                keys = _keys_of(part, few)
                row, col = np.nonzero(sieve(keys))
                chosen = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(keys[row, col]), *chosen.columns], ["key", "node", "value", "root"])

    return written(nodes.mapInArrow(some, "key long, node long, value array<long>, root long"), name + "-members")


def connect_nodes(nodes: DataFrame, near: Callable[[Column, Column], Column], name: str, verify: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Written (node, root) of all nodes that pairs connect which share a key, are ``near`` and count for ``verify``.

    First under a few of the keys, then under all, each key's least node (by root) is compared with those of other roots; then all that
    is still of different roots under a key.  Only keys with nodes of different roots take part, so a group of near copies is
    compared a few times a member and no component is lost."""
    plain = nodes.select("node", "value")
    labelled, comp = written(plain.withColumn("root", F.col("node")), name + "-nodes"), None
    for turn, few in enumerate((True, False, False)):
        members = open_members(labelled, name, few)
        if members is None:
            if few:
                continue
            break
        first = members.groupBy("key").agg(F.min(F.struct("root", "node", "value")).alias("x"), F.max("root").alias("top")).where("x.root <> top")
        first = written(first.select("key", F.col("x.root").alias("main"), F.col("x.node").alias("a"), F.col("x.value").alias("va")), name + "-first")
        if turn < 2:
            pairs = members.join(first, "key").where((F.col("root") != F.col("main")) & near(F.col("va"), F.col("value"))).select("a", F.col("node").alias("b"))
        else:
            odd = members.join(first.select("key", "main"), "key").where("root <> main")
            odd = written(odd.select("key", "main", F.col("node").alias("a"), F.col("value").alias("va"), F.col("root").alias("ra")), name + "-odd")
            apart = (F.col("ra") != F.col("root")) & ((F.col("root") == F.col("main")) | (F.col("a") < F.col("node")))
            pairs = odd.join(members, "key").where(apart & near(F.col("va"), F.col("value"))).select("a", F.col("node").alias("b"))
        links = written(pairs.distinct(), name + "-links")
        links = written(verify(links), name + "-links") if verify and not links.isEmpty() else links
        if links.isEmpty():
            continue
        edges = links if comp is None else links.union(comp.toDF("a", "b"))
        comp = written(connected_components(edges, name + "-parts"), name + "-parts")
        if turn < 2:
            labelled = plain.join(broadcast_if_small(comp), "node", "left").select("node", "value", F.coalesce("root", "node").alias("root"))
            labelled = written(labelled, name + "-nodes")
    return nodes.select("node", F.col("node").alias("root")).where("false") if comp is None else comp


def _distance(a: Column, b: Column, rings: int) -> Column:
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(rings)), F.lit(0))


def _near(tau: int, rings: int) -> Callable[[Column, Column], Column]:
    """Chains of 2, 3 and 4 segments from the key's start within their budgets, then the full distance."""
    chains = [F.array(*[F.lit(_signed(c[j])) for _ in range(rings) for _, c in KEYS]) for j in range(3)]
    budgets = [length * tau // len(SEGMENTS) for length in (2, 3, 4)]

    def near(a: Column, b: Column) -> Column:
        no = F.col("key").bitwiseAND((1 << KEY_BITS) - 1).cast("int")
        ring = F.floor(no / len(KEYS)).cast("int")
        diff = F.get(a, ring).bitwiseXOR(F.get(b, ring))
        viable = F.lit(True)
        for budget, chain in zip(budgets, chains):
            viable = viable & (F.bit_count(diff.bitwiseAND(F.get(chain, no))) <= budget)
        return viable & (_distance(a, b, rings) <= tau)

    return near


def pigeonring_classes(fps: DataFrame) -> DataFrame:
    """Distinct ``fp`` longs -> written (node, root) of those that pairs at TAU or fewer differing bits connect."""
    nodes = written(fps.select(F.col("fp").alias("node"), F.array("fp").alias("value")), "simhash-single")
    return connect_nodes(nodes, _near(TAU, 1), "simhash")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp, component_id) per row."""
    rows = written(simhash(docs, id_col, text_col, width), "simhash-rows")
    nodes = written(rows.groupBy("fp").agg(F.min("id").alias("low")), "simhash-nodes")
    return _labelled(rows, nodes, pigeonring_classes(nodes.select("fp")), "fp")


def _labelled(rows: DataFrame, nodes: DataFrame, comp: DataFrame, node: str) -> DataFrame:
    """``rows`` with component_id, the least ``low`` of the nodes of a component (node, root)."""
    comp = comp.withColumnRenamed("node", node)
    linked = nodes.join(broadcast_if_small(comp), node)
    low = written(linked.groupBy("root").agg(F.min("low").alias("component_id")), "simhash-low")
    labels = written(nodes.join(broadcast_if_small(comp), node, "left").select(node, "root", "low"), "simhash-labels")
    labels = labels.join(broadcast_if_small(low), "root", "left").select(node, F.when(F.col("root").isNull(), F.col("low")).otherwise(F.col("component_id")).alias("component_id"))
    return rows.join(written(labels, "simhash-labels"), node).select("id", node, "component_id")


def op10_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(read_table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def ring_keys(s: np.ndarray) -> np.ndarray:
    """Pigeonring keys of RINGS SimHash fingerprints over the distinct shingle hashes of a text."""
    fps = np.zeros((1, RINGS), dtype=np.uint64)
    for r in range(RINGS):
        votes = np.zeros(64, dtype=np.int64)
        for k in range(0, len(s), BLOCK):
            mixed = mix64(s[k : k + BLOCK] ^ mix64(np.array([r + 101], dtype=np.uint64)))
            votes += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        fps[0, r] = np.packbits(2 * votes > len(s), bitorder="little").view("<u8")[0]
    return _key_columns(fps)[0]


def dedup_simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, with its own columns: the row of the least id (rows without one come last), then of the
    least hash of its shingles and of its text.  Rows are decided one by one, also where they share an id.

    What most rows need is known by their id: ids of one row that go, and ids no row of which is in a group.  Only rows that share an id
    and have a near copy are set aside, written and hashed again.  The rows to drop are the small side of the join."""
    name = "dedup"
    rows, nodes, comp = jaccard_nodes(docs, id_col, text_col, DEDUP_WIDTH, *LIKE, name, ring_keys)
    none = nodes.select("h1", "h2", F.col("node").alias("root")).where("false")
    roots = none if comp is None else nodes.join(broadcast_if_small(comp), "node").select("h1", "h2", "root")
    roots = broadcast_if_small(written(roots, name + "-roots"))
    # a group is a component, or all rows of a set that is in none
    group = F.when(F.col("root").isNull(), F.struct(F.lit(-1).cast("long").alias("root"), "h1", "h2")).otherwise(F.struct("root", F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2")))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "h1", "h2")
    placed = rows.join(roots, ["h1", "h2"], "left").withColumn("group", group)
    several = placed.groupBy("group").agg(F.count("*").alias("k"), F.min(order).alias("best")).where("k > 1")
    several = written(several.select("group", "best"), name + "-groups")
    member = written(placed.join(broadcast_if_small(several), "group").select("group", "id", "best", (order == F.col("best")).alias("stays")), name + "-members")
    ids = broadcast_if_small(written(member.select("id").distinct(), name + "-ids"))
    shared = rows.join(ids, rows["id"].eqNullSafe(ids["id"]), "left_semi").groupBy("id").agg(F.count("*").alias("k")).where("k > 1 or id is null")
    shared = written(shared.select("id"), name + "-shared")
    drop = member.where("not stays and id is not null").select("id").union(shared.where("id is not null")).distinct()
    drop = broadcast_if_small(written(drop, name + "-drop")).withColumnRenamed("id", id_col)
    kept = docs.join(drop, id_col, "left_anti").select(docs.columns)
    if shared.isEmpty():
        return kept
    lone = not shared.where("id is null").isEmpty()
    if lone:
        kept = kept.where(F.col(id_col).isNotNull())
    # the rows in question, each with a number of its own
    held = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    held = held.join(broadcast_if_small(shared.where("id is not null")), "id", "left_semi").union(held.where("id is null" if lone else "false").select("id", "row", "text"))
    held = written(held.withColumn("no", F.monotonically_increasing_id()), name + "-held")
    marks = row_hashes(held.select("no", "text"), DEDUP_WIDTH).join(held.select("no", "id", F.xxhash64("text").alias("t")), "no")
    marks = written(marks.join(roots, ["h1", "h2"], "left").withColumn("group", group).withColumn("order", order), name + "-marks")
    first = marks.join(broadcast_if_small(several), "group").where("order = best").groupBy("group").agg(F.min(F.struct("t", "no")).alias("x")).select("x.no")
    alone = marks.join(broadcast_if_small(several), "group", "left_anti").select("no")
    stay = broadcast_if_small(written(first.union(alone), name + "-stay"))
    return kept.unionByName(held.join(stay, "no", "left_semi").select("row.*"))


QUERIES = {"op10_simhash_pigeonring": op10_simhash_pigeonring}
