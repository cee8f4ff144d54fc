"""Merkle manifest of a dataset with octopus multiproofs.

``manifest`` makes every row a leaf and builds one tree per value of the tree column, and a tree over their subroots.
Two neighbours become their hash; a last lone node is hashed alone; levels end when one node is left.

Leaves are placed along range partitions (tree, order columns, leaf) and their offsets, so no task orders a tree as a whole.  A block
of 2^LEVELS neighbouring nodes derives its LEVELS levels in one task; the roots of the blocks are the next round's nodes.

``proofs`` is the octopus multiproof: each leaf partition (2^PART neighbouring places) walks up from the leaves it is asked for and notes
the least set of coordinates that it can't derive from them, siblings of nodes that are neither its own nor above its own.  All
partitions' coordinates are looked up in one join; then each partition derives the shared interiors and expands one proof per leaf.

Edge cases: null columns are ``-`` in a leaf; rows without a doc_id come first in their tree; rows that share it are ordered by leaf, equal rows
stand side by side and have the same leaf and different proofs; a null tree value is a tree of its own, before all others; a tree of one
leaf has that leaf as subroot; texts of any length are hashed whole, in the JVM; an empty table has no leaves, no root and an empty
result; extra columns are not hashed.  A row without a doc_id or n_chars is not tampered with.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, partitions_of, read_table, written

#: Columns of a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that a task derives at once, and binary logarithm of the places of a leaf partition.
LEVELS = PART = 12
#: Name of the tree of subroots; those of the values start with "=", that of null is empty.
TOP = "~"
#: Rows of a range partition: about the least, and the most.
FEW, MANY = 5_000, 500_000


def _h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(**changed: Column) -> Column:
    """Leaf of a row, with other values for some of its columns."""
    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]).cast("binary"), 256)


@dataclass
class Manifest:
    """``leaves``: the rows with tree, pos, n (leaves of the tree), h; ``nodes``: (tree, level, idx, h) of all levels;
    ``subroots``: (child, pos, n, h), the leaves of the tree of subroots; ``root`` None for an empty table."""

    leaves: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    root: str | None


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Written ``rows`` (with ``tree``, not null) and their place ``pos`` in their tree by the order columns, nulls first, and the tree's size ``n``."""
    keys = ["tree", *order, "_tie"]
    rows = written(rows.withColumn("_tie", F.monotonically_increasing_id()), name)
    count = rows.count()
    parts = max(1, min(-(-count // FEW), max(partitions_of(rows.sparkSession), -(-count // MANY))))
    ranged = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ranged = written(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.spark_partition_id()), name)
    # a row per range and tree in it
    sums = ranged.groupBy("tree", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_k"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("tree", "_range", (F.coalesce(F.sum("_k").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_k").over(tree).alias("n"))
    out = ranged.join(broadcast_if_small(written(starts, name)), ["tree", "_range"])
    return written(out.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_tie", "_at", "_range", "_shift"), name)


def _interiors(block: pa.Table, levels: int) -> pa.Table:
    """Up to ``levels`` levels above neighbouring nodes (tree, level, idx, n, h)."""
    at = np.argsort(block["idx"].to_numpy())
    h = block["h"].take(pa.array(at)).to_pylist()
    tree, level, n, first = block["tree"][0].as_py(), block["level"][0].as_py(), block["n"][0].as_py(), int(block["idx"].to_numpy().min())
    out = {"tree": [], "level": [], "idx": [], "n": [], "h": []}
    for step in range(1, levels + 1):
        if n == 1:
            break
        h = [_h("".join(h[i : i + 2])) for i in range(0, len(h), 2)]
        n, first = (n + 1) // 2, first // 2
        out["tree"] += [tree] * len(h)
        out["level"] += [level + step] * len(h)
        out["idx"] += range(first, first + len(h))
        out["n"] += [n] * len(h)
        out["h"] += h
    return pa.table(out, schema=pa.schema([("tree", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("n", pa.int64()), ("h", pa.string())]))


def _grown(bottom: DataFrame, name: str) -> DataFrame:
    """All levels (tree, level, idx, n, h) from written level 0 of some trees."""
    at = all_levels = bottom.select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), "n", "h")
    top = levels = LEVELS
    while not at.where("n > 1").isEmpty():
        block = F.shiftright("idx", levels).alias("block")
        made = at.where("n > 1").groupBy("tree", block).applyInArrow(lambda b: _interiors(b, levels), "tree string, level int, idx long, n long, h string")
        made = written(made, name)
        all_levels = all_levels.union(made)
        at, top = made.where(F.col("level") == top), top + levels
    return all_levels


def manifest(rows: DataFrame, order: list[str]) -> Manifest:
    """``rows`` have ``tree`` and the leaf ``h``; ``order`` names the columns that order the leaves of a tree before ``h`` does."""
    leaves = placed(rows, [*order, "h"], "merkle-leaves")
    low = _grown(leaves, "merkle-nodes")
    subroots = placed(low.where("n = 1").select(F.lit(TOP).alias("tree"), F.col("tree").alias("child"), "h"), ["child"], "merkle-subroots")
    high = _grown(subroots, "merkle-top")
    root = high.where("n = 1").select("h").first()
    return Manifest(leaves, low.union(high).drop("n"), subroots, root and root.h)


def octopus(known: np.ndarray, n: int) -> list[np.ndarray]:
    """Per level, the places of the nodes that can't be derived from the ascending places ``known`` among n leaves, but are needed for the root."""
    out = []
    while n > 1:
        beside = known ^ 1
        beside = beside[beside < n]
        out.append(np.setdiff1d(beside, known, assume_unique=True))
        known, n = np.unique(known >> 1), (n + 1) // 2
    return out


def _missing(part: pa.Table) -> pa.Table:
    """Coordinates (of, level, idx) that a leaf partition lacks, in its tree and in that of the subroots."""
    tree, at = part["tree"][0].as_py(), part["part"][0].as_py()
    own = octopus(np.unique(part["pos"].to_numpy()), part["n"][0].as_py())
    above = octopus(part["top_pos"].to_numpy()[:1], part["top_n"][0].as_py())
    rows = [(of, level, int(i)) for of, levels in ((tree, own), (TOP, above)) for level, places in enumerate(levels) for i in places]
    of, level, idx = map(list, zip(*rows)) if rows else ([], [], [])
    schema = pa.schema([("tree", pa.string()), ("part", pa.int64()), ("of", pa.string()), ("level", pa.int32()), ("idx", pa.int64())])
    return pa.table([[tree] * len(of), [at] * len(of), of, level, idx], schema=schema)


def _derived(path: dict[int, str], fetched: dict[tuple[int, int], str], n: int) -> list[tuple[int, dict[int, str]]]:
    """Per level its size and the hashes known there, from some leaves and what was fetched."""
    out, level = [], 0
    while n > 1:
        known = path | {i: h for (at, i), h in fetched.items() if at == level}
        out.append((n, known))
        path = {p: _h(known[2 * p] + (known[2 * p + 1] if 2 * p + 1 < n else "")) for p in {i >> 1 for i in path}}
        n, level = (n + 1) // 2, level + 1
    return out


def _folded(h: str, pos: int, levels: list[tuple[int, dict[int, str]]], siblings: list[str]) -> str:
    """The node above all ``levels`` that ``h`` at ``pos`` leads to; ``siblings`` takes up those of the path."""
    for n, known in levels:
        beside = pos ^ 1
        if beside >= n:
            h = _h(h)
        else:
            s = known[beside]
            siblings.append(s)
            h = _h(s + h if pos & 1 else h + s)
        pos >>= 1
    return h


def proofs(m: Manifest, asked: DataFrame, id_col: str) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of the rows ``asked`` of ``m.leaves`` with ``claim``, the leaf whose
    place in the tree is to be verified."""
    sub = m.subroots.select(F.col("child").alias("tree"), F.col("pos").alias("top_pos"), F.col("n").alias("top_n"), F.col("h").alias("subroot"))
    asked = asked.select("tree", "pos", "n", "h", "claim", F.col(id_col).alias("id"), F.shiftright("pos", PART).alias("part"))
    asked = written(asked.join(broadcast_if_small(sub), "tree"), "merkle-asked")
    lacking = "tree string, part long, of string, level int, idx long"
    missing = written(asked.select("tree", "part", "pos", "n", "top_pos", "top_n").groupBy("tree", "part").applyInArrow(_missing, lacking), "merkle-missing")
    levels = [r.level for r in missing.select("level").distinct().collect()]  # as many as the trees are high
    nodes = m.nodes.where(F.col("level").isin(levels)).withColumnRenamed("tree", "of")
    fetched = nodes.join(broadcast_if_small(missing), ["of", "level", "idx"]).select("tree", "part", "of", "level", "idx", "h")
    root = m.root

    def expand(leaves: pa.Table, found: pa.Table) -> pa.Table:
        got: dict[bool, dict[tuple[int, int], str]] = {False: {}, True: {}}
        for of, level, idx, h in zip(*[found[c].to_pylist() for c in ("of", "level", "idx", "h")]):
            got[of == TOP][level, idx] = h
        first = {c: leaves[c][0].as_py() for c in ("n", "top_pos", "top_n", "subroot")}
        pos, h = leaves["pos"].to_pylist(), leaves["h"].to_pylist()
        own = _derived(dict(zip(pos, h)), got[False], first["n"])
        above = _derived({first["top_pos"]: first["subroot"]}, got[True], first["top_n"])
        proof, folded = [], []
        for p, claim in zip(pos, leaves["claim"].to_pylist()):
            siblings: list[str] = []
            folded.append(_folded(_folded(claim, p, own, siblings), first["top_pos"], above, siblings))
            proof.append(_h("".join(siblings)))
        k = len(pos)
        return pa.table(
            [leaves["id"], leaves["h"], leaves["subroot"], pa.array([root] * k), pa.array(proof), pa.array(folded), pa.array([f == root for f in folded])],
            names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
        )

    texts = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    schema = T.StructType([T.StructField("id", asked.schema["id"].dataType), *[T.StructField(c, T.StringType()) for c in texts], T.StructField("verified", T.BooleanType())])
    return asked.groupBy("tree", "part").cogroup(fetched.groupBy("tree", "part")).applyInArrow(expand, schema)


def document_leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, tree, h, claim) per row: one tree per lang; ``claim`` is the leaf of the row as tampered with."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    more = F.try_add(F.col("n_chars").cast("long"), F.lit(1))
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    return docs.select(F.col("doc_id"), tree.alias("tree"), leaf_hash().alias("h"), F.when(hit, leaf_hash(n_chars=more)).otherwise(leaf_hash()).alias("claim"))


def op11_merkle_multiproof(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(document_leaves(read_table(spark, sf_dir, "documents")), ["doc_id"])
    return proofs(m, m.leaves, "doc_id").withColumnRenamed("id", "doc_id")


def _sql_field(x: str) -> str:
    return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"


ORACLE = {
    "op11_merkle_multiproof": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, n_chars, {_sql_field("doc_id")} || {_sql_field("source")} || {_sql_field("lang")} AS head, {_sql_field("text")} AS tail,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1))))) AS crc
  FROM documents
), l AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256(head || {_sql_field("n_chars")} || tail) AS leaf,
         sha256(head || {_sql_field("(n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END)")} || tail) AS claim
  FROM d
), p AS (
  SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS rid,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM l
), low(tree, level, idx, n, h) AS (
  SELECT tree, 0, pos, n, leaf FROM p
  UNION ALL
  SELECT tree, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY tree, level, idx // 2, n
), sub AS (
  SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1
), top(level, idx, n, h) AS (
  SELECT 0, pos, n, h FROM sub
  UNION ALL
  SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY level, idx // 2, n
), steps AS (
  SELECT rid, v.level AS step, (pos >> v.level) & 1 AS odd, s.h AS sib
  FROM p JOIN (SELECT DISTINCT tree, level FROM low WHERE n > 1) v USING (tree)
  LEFT JOIN low s ON s.tree = p.tree AND s.level = v.level AND s.idx = xor(p.pos >> v.level, 1)
  UNION ALL
  SELECT rid, (SELECT count(DISTINCT level) FROM low WHERE n > 1 AND low.tree = p.tree) + v.level, (sub.pos >> v.level) & 1, s.h
  FROM p JOIN sub USING (tree), (SELECT DISTINCT level FROM top WHERE n > 1) v
  LEFT JOIN top s ON s.level = v.level AND s.idx = xor(sub.pos >> v.level, 1)
), fold(rid, step, h) AS (
  SELECT rid, 0, claim FROM p
  UNION ALL
  SELECT rid, step + 1, sha256(CASE WHEN sib IS NULL THEN h WHEN odd = 1 THEN sib || h ELSE h || sib END) FROM fold JOIN steps USING (rid, step)
), ends AS (
  SELECT rid, arg_max(h, step) AS folded_root FROM fold GROUP BY rid
), proof AS (
  SELECT rid, sha256(coalesce(string_agg(sib, '' ORDER BY step), '')) AS proof_sha256 FROM steps GROUP BY rid
)
SELECT doc_id, leaf, sub.h AS subroot, top.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = top.h AS verified
FROM p JOIN sub USING (tree) JOIN top ON top.n = 1 JOIN ends USING (rid) LEFT JOIN proof USING (rid)
"""
}

QUERIES = {"op11_merkle_multiproof": op11_merkle_multiproof}
