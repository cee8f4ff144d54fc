"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of words with smallest period q (words q apart are identical), at least max(LEAST, TIMES x q) words long, that
no neighbouring word extends.  ``periodic_runs`` finds every run of every text, and the text with each run collapsed to its first q words.

Periods up to SHORT are found by lag scans: the text is compared with itself q words on.  Beyond, scale s is for periods in (g/2, g], g = 2^s.
Hashes of g words come by doubling from those of g/2 words; of every g/2 neighbouring ones the least is a minimizer.  In a run
of that scale some window and the same one q words on lie inside, so their minima are equal and q apart; as a root of q words
is no power of a shorter one, no equal hash lies between.  So each minimizer is paired with the next equal one alone, and pairs at a distance of the
scale are seeds.  A seed is extended both ways by comparing words; what is too short or has a shorter period is no run.  Hashes only
propose, words decide.  Work is a few passes over the words per scale, and texts too short for a scale leave it.

Texts are taken in slices of about SLICE bytes, so memory is bounded by a slice or the longest text.  There is no shuffle.

Edge cases: null and wordless texts have no runs and an empty collapsed text; repeated rows are repeated rows; a null id passes through; texts of
any length are read whole; overlapping runs are all given, and a word goes if any run drops it; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WEIGHTS, mix64, read_table, runs, slices, utf8

#: Least words of a run, and least length in periods.
LEAST, TIMES = 6, 4
#: Binary logarithm of the longest period that is found by lag scans.
SHORT = 3
SLICE = 1 << 20
_SCHEMA = "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _primitive(ids: np.ndarray, start: int, q: int) -> bool:
    """No divisor of q is a period of the stretch of period q at ``start``."""
    rest, r = q, 2
    while rest > 1:
        r = r if r * r <= rest else rest
        if rest % r == 0:
            if (ids[start : start + q] == ids[start + q // r : start + q // r + q]).all():
                return False
            while rest % r == 0:
                rest //= r
        r += 1
    return True


def _agree(ids: np.ndarray, at: int, q: int, step: int) -> int:
    """How many places from ``at`` on (``step`` 1) or before it (-1) hold the word that stands q later."""
    done, size = 0, 64
    while True:
        if step > 0:
            here = ids[at + done : min(at + done + size, len(ids) - q)]
            same = here == ids[at + done + q : at + done + q + len(here)]
        else:
            low = max(0, at - done - size)
            same = (ids[low : at - done] == ids[low + q : at - done + q])[::-1]
        if not len(same):
            return done
        if not same.all():
            return done + int(same.argmin())
        done, size = done + len(same), 2 * size


def _seeds(ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(scale's g, places, distances) of equal neighbouring minimizers, per scale."""
    hashes = mix64(ids.view(np.uint64) * WEIGHTS[0] + WEIGHTS[1])
    place = np.arange(len(ids))
    g = 1
    later = lambda x, k, fill: np.append(x[k:], np.full(min(k, len(x)), fill, np.uint64))
    while True:
        hashes, g = mix64(hashes * WEIGHTS[0] + later(hashes, g, 0)), 2 * g
        if g > 1 << SHORT:
            large = sizes >= TIMES * (g // 2 + 1)
            if not large.any():
                return
            if not large.all():  # the separator after a text goes with it
                inside = np.repeat(large, sizes + 1)
                hashes, place = hashes[inside], place[inside]
                sizes = sizes[large]
            least, most, w = hashes, None, 1
            while w < g // 2:
                least, w = np.minimum(least, later(least, w, ~np.uint64(0))), 2 * w
            most, w = least.copy(), 1
            while w < g // 2:
                most[w:], w = np.maximum(most[w:], most[:-w]), 2 * w
            chosen = np.flatnonzero(most == hashes)
            order = chosen[np.argsort(hashes[chosen], kind="stable")]
            apart = place[order[1:]] - place[order[:-1]]
            seed = (hashes[order[1:]] == hashes[order[:-1]]) & (apart > g // 2) & (apart <= g)
            yield g, place[order[:-1][seed]], apart[seed]


def find_runs(ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of texts that stand one after another in ``ids``, each followed by an id of its own."""
    out = []
    for q in range(1, (1 << SHORT) + 1):
        if len(ids) > q:
            first, last = runs(ids[q:] == ids[:-q])
            long = last - first + q >= max(LEAST, TIMES * q)
            out += [(s, e - s + q, q) for s, e in zip(first[long].tolist(), last[long].tolist()) if _primitive(ids, s, q)]
    for _, places, apart in _seeds(ids, begins, sizes):
        order = np.lexsort((places, apart))
        done = (0, -1)  # period, and the end of the places that a stretch of it explains
        for m, q in zip(places[order].tolist(), apart[order].tolist()):
            if done[0] == q and m < done[1]:
                continue
            start, end = m - _agree(ids, m, q, -1), m + _agree(ids, m, q, 1)
            done = (q, end)
            if end + q - start >= max(LEAST, TIMES * q) and _primitive(ids, start, q):
                out.append((start, end + q - start, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def text_runs(texts: list[bytes]) -> list[tuple[list[bytes], list[tuple[int, int, int]], bytes]]:
    """(words, runs, collapsed text) of each text."""
    lists = [t.split() for t in texts]
    number = defaultdict(count().__next__)
    sizes = np.array([len(w) for w in lists], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    ids = np.full(int((sizes + 1).sum()), -1, np.int64)
    for i, (b, w) in enumerate(zip(begins.tolist(), lists)):
        ids[b : b + len(w)] = np.fromiter(map(number.__getitem__, w), np.int64, len(w))
        ids[b + len(w)] = -1 - i
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in find_runs(ids, begins, sizes):
        i = int(np.searchsorted(begins, start, side="right")) - 1
        found[i].append((start - int(begins[i]), length, period))
    out = []
    for words, some in zip(lists, found):
        keep = np.ones(len(words), bool)
        for start, length, period in some:
            keep[start + period : start + length] = False
        out.append((words, some, b" ".join(compress(words, keep.tolist()) if some else words)))
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs ordered by start and period, collapsed) per row."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b.column(1))
            for i, j in slices(texts, SLICE):
                made = text_runs(texts[i:j])
                listed = [[{"start": s, "length": k, "period": q} for s, k, q in found] for _, found, _ in made]
                collapsed = pa.array([c for *_, c in made], pa.binary()).cast(pa.string())
                columns = [b.column(0).slice(i, j - i), pa.array([len(w) for w, *_ in made], pa.int64()), pa.array(listed, kind), collapsed]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "collapsed"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, _SCHEMA)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text), where about a tenth of the texts repeat some of their words to the end, as the crc32 of the doc_id says."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.floor(h / 10).alias("g"), (h % 10 == 0).alias("hit"))
    d = d.select("doc_id", "text", "g", F.when(F.col("hit"), words).alias("w"))
    n = F.size("w")
    a = (F.col("g") % F.greatest(n, F.lit(1))).cast("int")
    d = d.select("doc_id", "text", "g", "w", n.alias("n"), a.alias("a"))
    p = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    tail = F.col("n") - F.col("a")
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, p), F.ceil(tail / p).cast("int")))
    made = F.array_join(F.concat(F.slice("w", 1, F.col("a")), F.slice(again, 1, tail)), " ")
    return d.select("doc_id", F.when(F.coalesce(F.col("n"), F.lit(0)) > 0, made).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(read_table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    # greatest length, then smallest start, then period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    out = found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        best.alias("best"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
    length, period = F.col("best.length"), -F.col("best.period")
    exponent = F.expr("1000 * best.length div -best.period")
    return out.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


ORACLE = {
    "op12_periodic_runs": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1))))) AS h
  FROM documents
), p AS (
  SELECT *, len(w) AS n, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM d
), t AS (
  SELECT rid, n, i, w[1 + CASE WHEN coalesce(h % 10 = 0, false) AND i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM p)
), same AS (
  SELECT x.rid, y.i - x.i AS q, x.i FROM t x JOIN t y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), stretch AS (
  SELECT rid, q, min(i) AS s, count(*) + q AS k FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM same) GROUP BY rid, q, island
), long AS (
  SELECT * FROM stretch WHERE k >= greatest(6, 4 * q)
), run AS (
  SELECT * FROM long r WHERE NOT EXISTS (SELECT 1 FROM long o WHERE o.rid = r.rid AND o.q < r.q AND o.s <= r.s AND o.s + o.k >= r.s + r.k)
), told AS (
  SELECT rid, count(*) AS n_runs, string_agg(s || ',' || k || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
         first(struct_pack(s := s, k := k, q := q) ORDER BY k DESC, s, q) AS best
  FROM run GROUP BY rid
), kept AS (
  SELECT t.rid, string_agg(word, ' ' ORDER BY i) AS collapsed FROM t
  WHERE NOT EXISTS (SELECT 1 FROM run WHERE run.rid = t.rid AND t.i >= s + q AND t.i < s + k) GROUP BY t.rid
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.k AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period,
       CAST(1000 * best.k // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM p LEFT JOIN told USING (rid) LEFT JOIN kept USING (rid)
"""
}

QUERIES = {"op12_periodic_runs": op12_periodic_runs}
