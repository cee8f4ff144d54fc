"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Each benchmark item is cut into windows of WINDOW consecutive words (an item with fewer words,
but not none, is one window).  A document holds a window if its words occur in it one after
another; a document word inside any occurrence is hit.

A window is a set of positioned SHINGLE-word shingles, and containment must be whole, so a
prefix of one shingle is enough (|x| - 1.0 |x| + 1): the rarest one.  Rarity is the number
of occurrences in all documents, counted first.  Documents join only on those necessary
shingles.  The position of the shingle in the window fixes where the window would start;
the length bound (it must end inside the document) and the positional bound (it must not
start before it) drop candidates before the words of the window are compared with the words of the document
one by one.  Hashes only propose; the comparison of words decides.

Words: A-Z lower-cased, then maximal runs of 0-9, a-z and everything beyond ASCII.

Edge cases: null or wordless texts have no words, hits or items; null or wordless items have
no window; a null item_id hits words but is not named; repeated items count once by their
item_id; repeated document rows are separate rows; empty tables give an empty result or zero
hits; extra columns are ignored by the query and kept by ``drop_contaminated``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, read_table, written

WINDOW = 10
SHINGLE = 3
#: Everything in ASCII but digits and letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    low = F.translate(text.cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), GAP), "")


def _shingle(parts: list[Column]) -> Column:
    """Hash of a shingle; its number of words is part of it."""
    return F.xxhash64(F.lit(len(parts)), *parts)


def windows_of(bench: DataFrame) -> DataFrame:
    """(win, item_id, words, at, k, h): every shingle of every window; at is its place in it."""
    items = bench.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w"))
    items = items.where(F.size("w") > 0).distinct()
    cut = items.select(
        "item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - WINDOW + 1, F.lit(1)))).alias("s")
    ).select("item_id", F.expr(f"slice(w, s, {WINDOW})").alias("words"))
    cut = written(cut.distinct().withColumn("win", F.monotonically_increasing_id()), "decon-windows")
    k = F.least(F.size("words"), F.lit(SHINGLE))
    placed = cut.withColumn("k", k).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("k"))))
    word = [F.get("words", F.col("at") + i) for i in range(SHINGLE)]
    h = F.when(F.col("k") == SHINGLE, _shingle(word))
    for i in range(1, SHINGLE):
        h = F.when(F.col("k") == i, _shingle(word[:i])).otherwise(h)
    return placed.withColumn("h", h)


def doc_shingles(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """(rid, n_words, pos, h): the shingles of each text, of the sizes that the benchmark has."""

    def of(k: int) -> DataFrame:
        # a position's words come from shifted copies of the array, so that one generator makes the row
        shifted = [F.col("words"), *[F.expr(f"slice(words, {i + 1}, greatest(size(words) - {i}, 0))") for i in range(1, k)]]
        cols = [f"w{i}" for i in range(k)]
        zipped = F.arrays_zip(*[c.alias(n) for c, n in zip(shifted, cols)])
        made = rows.where(F.col("n_words") >= k).select("rid", "n_words", F.posexplode(zipped).alias("pos", "z"))
        made = made.where(F.col("pos") <= F.col("n_words") - k)
        return made.select("rid", "n_words", "pos", _shingle([F.col(f"z.{n}") for n in cols]).alias("h"))

    return reduce(DataFrame.unionByName, [of(k) for k in sizes])


def occurrences(rows: DataFrame, bench: DataFrame, single: bool = True) -> DataFrame:
    """Written (rid, start, stop, item_id) of the windows that occur in ``rows`` (rid, n_words, words); ``single``: False if
    several rows, all of the same words, may have one rid."""
    grams = written(windows_of(bench), "decon-shingles")
    sizes = sorted(r.k for r in grams.select("k").distinct().collect()) or [SHINGLE]
    asked = broadcast_if_small(written(grams.select("h").distinct(), "decon-asked"))

    # rarity of the benchmark's shingles over all documents
    counts = doc_shingles(rows, sizes).join(asked, "h").groupBy("h").agg(F.count("*").alias("n"))
    by_rarity = Window.partitionBy("win").orderBy("n", "h", "at")
    ranked = grams.join(counts, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    prefix = ranked.withColumn("r", F.row_number().over(by_rarity)).where("r = 1 and n > 0")
    prefix = written(prefix.select("h", "win", "at", "item_id", F.col("words").alias("item_words")), "decon-prefix")

    found = doc_shingles(rows, sizes).join(broadcast_if_small(prefix.select("h", "win", "at", F.size("item_words").alias("len"))), "h")
    start = F.col("pos") - F.col("at")
    bound = found.where((start >= 0) & (start + F.col("len") <= F.col("n_words")))
    cand = bound.select("rid", start.alias("start"), "win")
    cand = written(cand if single else cand.distinct(), "decon-candidates")

    near = broadcast_if_small(written(cand.select("rid").distinct(), "decon-documents"))
    texts = rows.join(near, "rid", "left_semi").select("rid", "words")
    texts = texts if single else texts.dropDuplicates(["rid"])
    told = cand.join(broadcast_if_small(prefix.select("win", "item_id", "item_words").distinct()), "win")
    same = (told["rid"] == texts["rid"]) & (F.slice(texts["words"], told["start"] + 1, F.size(told["item_words"])) == told["item_words"])
    occ = told.join(texts, same).select(told["rid"], "start", (F.col("start") + F.size("item_words")).alias("stop"), "item_id")
    return written(occ, "decon-occurrences")


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, hits): ``rows`` has a row per document row (rid, id, n_words, words); ``hits`` has
    (rid, n_hit, items) for those in which a window occurs."""
    rows = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), "id", F.size("words").alias("n_words"), "words")
    rows = written(rows, "decon-words")
    occ = occurrences(rows, bench)

    # words inside any occurrence: length of the union of the intervals
    spans = occ.groupBy("rid", "start").agg(F.max("stop").alias("stop"))
    before = Window.partitionBy("rid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(before), F.lit(0))))
    n_hit = spans.select("rid", fresh.alias("fresh")).groupBy("rid").agg(F.sum("fresh").cast("long").alias("n_hit"))
    items = occ.select("rid", "item_id").distinct().groupBy("rid").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    return rows, n_hit.join(items, "rid")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, hits = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    out = rows.select("rid", "id", "n_words").join(hits, "rid", "left")
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window occurs, with their own columns.  A row is known by the SHA-256 of its text, so
    that neither texts nor their words are written: ``docs`` is read again instead."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rid = F.unhex(F.sha2(text.cast("binary"), 256)).alias("rid")
    rows = docs.select(rid, words_of(F.col(text_col)).alias("words")).select("rid", F.size("words").alias("n_words"), "words")
    bad = written(occurrences(rows, bench, single=False).select("rid").distinct(), "decon-dropped")
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("whole"), rid)
    return whole.join(broadcast_if_small(bad), "rid", "left_anti").select("whole.*")


ORACLE = {
    "op4_benchmark_decontamination": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, w[s:s + 9] AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)
), pos AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0
), grams AS (
  SELECT doc_id, p, n, w[p:p + n - 1] AS g
  FROM pos, (SELECT DISTINCT len(words) AS n FROM win) WHERE p + n - 1 <= len(w)
), occ AS (
  SELECT DISTINCT doc_id, p, n, item_id FROM grams JOIN win ON g = words
), hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM occ) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
}

QUERIES = {"op4_benchmark_decontamination": op4_benchmark_decontamination}
