"""Line dedup by content-defined chunks, in DataFrame functions only.

Each line has a hash; a rolling hash over the hashes of SPAN consecutive lines chooses the boundaries: a
chunk ends after a line whose rolling hash is less than its neighbours'.  A boundary depends on SPAN + 2 lines
alone, so the chunks of a passage are the same wherever it stands, but for its first and last ones, and no chunk has
fewer than two lines (the last line of a text is not cut off either).  Chunks of
two lines or more that occur more than once in the corpus keep their first occurrence (smallest
doc_id, then place); the others are removed.  The 64-bit hash of a chunk only proposes; chunks are grouped by
the SHA-256 of their bytes.

Edge cases: a null text has no lines and stays null; an empty text is one empty line; a null doc_id
comes after all others; repeated rows are repeated chunks (the first row keeps them); texts without a
boundary are one chunk, of any length; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, read_table, written

SPAN = 2
PRIME = 31
MODULUS = 2**31 - 1


def line_hash(line: Column) -> Column:
    """The first 32 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def chunks_of(text: Column) -> Column:
    """array<struct<n int, t string>>: lines and text of each chunk, in order."""
    lines = F.split(text, "\n")

    def rolled(made: Column) -> Column:
        def at(i: Column) -> Column:
            total = F.get(made["h"], i)
            for back in range(1, SPAN):
                total = total + PRIME**back * F.coalesce(F.get(made["h"], i - back), F.lit(0))
            return F.pmod(total, F.lit(MODULUS))

        return F.struct(made["l"].alias("l"), F.transform(F.sequence(F.lit(0), F.size(made["l"]) - 1), at).alias("r"))

    def cut(made: Column) -> Column:
        n, r = F.size(made["l"]), made["r"]

        def ends_here(i: Column) -> Column:
            least = (F.get(r, i) < F.get(r, i - 1)) & (F.get(r, i) <= F.get(r, i + 1))
            return ((i > 0) & (i < n - 2) & least) | (i == n - 1)

        ends = F.filter(F.sequence(F.lit(0), n - 1), ends_here)

        def chunk(end: Column, j: Column, all_ends: Column) -> Column:
            first = F.when(j == 0, 0).otherwise(F.get(all_ends, j - 1) + 1)
            size = end - first + 1
            return F.struct(size.alias("n"), F.array_join(F.slice(made["l"], first + 1, size), "\n").alias("t"))

        inner = F.transform(F.array(ends), lambda e: F.transform(e, lambda end, j: chunk(end, j, e)))
        return F.get(inner, F.lit(0))

    made = F.array(F.struct(lines.alias("l"), F.transform(lines, line_hash).alias("h")))
    return F.get(F.transform(F.transform(made, rolled), cut), F.lit(0))


def dedup_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_lines, n_chunks, removed_chunks, removed_lines) per row; text is what stays."""
    src = docs.select(F.col(id_col).alias("id"), chunks_of(F.col(text_col).cast("string")).alias("chunks"))
    rows = written(src.withColumn("rid", F.monotonically_increasing_id()), "lines-rows")
    multi = rows.select("id", "rid", F.posexplode("chunks").alias("no", "c")).where("c.n > 1")
    multi = multi.select("id", "rid", "no", F.xxhash64("c.t").alias("h"), F.col("c.t").alias("t"))
    again = written(multi.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"), "lines-again")
    # of chunks that may stand twice only the digest travels, not the text
    digest = F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("t")
    found = written(multi.join(broadcast_if_small(again), "h").select("id", "rid", "no", "h", digest), "lines-found")
    at = F.struct(F.col("id").isNull().alias("null"), "id", "rid", "no")
    kept = found.groupBy("h", "t").agg(F.min(at).alias("keep"), F.count("*").alias("k")).where("k > 1").select("h", "t", "keep")
    kept = written(kept, "lines-kept")
    gone = found.join(broadcast_if_small(kept), ["h", "t"]).where((F.col("rid") != F.col("keep.rid")) | (F.col("no") != F.col("keep.no")))
    gone = written(gone.groupBy("rid").agg(F.collect_set("no").alias("gone")), "lines-gone")
    out = rows.join(broadcast_if_small(gone), "rid", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    places = F.when(F.col("chunks").isNotNull(), F.sequence(F.lit(0), F.size("chunks") - 1))
    stay = F.transform(F.array_except(places, "gone"), lambda i: F.get("chunks", i))
    left = F.transform("gone", lambda i: F.get("chunks", i))

    def lines(a: Column) -> Column:
        return F.coalesce(F.aggregate(a, F.lit(0).cast("long"), lambda s, c: s + c["n"]), F.lit(0))

    return out.select(
        "id",
        F.array_join(F.transform(stay, lambda c: c["t"]), "\n").alias("text"),
        lines(F.col("chunks")).alias("n_lines"),
        F.coalesce(F.size("chunks"), F.lit(0)).cast("long").alias("n_chunks"),
        F.size("gone").cast("long").alias("removed_chunks"),
        lines(left).alias("removed_lines"),
    )


def op6_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_chunks(read_table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), "n_lines", "n_chunks", "removed_chunks", "removed_lines",
        F.length("text").cast("long").alias("kept_chars"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


ORACLE = {
    "op6_line_chunks": f"""
WITH split AS (
  SELECT doc_id, string_split(text, chr(10)) AS l FROM documents
), line AS (
  SELECT doc_id, i, l[i] AS t, CAST('0x' || substr(md5(l[i]), 1, 8) AS BIGINT) AS h, len(l) AS n
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM split)
), rolled AS (
  SELECT *, (h + {PRIME} * coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0)) % {MODULUS} AS r FROM line
), ended AS (
  SELECT *, i > 1 AND i < n - 1 AND r < lag(r) OVER (PARTITION BY doc_id ORDER BY i) AND r <= lead(r) OVER (PARTITION BY doc_id ORDER BY i) AS cut
  FROM rolled
), placed AS (
  SELECT *, coalesce(sum(CAST(cut AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no
  FROM ended
), chunk AS (
  SELECT doc_id, no, count(*) AS n, string_agg(t, chr(10) ORDER BY i) AS t FROM placed GROUP BY doc_id, no
), ranked AS (
  SELECT *, n > 1 AND row_number() OVER (PARTITION BY t, n > 1 ORDER BY doc_id, no) > 1 AS gone FROM chunk
), doc AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(count(*) AS BIGINT) AS n_chunks,
         CAST(count(*) FILTER (gone) AS BIGINT) AS removed_chunks, CAST(coalesce(sum(n) FILTER (gone), 0) AS BIGINT) AS removed_lines,
         coalesce(string_agg(t, chr(10) ORDER BY no) FILTER (NOT gone), '') AS kept
  FROM ranked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_chunks, 0) AS n_chunks, coalesce(removed_chunks, 0) AS removed_chunks,
       coalesce(removed_lines, 0) AS removed_lines, CAST(length(kept) AS BIGINT) AS kept_chars, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN doc USING (doc_id)
"""
}

QUERIES = {"op6_line_chunks": op6_line_chunks}
