"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

Fit (driver, bounded sample): of the labelled rows outside the held-out fold, the first
``max_rows`` in the order of a hash of doc_id are taken whole.  Two thirds of them give the
two dictionaries, one trained on label-1 texts and one on label-0 texts; the last third, which the
dictionaries never saw, calibrates.  Score (executors, every whole text): the text is
compressed in blocks of BLOCK bytes once with each dictionary, and

    x = (bytes with the bad dictionary - bytes with the good one) / (bytes of text + PRIOR)

is mapped to a probability by a monotone calibration curve.  Blocks keep the dictionaries
in play throughout a long text, which would otherwise become its own dictionary.

Labels, lang, source and doc_id are never inputs of a score.

Edge cases: null and empty texts have x = 0 and the score of x = 0; labels that are null are
not used; a doc_id that is null is never held out and never labelled; a label that occurs for
one class only, or no label at all, gives every row the share of label 1 (0.5 if there is none);
repeated rows get equal scores; extra columns are ignored by the query and kept by ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled_sample, read_table, utf8

#: Bound of the labelled sample that reaches the driver.
MAX_ROWS = 6000
DICT_BYTES = 112_640
BLOCK = 2048
PRIOR = 64
LEVEL = 3
#: Score from which a text counts as good.
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2


def fold_of(id_col: str) -> Column:
    """crc32 of the id as text, modulo FOLDS."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    #: Knots of the calibration curve.
    xs: tuple[float, ...]
    ps: tuple[float, ...]

    def scorer(self):
        def coder(data: bytes):
            made = zstandard.ZstdCompressionDict(data)
            return zstandard.ZstdCompressor(
                level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False
            ).compress

        if not self.good:
            return lambda text: self.ps[0]
        good, bad = coder(self.good), coder(self.bad)

        def score(text: bytes) -> float:
            return float(np.interp(difference(text, good, bad), self.xs, self.ps))

        return score


def difference(text: bytes, good, bad) -> float:
    parts = blocks(text)
    return (sum(len(bad(p)) for p in parts) - sum(len(good(p)) for p in parts)) / (len(text) + PRIOR)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit of y on x: (mean x, value) of each pool, with a
    half-count of each class in every pool so that no probability is 0 or 1."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for xi, yi in zip(x[order], y[order]):
        pools.append([1.0, float(yi), float(xi)])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    n, s, sx = np.array(pools).T
    return sx / n, (s + 0.5) / (n + 1.0)


def fit(texts: list[bytes], labels: list[int]) -> Model:
    """Dictionaries and calibration from whole labelled texts, in a fixed order."""
    share = float(np.mean(labels)) if labels else 0.5
    part = [[t for i, (t, y) in enumerate(zip(texts, labels)) if y == c and i % 3 != 0] for c in (1, 0)]
    held = [(t, y) for i, (t, y) in enumerate(zip(texts, labels)) if i % 3 == 0]
    chunks = [[b for t in side for b in blocks(t)] for side in part]
    if min(sum(map(len, c)) for c in chunks) < 8 * 1024 or len({y for _, y in held}) < 2:
        return Model(b"", b"", (0.0,), (share,))
    sizes = [min(DICT_BYTES, sum(map(len, c)) // 8) for c in chunks]
    try:
        good, bad = [zstandard.train_dictionary(s, c, level=LEVEL).as_bytes() for s, c in zip(sizes, chunks)]
    except zstandard.ZstdError:
        return Model(b"", b"", (0.0,), (share,))
    raw = Model(good, bad, (-1.0, 1.0), (-1.0, 1.0)).scorer()
    xs, ps = isotonic(np.array([raw(t) for t, _ in held]), np.array([y for _, y in held]))
    ps = np.maximum.accumulate(ps)
    return Model(good, bad, tuple(map(float, xs)), tuple(map(float, ps)))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fold."""
    known = labels.where("quality in (0, 1)").select("doc_id", F.col("quality").alias("y"))
    rows = labelled_sample(docs, known.where(fold_of("doc_id") != HELD_OUT), max_rows)
    return fit([t for t, _ in rows], [y for _, y in rows])


def with_score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for b in batches:
            at = b.schema.get_field_index(text_col)
            got = pa.array([score(t) for t in utf8(b.column(at))], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, got], [*b.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def score_quality(docs: DataFrame, labels: DataFrame, keep: list[str], max_rows: int = MAX_ROWS) -> DataFrame:
    """The columns ``keep`` of every row, with score and predicted."""
    model = train(docs, labels, max_rows)
    out = with_score(docs.select(*dict.fromkeys([*keep, "text"])), model).select(*keep, "score")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op8_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    out = score_quality(docs, labels, ["doc_id"])
    return out.select(
        "doc_id", F.coalesce(fold_of("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted"
    )


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their own columns; one that could not be trained rejects none."""
    if not model.good:
        return docs
    whole = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    return with_score(whole, model).where(F.col("score") >= THRESHOLD).select("_row.*")


QUERIES = {"op8_compression_quality": op8_compression_quality}
