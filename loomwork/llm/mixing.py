"""Mixing sources to target weights with soft membership.

1. A classifier learned from the labelled table predicts, for every document, a posterior over
   the domains (``clean``, ``rough``: quality 0, ``toxic``: toxic 1).  It is a multinomial
   logistic regression on the presence of the ``TERMS`` words and word beginnings that the labels
   single out most, and on a few measures of the whole text.  It is fitted on at most ``max_rows``
   whole labelled texts, the first by a hash of doc_id.
2. Rates.  With t_i tokens and posterior p_i, document i at rate r_i >= 0 adds
   r_i t_i p_i expected tokens to the domains.  Rates minimise

       (E - T)' M^-1 (E - T) / 2,   E_d = sum_i r_i t_i p_id,   r_i >= 0

   (least squares whitened by M = sum_i t_i p_i p_i', the domain-by-domain token matrix) by
   projected gradient steps from r = 1 in the metric weighted by tokens.  In that metric the loss
   has Lipschitz constant 1, so the step length is 1:  r_i <- max(0, r_i - p_i' M^-1 (E - T)).
   A step needs only the vector E, which one distributed aggregation gives; the gradient of a
   document depends on its posterior alone, so its rate is refolded from the short list of
   past step vectors and no state per document is kept, sent or lost.

``T_d`` is the target weight times all tokens.  A target that the posteriors can't reach is met
in the least-squares sense.

Edge cases: null, empty or wordless texts have 0 tokens, the posterior of a text without terms, and
the rate that it gives; null labels teach nothing; without labels the posterior is uniform; repeated
rows get equal rates; a null id passes through; an empty table gives an empty result; extra
columns are ignored by the query and kept by ``apply_rates``.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_ASCII, labelled_sample, read_table, utf8, written

DOMAINS = ("clean", "rough", "toxic")
#: Target share of the expected tokens.
TARGETS = {"clean": 0.9, "rough": 0.05, "toxic": 0.05}
#: Bound of the labelled sample that reaches the driver.
MAX_ROWS = 4000
TERMS = 1000
#: Rows that a term must be in.
MIN_ROWS = 5
EPOCHS = 5
RATE = 0.1
#: Miss of the targets, as a share of the least, that ends the steps; share by which a step must lower the loss.
CLOSE, STALL = 1e-4, 1e-3
#: Most steps: a step is one aggregation over all rows.
STEPS = 40
WORD = re.compile(rb"[a-z\x80-\xff]+")
CAPITALS = bytes(range(65, 91))


def domain_of(quality: Column, toxic: Column) -> Column:
    """Domain number of a labelled row, null where the labels don't say."""
    return F.when(toxic == 1, 2).when(quality == 0, 1).when((quality == 1) & (toxic == 0), 0)


def read_text(text: bytes) -> tuple[int, set[bytes], np.ndarray]:
    """(tokens, terms, measures) of a text; tokens are its words between white space."""
    low = text.translate(LOWER_ASCII)
    tokens = len(low.split())
    words = WORD.findall(low)
    unique = set(words)
    size, n = max(1, len(text)), max(1, len(words))
    letters = sum(map(len, words))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    marks = size - letters - text.count(b" ") - text.count(b"\n")
    measures = np.array([1.0, 4 * marks / size, 4 * capitals / size, 1 - len(unique) / n, np.log1p(len(words)) / 8])
    return tokens, unique | {b"^" + w[:5] for w in unique}, measures


@dataclass(frozen=True)
class Model:
    terms: dict[bytes, int]
    w: np.ndarray
    v: np.ndarray

    def posterior(self, terms: set[bytes], measures: np.ndarray) -> np.ndarray:
        known = [self.terms[x] for x in terms & self.terms.keys()]
        z = self.w[known].sum(axis=0) + measures @ self.v
        e = np.exp(z - z.max())
        return e / e.sum()


def choose_terms(texts: list[bytes], y: np.ndarray) -> list[bytes]:
    """The terms whose counts in some domain stray most from its share of the rows."""
    share = np.bincount(y, minlength=len(DOMAINS)) / max(1, len(y))
    free = [(d, s) for d, s in enumerate(share) if 0 < s < 1]
    seen: Counter[bytes] = Counter()
    for t in texts:
        seen.update(read_text(t)[1])
    total = {t: n for t, n in seen.items() if n >= MIN_ROWS}
    del seen
    counts = {t: [0] * len(DOMAINS) for t in total}
    for t, d in zip(texts, y):
        for term in read_text(t)[1] & counts.keys():
            counts[term][d] += 1

    def stray(term: bytes) -> float:
        n = total[term]
        return max(abs(counts[term][d] - n * s) / (n * s * (1 - s)) ** 0.5 for d, s in free)

    ranked = sorted((-stray(t), t) for t in total) if free else []
    return sorted(t for _, t in ranked[:TERMS])


def fit(texts: list[bytes], domains: list[int]) -> Model:
    """AdaGrad over whole labelled texts in a fixed order; without texts all weights are 0."""
    y = np.array(domains, dtype=np.int64)
    terms = {t: i for i, t in enumerate(choose_terms(texts, y))}
    w, v = np.zeros((len(terms), len(DOMAINS))), np.zeros((5, len(DOMAINS)))
    gw, gv = np.full_like(w, 1e-2), np.full_like(v, 1e-2)
    rows = []
    for _, found, measures in map(read_text, texts):
        rows.append((np.array(sorted(terms[t] for t in found & terms.keys()), dtype=np.int64), measures))
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            k, m = rows[i]
            z = w[k].sum(axis=0) + m @ v
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1.0
            gw[k] += p * p
            w[k] -= RATE * p / np.sqrt(gw[k])
            g = np.outer(m, p)
            gv += g * g
            v -= RATE * g / np.sqrt(gv)
    return Model(terms, w, v)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    known = labels.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("y"))
    rows = labelled_sample(docs, known, max_rows)
    return fit([t for t, _ in rows], [y for _, y in rows])


def soft_membership(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``tokens`` and one posterior column p_<domain> per domain."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["tokens", *[f"p_{d}" for d in DOMAINS]]
    src = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    made_fields = [T.StructField("tokens", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names[1:]]]
    schema = T.StructType([*src.schema.fields[:-1], *made_fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.zeros(b.num_rows, dtype=np.int64)
            p = np.zeros((len(DOMAINS), b.num_rows))
            for i, t in enumerate(utf8(b.column(b.num_columns - 1))):
                n[i], terms, measures = read_text(t)
                p[:, i] = shared.value.posterior(terms, measures)
            made = [pa.array(n), *[pa.array(row) for row in p]]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], [*b.schema.names[:-1], *names])

    return src.mapInArrow(run, schema)


def _rate(steps: list[list[float]]) -> Column:
    """Rate after the steps: r <- max(0, r - step . p), from 1."""
    p = [F.col(f"p_{d}") for d in DOMAINS]
    if not steps:
        return F.lit(1.0)
    vectors = F.lit(np.array(steps).ravel().tolist())
    size = len(DOMAINS)

    def fold(r: Column, i: Column) -> Column:
        move = sum((F.element_at(vectors, i * size + j + 1) * p[j] for j in range(size)), F.lit(0.0))
        return F.greatest(F.lit(0.0), r - move)

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(steps) - 1)), F.lit(1.0), fold)


def fit_rates(member: DataFrame, targets: dict[str, float]) -> tuple[list[list[float]], float]:
    """(step vectors of the projected gradient method over a written ``soft_membership`` table, largest miss of a
    target as a share of it).  Steps end when every target is met to CLOSE, or when a step no longer lowers
    the loss by the share STALL, or after STEPS of them; a warning tells targets that are missed then."""
    d = len(DOMAINS)
    p = [F.col(f"p_{x}") for x in DOMAINS]
    first = member.agg(
        *[F.sum(F.col("tokens") * p[i]).alias(f"e{i}") for i in range(d)],
        *[F.sum(F.col("tokens") * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(d) for j in range(d)],
    ).first()
    e = np.array([first[f"e{i}"] or 0.0 for i in range(d)])
    if not e.sum():
        return [], 0.0
    want = np.array([targets[x] for x in DOMAINS])
    want = want / want.sum() * e.sum()
    gram = np.array([[first[f"m{i}_{j}"] for j in range(d)] for i in range(d)])
    gram += 1e-6 * np.trace(gram) * np.eye(d)
    loss = lambda e: float((e - want) @ np.linalg.solve(gram, e - want))
    done: list[list[float]] = []
    before = np.inf
    while len(done) < STEPS and np.abs(e - want).max() >= CLOSE * want.min() and loss(e) < (1 - STALL) * before:
        before = loss(e)
        done.append(np.linalg.solve(gram, e - want).tolist())
        rated = member.withColumn("r", _rate(done))
        row = rated.agg(*[F.sum(F.col("r") * F.col("tokens") * p[i]).alias(f"e{i}") for i in range(d)]).first()
        e = np.array([row[f"e{i}"] for i in range(d)])
    miss = float((np.abs(e - want) / want).max())
    if np.abs(e - want).max() >= CLOSE * want.min():
        warnings.warn(f"mixing targets are missed by up to {miss:.2%} after {len(done)} steps", stacklevel=2)
    return done, miss


def mix(docs: DataFrame, labels: DataFrame, keep: list[str], targets: dict[str, float] | None = None) -> DataFrame:
    """``keep``, tokens, posteriors and the fitted ``rate`` per row; ``target_miss``: largest miss of a target as a share of it."""
    member = written(soft_membership(docs, train(docs, labels), keep), "mix-membership")
    steps, miss = fit_rates(member, targets or TARGETS)
    return member.withColumn("rate", _rate(steps)).withColumn("target_miss", F.lit(miss))


def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return mix(docs, labels, ["doc_id"])


def apply_rates(docs: DataFrame, model: Model, targets: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with each row repeated floor(rate) times, and once more with the probability of
    the rest: a hash of the row's id and text decides, so a rerun gives the same rows."""
    member = written(soft_membership(docs.select("text"), model, []), "mix-membership")
    steps, _ = fit_rates(member, targets or TARGETS)
    # posteriors are taken once more with the rows, which are larger than all else and so are not written
    whole = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    rated = soft_membership(whole, model, ["_row"]).withColumn("_rate", _rate(steps))
    draw = F.pmod(F.xxhash64("_row.doc_id", "_row.text"), F.lit(1 << 20)) / float(1 << 20)
    copies = (F.floor("_rate") + F.when(draw < F.col("_rate") - F.floor("_rate"), 1).otherwise(0)).cast("int")
    return rated.select(F.explode(F.array_repeat("_row", copies)).alias("_row")).select("_row.*")


QUERIES = {"op5_soft_mixing": op5_soft_mixing}
