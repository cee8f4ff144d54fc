import zlib

import numpy as np
import zstandard
from pyspark.sql import functions as F

from loomwork.llm import compression_quality as cq


def test_held_out_accuracy(spark):
    got = cq.op8_compression_quality(spark, "/root/testdata/sf0.1").join(
        spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id"
    )
    rows = got.where("held_out").collect()
    assert len(rows) > 200
    good = [r for r in rows if r.quality == 1]
    bad = [r for r in rows if r.quality == 0]
    assert np.mean([r.predicted for r in good]) > 0.95
    assert np.mean([1 - r.predicted for r in bad]) > 0.8
    assert abs(np.mean([r.score for r in rows]) - np.mean([r.quality for r in rows])) < 0.05


def test_folds_and_edge_cases(spark):
    rows = [(i, t, "x") for i, t in enumerate([None, "", "word " * 30_000, "a"])] + [(None, "text", "x"), (3, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(0, 1, 0), (1, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    out = cq.score_quality(docs, labels, ["doc_id"]).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    held = docs.select("doc_id", (cq.fold_of("doc_id") == 2).alias("h")).where(F.col("doc_id").isNotNull()).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)
    kept = cq.accepted(docs, cq.train(docs, labels))
    assert kept.columns == docs.columns and kept.count() in (0, len(rows))
    assert cq.score_quality(docs.limit(0), labels.limit(0), ["doc_id"]).count() == 0


def test_model_does_not_see_ids_or_labels_of_the_held_out_fold(spark):
    text = [" ".join(f"w{(i * j) % 97}" for j in range(60)) for i in range(400)]
    docs = spark.createDataFrame([(i, text[i]) for i in range(400)], "doc_id long, text string")
    lab = [(i, i % 2, 0) for i in range(400)]
    other = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in lab]
    a, b = [cq.train(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (lab, other)]
    assert a == b


def plain_isotonic(x, y):
    """f(i) = max over j <= i of min over k >= i of the mean of y[j..k], by definition, and the ends of its steps."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order].astype(float)
    c = np.append(0, np.cumsum(y))
    mean = lambda j, k: (c[k + 1] - c[j]) / (k + 1 - j)
    f = np.array([max(min(mean(j, k) for k in range(i, len(y))) for j in range(i + 1)) for i in range(len(y))])
    cuts = [0, *(np.flatnonzero(np.abs(np.diff(f)) > 1e-12) + 1).tolist(), len(y)]
    return [(x[a:b].mean(), (y[a:b].sum() + 0.5) / (b - a + 1)) for a, b in zip(cuts, cuts[1:])]


def test_scores_against_brute_force(spark):
    """Plain zstandard over whole texts, an isotonic fit by its definition, and interpolation by hand."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in cq.op8_compression_quality(spark, sf).collect()}
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    known = [r for r in labels.orderBy(F.xxhash64("doc_id"), "doc_id").collect() if r.quality is not None and r.doc_id in text and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    assert len(known) <= cq.MAX_ROWS
    cut = lambda t: [t[i : i + 2048] for i in range(0, len(t), 2048)]
    side = {c: [b for i, r in enumerate(known) if i % 3 and r.quality == c for b in cut(text[r.doc_id])] for c in (0, 1)}
    made = {c: zstandard.train_dictionary(min(112_640, sum(map(len, s)) // 8), s, level=3) for c, s in side.items()}

    def size(t, c):
        coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(made[c].as_bytes()), write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(coder.compress(b)) for b in cut(t))

    diff = {d: (size(t, 0) - size(t, 1)) / (len(t) + 64) for d, t in text.items()}
    aside = [r for i, r in enumerate(known) if i % 3 == 0]
    knots = plain_isotonic(np.array([diff[r.doc_id] for r in aside]), np.array([r.quality for r in aside]))
    xs, ps = [k[0] for k in knots], np.maximum.accumulate([k[1] for k in knots])

    def curve(x):
        if x <= xs[0]:
            return ps[0]
        for a, b, p, q in zip(xs, xs[1:], ps, ps[1:]):
            if x <= b:
                return p + (q - p) * (x - a) / (b - a)
        return ps[-1]

    assert got.keys() == text.keys()
    for d, r in got.items():
        want = curve(diff[d])
        assert abs(r.score - want) < 1e-9 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2)


def test_calibration_is_monotone():
    rng = np.random.default_rng(0)
    x = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * x))).astype(int)
    xs, ps = cq.isotonic(x, y)
    assert (np.diff(xs) > 0).all() and (ps > 0).all() and (ps < 1).all()
