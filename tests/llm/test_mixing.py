import numpy as np
from pyspark.sql import functions as F

from loomwork.llm import mixing as mx

SF = "/root/testdata/sf0.1"


def test_targets_are_met_and_rates_are_nonnegative(spark):
    out = mx.op5_soft_mixing(spark, SF).toPandas()
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count()
    e = np.array([(out.rate * out.tokens * out[f"p_{d}"]).sum() for d in mx.DOMAINS])
    want = np.array([mx.TARGETS[d] for d in mx.DOMAINS]) * out.tokens.sum()
    assert (out.rate >= 0).all() and np.abs(e / want - 1).max() < 0.02
    assert np.allclose(out[[f"p_{d}" for d in mx.DOMAINS]].sum(axis=1), 1)


def test_plain_projected_gradient_meets_the_targets():
    rng = np.random.default_rng(1)
    t = rng.integers(1, 500, 300).astype(float)
    p = rng.dirichlet([0.3, 0.3, 0.3], 300)
    want = np.array([0.9, 0.05, 0.05]) * t.sum()
    r = np.ones(300)
    gram = (p.T * t) @ p
    for _ in range(5000):
        r = np.maximum(0, r - p @ np.linalg.solve(gram, (r * t) @ p - want))
    assert np.abs((r * t) @ p / want - 1).max() < 1e-2


def test_rates_in_spark_equal_the_plain_fold(spark):
    rows = [(int(10 * i), *np.random.default_rng(i).dirichlet([1, 1, 1]).tolist()) for i in range(50)]
    df = spark.createDataFrame(rows, "tokens long, p_clean double, p_rough double, p_toxic double")
    steps, _ = mx.fit_rates(df, mx.TARGETS)
    got = [r.r for r in df.select(mx._rate(steps).alias("r")).collect()]
    for (_, *p), r in zip(rows, got):
        x = 1.0
        for s in steps:
            x = max(0.0, x - float(np.dot(s, p)))
        assert abs(x - r) < 1e-9


def test_classifier_on_unseen_labels(spark):
    docs, labels = [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")]
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    model = mx.train(docs, labels.where(~fold))
    rows = docs.join(labels.where(fold), "doc_id").select("text", mx.domain_of(F.col("quality"), F.col("toxic")).alias("d")).collect()
    right = [int(np.argmax(model.posterior(*mx.read_text(r.text.encode())[1:]))) == r.d for r in rows]
    assert np.mean(right) > 0.93


def test_edge_cases(spark):
    schema = "doc_id long, text string, tokens string"
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "x"), (2, "word " * 30_000, "x"), (2, "a b", "x"), (2, "a b", "x")], schema)
    labels = spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = mx.mix(docs, labels, ["doc_id"]).collect()
    assert len(out) == 5 and sorted(r.tokens for r in out) == [0, 0, 2, 2, 30_000]
    assert all(abs(r.p_clean - 1 / 3) < 1e-9 for r in out)
    kept = mx.apply_rates(docs, mx.train(docs, labels), {"clean": 1, "rough": 1, "toxic": 1})
    assert kept.columns == docs.columns and kept.count() == 5
    assert mx.mix(docs.limit(0), labels.limit(0), ["doc_id"]).count() == 0
    assert mx.apply_rates(docs.limit(0), mx.fit([], [])).count() == 0
