import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as cp
from loomwork.llm import compression_quality as cq
from loomwork.llm import decontaminate as dc
from loomwork.llm import mixing as mx
from loomwork.llm import wavelet as wv

from .test_decontaminate import words
from .test_simhash import classes

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    text = {r.doc_id: r.text for r in docs.collect()}
    sets, at = [], docs
    for _, stage in cp.STAGES:
        at = stage(spark, at, SF)
        sets.append([r.doc_id for r in at.collect()])

    score = cq.train(docs, labels).scorer()
    good = {d for d, t in text.items() if score(t.encode()) >= cq.THRESHOLD}
    assert set(sets[0]) == good and len(sets[0]) == len(good)

    first = {d: min(x for x in group if x in good) for group in near_classes({d: text[d] for d in good}) for d in group}
    leaders = set(sets[1])
    assert leaders == {d for d in good if first[d] == d} and len(leaders) == len(sets[1])

    windows = set()
    for b in bench:
        v = words(b)
        windows |= {tuple(v[s : s + 10]) for s in range(max(1, len(v) - 9) if v else 0)}
    sizes = {len(w) for w in windows}

    def clean(t):
        w = words(t)
        return not any(tuple(w[p : p + n]) in windows for n in sizes for p in range(len(w) - n + 1))

    assert sorted(sets[2]) == sorted(d for d in leaders if clean(text[d]))

    model = mx.train(docs, labels)
    rows = [(d, *mx.read_text(text[d].encode())) for d in sets[2]]
    t = np.array([r[1] for r in rows], float)
    p = np.array([model.posterior(r[2], r[3]) for r in rows])
    want = np.array([mx.TARGETS[d] for d in mx.DOMAINS]) * t.sum()
    gram = (p.T * t) @ p
    gram += 1e-6 * np.trace(gram) * np.eye(3)
    r = np.ones(len(t))
    e, before = t @ p, np.inf
    loss = lambda e: (e - want) @ np.linalg.solve(gram, e - want)
    turns = 0
    while turns < mx.STEPS and np.abs(e - want).max() >= mx.CLOSE * want.min() and loss(e) < (1 - mx.STALL) * before:
        before, turns = loss(e), turns + 1
        r = np.maximum(0, r - p @ np.linalg.solve(gram, e - want))
        e = (r * t) @ p
    times = {d: sets[3].count(d) for d in sets[2]}
    assert all(np.floor(x) <= times[d] <= np.floor(x) + 1 for (d, *_), x in zip(rows, r))

    tok = Tokenizer.from_file(wv.default_vocabulary())
    out, start = [], 0
    for d in sorted(sets[3]):
        ids = tok.encode(text[d], add_special_tokens=False).ids + [1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, at.collect()), key=lambda x: x[1]) == out


def near_classes(text):
    """Classes of texts at a likeness of 0.8 or more, from all pairs."""
    ids, sets = sorted(text), {}
    for d, t in text.items():
        w = (t or "").split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b) - 1e-9
    return classes(ids, [(a, b) for i, a in enumerate(ids) for b in ids[:i] if near(sets[a], sets[b])])


def test_stages_with_nothing_and_with_odd_rows(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/some/{t}.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert cp.run(spark, f"{tmp_path}/none").count() == 0
    text = docs.where("n_chars > 500").orderBy("doc_id").first().text
    rows = [(None, text, "en", "s", 1), (None, text, "en", "s", 1), (3, None, None, None, None), (3, "", "en", "s", 0), (7, text, "en", "s", 1), (7, text, "en", "s", 1)]
    odd = spark.createDataFrame(rows, docs.schema)
    at = odd
    for name, stage in cp.STAGES:
        before, at = at, stage(spark, at, f"{tmp_path}/some")
        if name != cp.STAGES[-1][0]:
            assert at.columns == docs.columns
            assert at.exceptAll(before.unionAll(before).unionAll(before)).count() == 0 or name.startswith("mixing")
    clash = docs.withColumn("row", docs.doc_id).withColumn("node", docs.lang).withColumn("_row", docs.lang).withColumn("key", docs.lang)
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, clash.limit(40), f"{tmp_path}/some").columns == clash.columns


def test_run_gives_the_last_stage(spark):
    out = cp.run(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0


def test_stages_write_no_texts_besides_their_result(spark, monkeypatch):
    """Decontamination and mixing write neither whole rows nor the words of all texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = []
    for module in (dc, mx):
        keep = module.written
        monkeypatch.setattr(module, "written", lambda df, name, keep=keep: found.append((name, df.columns)) or keep(df, name))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert dc.drop_contaminated(docs.union(docs), bench).count() == 2 * dc.drop_contaminated(docs, bench).count() > 0
    assert mx.apply_rates(docs, mx.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))).count() > 0
    assert found and not [x for x in found if {"text", "_row", "id"} & set(x[1]) or x[0] == "decon-words"]
