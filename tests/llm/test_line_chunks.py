import hashlib
import random
from collections import Counter

from loomwork.llm import line_chunks as lc


def brute(rows):
    def chunks(text):
        lines = text.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        r = [(h[i] + 31 * (h[i - 1] if i else 0)) % (2**31 - 1) for i in range(len(h))]
        out, now = [], []
        for i, x in enumerate(lines):
            now.append(x)
            if 0 < i < len(h) - 2 and r[i - 1] > r[i] <= r[i + 1]:
                out.append(now)
                now = []
        return out + [now] * bool(now)

    seen, got = Counter(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if t is None:
            got.append((d, None, 0, 0, 0, 0))
            continue
        kept, gone = [], []
        for c in (all_chunks := chunks(t)):
            key = "\n".join(c)
            (gone if len(c) > 1 and seen[key] else kept).append(c)
            seen[key] += len(c) > 1
        got.append((d, "\n".join("\n".join(c) for c in kept), sum(map(len, all_chunks)), len(all_chunks), len(gone), sum(map(len, gone))))
    return sorted(got, key=str)


def test_against_brute_force(spark):
    shared = "\n".join(f"shared line {i}" for i in range(40))
    docs = [(i, f"intro {i}\n{shared}\noutro {i}") for i in range(5)]
    docs += [(20, None), (21, ""), (22, "one"), (23, "a\nb\na\nb\na\nb"), (24, "x\n" * 3000), (None, shared), (3, docs[3][1]), (25, "\n\n\n")]
    df = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, chunks string")
    assert sorted(map(tuple, lc.dedup_chunks(df).collect()), key=str) == brute(docs)


def test_boundaries_resist_shifts(spark):
    shared = "\n".join(f"shared line {i}" for i in range(60))
    rows = [(1, shared), (2, "new first line\nand another\n" + shared)]
    out = {r.id: r for r in lc.dedup_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].removed_lines == 0 and out[2].removed_lines > 45


def test_short_passages_between_foreign_lines(spark):
    """Share of the lines of a repeated passage that go, by its length."""
    rnd = random.Random(6)

    def lines(n):
        return [f"line {rnd.random()}" for _ in range(n)]

    rows, least = [], {3: 0.03, 4: 0.08, 6: 0.22, 8: 0.35, 12: 0.5, 20: 0.7}
    for n in least:
        for k in range(150):
            passage = lines(n)
            rows += [((n, k, j), "\n".join([*lines(rnd.randrange(8)), *passage, *lines(rnd.randrange(8))])) for j in range(2)]
    df = spark.createDataFrame([(n * 10**6 + k * 10 + j, t) for (n, k, j), t in rows], "doc_id long, text string")
    gone = {n: 0 for n in least}
    for r in lc.dedup_chunks(df).collect():
        gone[r.id // 10**6] += r.removed_lines
        assert r.removed_lines <= r.id // 10**6
    assert all(gone[n] / (150 * n) >= share for n, share in least.items())


def test_empty_table_and_native_plan(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lc.dedup_chunks(df).count() == 0
    plan = lc.op6_line_chunks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_texts_of_repeated_chunks_are_written_once(spark, monkeypatch):
    from loomwork.llm import line_chunks

    kinds = {}

    def seen(df, name):
        kinds[name] = dict(df.dtypes)
        return df.localCheckpoint()

    monkeypatch.setattr(line_chunks, "written", seen)
    line_chunks.dedup_chunks(spark.createDataFrame([(1, "a\nb\nc"), (2, "a\nb\nc")], "doc_id long, text string")).collect()
    assert kinds["lines-found"]["t"] == kinds["lines-kept"]["t"] == "binary" and "string" not in kinds["lines-kept"].values()
