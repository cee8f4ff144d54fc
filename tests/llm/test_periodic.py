import hashlib
import random
import zlib

import numpy as np
import pytest

from loomwork.llm import periodic as pe

SCHEMA = "doc_id long, text string, runs string, collapsed string"


def brute(words):
    """Runs by comparing every place with every lag."""
    out = []
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                stretch = words[i : i + length]
                if not any(stretch[:-p] == stretch[p:] for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def shaped(doc, text):
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
    return w


def row(doc, text):
    w = shaped(doc, text)
    found = brute(w)
    drop = {i for s, k, q in found for i in range(s + q, s + k)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    kept = b" ".join(x for i, x in enumerate(w) if i not in drop)
    return (
        doc, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()), sha(kept),
    )


def test_runs_of_random_texts_against_all_lags():
    rnd = random.Random(9)
    texts = []
    for _ in range(400):
        w = [rnd.choice("abcd") for _ in range(rnd.randrange(0, 60))]
        for _ in range(rnd.randrange(0, 4)):
            unit = [rnd.choice(["a", "b", "c", f"w{rnd.randrange(99)}"]) for _ in range(rnd.randrange(1, 70))]
            k = rnd.randrange(2 * len(unit), 7 * len(unit))
            w += (unit * 8)[:k] + [rnd.choice("ab") for _ in range(rnd.randrange(3))]
        texts.append(" ".join(w).encode())
    texts += [b"", b" \n", b"x", b"a " * 6, b"a " * 5, b"a b " * 3000, b" ".join([b"p q r s t u v w x y"] * 40), b" ".join(b"a b a a b".split() * 90)]
    got = pe.text_runs(texts)
    want = [brute(t.split()) for t in texts]
    assert [g[1] for g in got] == want
    assert {q.bit_length() for some in want for *_, q in some} >= {1, 2, 3, 4, 5, 6, 7}
    assert [pe.text_runs([t])[0][1] for t in texts] == want


def test_a_run_per_period():
    """Every period up to 300, at the least length, between other words."""
    for q in range(1, 301):
        unit = [f"u{i}" for i in range(q)]
        k = max(6, 4 * q)
        t = " ".join(["before", *(unit * 8)[:k], "after", "last"])
        assert pe.text_runs([t.encode()])[0][1] == [(1, k, q)], q


@pytest.mark.parametrize("seed", range(3))
def test_two_words(seed):
    """Texts of two words are full of squares and overlapping runs."""
    rnd = np.random.default_rng(seed)
    for n in (20, 200, 700):
        w = ["ab"[i] for i in rnd.integers(0, 2, n)]
        assert pe.text_runs([" ".join(w).encode()])[0][1] == brute(w)
    fib = ["a", "ab"]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    assert pe.text_runs([" ".join(fib[-1]).encode()])[0][1] == brute(list(fib[-1]))


def test_query_against_brute_force(spark, tmp_path):
    rnd = random.Random(2)
    lone = next(i for i in range(500, 600) if zlib.crc32(str(i).encode()) % 10)
    rows = [(i, " ".join(rnd.choice(["a", "b", f"w{rnd.randrange(50)}", "é"]) for _ in range(rnd.randrange(120)))) for i in range(150)]
    rows += [(None, "a " * 50), (None, None), (7, None), (8, ""), (9, "\t \n"), (3, rows[3][1]), (lone, "long " + "x y z " * 2500 + "end"), (10**12, "b\x0bb\x0cb\rb b b b c d")]
    spark.createDataFrame([(a, b, "x", "y") for a, b in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted([row(d, t) for d, t in rows if d != lone], key=str)
    got = sorted(map(tuple, pe.op12_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert [r for r in got if r[0] != lone] == want
    assert [r[1:6] for r in got if r[0] == lone] == [(1, 1, 7500, 3, 2_500_000)]
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows) > 5


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert pe.op12_periodic_runs(spark, str(tmp_path)).collect() == []
