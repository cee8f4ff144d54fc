import hashlib

import numpy as np

from loomwork.llm import oph


def brute(rows):
    """(id, n_chars, sha, near_edited) by sorting everything on one machine."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    out = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        new = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        a, b, c = (oph.fingerprint(x.encode()) for x in (t, new, nxt))
        out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), a.hex(), b.hex(), oph.likeness(a, b), oph.likeness(a, c)))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, bucket string")
    return sorted(map(tuple, oph.edited_fingerprints(df).collect()), key=str)


def test_neighbours_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id * 37 % 1009 - 300, r.text) for r in docs.collect()]
    rows += [(5, None), (-301, ""), (None, "no id"), (None, "no id"), (77_777, "last é one"), (8, "w " * 60_000), (5, "b"), (5, "b")]
    assert run(spark, rows) == brute(rows)


def test_small_tables(spark):
    assert run(spark, []) == []
    for rows in ([(1, "only one row here")], [(None, "a b c")], [(2, "x y"), (2, "x y")], [(1, None), (2, None)]):
        assert run(spark, rows) == brute(rows)


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_likeness_estimates_jaccard():
    rng = np.random.default_rng(5)
    errors = []
    for n in (8, 30, 120, 600, 3000):
        for share in (0.0, 0.3, 0.6, 0.9, 0.97):
            a = [f"w{x}" for x in rng.integers(0, 10**6, n)]
            b = a[: int(n * share)] + [f"w{x}" for x in rng.integers(0, 10**6, n - int(n * share))]
            a, b = " ".join(a), " ".join(b)
            errors.append(oph.likeness(oph.fingerprint(a.encode()), oph.fingerprint(b.encode())) - jaccard(a, b))
    assert np.abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.1


def test_empty_and_case():
    assert oph.fingerprint(b"") == oph.fingerprint(b" \n\t") == oph.EMPTY
    assert oph.likeness(oph.EMPTY, oph.EMPTY) == 1 and oph.likeness(oph.EMPTY, oph.fingerprint(b"a")) == 0
    assert oph.fingerprint(b"One TWO three") == oph.fingerprint(b"one  two\nthree")


def test_empty_bins_are_filled_attempt_by_attempt(monkeypatch):
    rng = np.random.default_rng(3)
    for kept in (oph.DONORS_KEPT, 100):
        monkeypatch.setattr(oph, "DONORS_KEPT", kept)
        for n in (1, 2, 9, 200, 511, 512):
            filled = np.zeros(oph.BINS, bool)
            filled[rng.choice(oph.BINS, n, replace=False)] = True
            low = np.where(filled, rng.integers(0, 16, oph.BINS), 0).astype(np.uint8)
            want, left, attempt = low.copy(), np.flatnonzero(~filled), 0
            while len(left):
                ask = oph.donors(attempt)[left]
                want[left[filled[ask]]] = low[ask[filled[ask]]]
                left, attempt = left[~filled[ask]], attempt + 1
            assert (oph.densified(low.copy(), filled) == want).all()


def test_a_fingerprint_looks_at_blocks_of_attempts(monkeypatch):
    calls = []
    real = oph.asked
    monkeypatch.setattr(oph, "asked", lambda a, b: calls.append(a) or real(a, b))
    oph.fingerprint(b"one two three four five six seven")
    assert 0 < len(calls) < 30
