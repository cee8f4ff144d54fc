import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import common
from loomwork.llm import jaccard as jc
from loomwork.llm.simhash import ring_keys

from .test_simhash import classes

SCHEMA = "doc_id long, text string, node string, n long, h1 long, piece int"


def shingles(text, width=4):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width=4, num=85, den=100):
    sets = [shingles(t, width) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    out = []
    for group in classes(range(len(rows)), links):
        known = [rows[i][0] for i in group if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(known, default=None)) for i in group]
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(a, b, "x", 1, 2, 3) for a, b in rows], SCHEMA)


def run(spark, rows, **more):
    return sorted(map(tuple, jc.jaccard_components(frame(spark, rows), **more).collect()), key=str)


def made(rnd, sizes, edits):
    """Texts with copies that differ in some words or in what stands at their ends."""
    rows = []
    for n in sizes:
        base = [f"w{rnd.randrange(4000)}" for _ in range(n)]
        for k in edits:
            t = list(base)
            for _ in range(k):
                spot = rnd.choice([0, len(t), rnd.randrange(len(t) + 1)])
                if rnd.random() < 0.5:
                    t.insert(spot, f"x{rnd.randrange(4000)}")
                elif len(t) > 1:
                    del t[min(spot, len(t) - 1)]
            rows.append((len(rows), " ".join(t)))
    return rows


@pytest.mark.parametrize("boundary", [None, 0, 16])
def test_against_all_pairs(spark, tmp_path, monkeypatch, boundary):
    if boundary is not None:
        monkeypatch.setattr(jc, "choose_boundary", lambda *a: boundary)
    rnd = random.Random(4)
    rows = made(rnd, [*range(1, 24), 30, 45, 60, 90, 200], [0, 0, 1, 1, 2, 3, 5])
    rows += [(None, rows[5][1]), (None, None), (7, None), (3, ""), (3, rows[9][1]), (-4, rows[100][1].upper()), (None, "only here"), (900, " \n"), (901, "x " * 3000)]
    chain = [f"c{i}" for i in range(120)]
    for i in range(60):
        chain[2 * i] = f"d{i}"
        rows.append((1000 + i, " ".join(chain)))
    got = run(spark, rows)
    assert got == brute(rows)
    assert len({r[2] for r in got}) < len(rows) - 60


def test_every_linked_pair_shares_a_key():
    rnd = np.random.default_rng(3)
    counts = rnd.integers(0, 9, 1 << jc.SKETCH_BITS).astype(np.uint32)
    tried = {"light": 0, "heavy": 0, "both": 0}
    for _ in range(6000):
        n, top = int(rnd.integers(1, 26)), 12
        i = int(rnd.integers(max(1, n - 4), n + 1))
        m = int(rnd.integers(i, i + 5))
        if 100 * i < 85 * (n + m - i):
            continue
        pool = rnd.integers(0, 2**64, n + m - i, dtype=np.uint64)
        a, b = np.sort(pool[:n]), np.sort(np.append(pool[:i], pool[n:]))
        keys = []
        for s in (a, b):
            own = [jc.subset_keys(s)] if len(s) <= top else []
            own += [jc.prefix_keys(s, counts)] if len(s) >= -(-85 * (top + 1) // 100) else []
            keys.append(set(np.concatenate(own).tolist()))
        assert keys[0] & keys[1], (n, m, i)
        tried["light" if max(n, m) <= top else "heavy" if min(n, m) > top else "both"] += 1
    assert min(tried.values()) > 20


def test_bitmaps_differ_in_no_more_than_the_sets(spark):
    rnd = np.random.default_rng(5)
    rows = []
    for n in (1, 3, 16, 60, 127, 128, 250, 1100):
        for cut in (0, 1, n // 12, n // 7):
            a = np.unique(rnd.integers(0, 2**64, n, dtype=np.uint64))
            b = np.unique(np.append(a[cut:], rnd.integers(0, 2**64, cut // 2, dtype=np.uint64)))
            if len(b):
                rows.append((len(set(a.tolist()) ^ set(b.tolist())), *[jc.parity_bits(x).view(np.int64).tolist() for x in (a, b)]))
        other = rnd.integers(0, 2**64, n, dtype=np.uint64)
        rows.append((2 * n, *[jc.parity_bits(x).view(np.int64).tolist() for x in (a, other)]))
    df = spark.createDataFrame(rows, "d long, a array<long>, b array<long>")
    got = df.select("d", jc.bits_apart("a", "b").alias("x"), jc.bits_apart("b", "a").alias("y")).collect()
    assert all(r.x == r.y <= r.d and (r.d - r.x) % 2 == 0 for r in got)
    assert all(r.x > 0.162 * r.d / 2 for r in got if r.d > 100 and r.d % 2 == 0 and r.d in (120, 254, 256, 500, 2200))


def test_many_near_copies_and_a_common_passage(spark):
    rnd = random.Random(8)
    base = [f"b{i}" for i in range(80)]
    passage = " ".join(f"p{i}" for i in range(40))
    rows = []
    for i in range(400):
        t = list(base)
        t[rnd.randrange(80)] = f"n{i}"
        rows.append((i, " ".join(t)))
        rows.append((1000 + i, passage + " " + " ".join(f"q{rnd.randrange(9)}" for _ in range(rnd.randrange(12)))))
    assert run(spark, rows) == brute(rows)


def test_keys_of_the_same_nodes_come_once(spark):
    rows = [(100 + k, n, 20) for k in range(30) for n in (1, 2)] + [(7, n, 20) for n in (1, 2, 3)] + [(8, n, 20) for n in (1, 4, 3)] + [(9, 5, 20)]
    got = jc.one_of_equal(spark.createDataFrame(rows, "key long, node long, n long"), "test").collect()
    assert sorted(map(tuple, got)) == sorted(r for r in rows if r[0] in (100, 7, 8))


def test_small_tables_are_few_files(spark, monkeypatch):
    made = []
    monkeypatch.setattr(common, "written", lambda df, name: made.append(df.rdd.getNumPartitions()) or df.localCheckpoint())
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)], "a long, b long").repartition(9, "a")
    monkeypatch.setattr(common, "PART_ROWS", 6)
    assert {tuple(r) for r in common.connected_components(edges, "test").collect()} == {(i, 0) for i in range(13)}
    assert len(made) > 2 and max(made[1:]) <= 2


def test_other_widths_and_thresholds(spark):
    rows = made(random.Random(6), [*range(1, 20), 40, 80], [0, 1, 2, 4])
    assert run(spark, rows, width=2, num=3, den=4) == brute(rows, 2, 3, 4)


def test_boundary_follows_cost(spark):
    """Rare sets of few shingles are cheaper to index; where their lists are long, to enumerate."""
    cost = {}
    for name, hot in (("rare", 0), ("hot", 10**6)):
        counts = spark.sparkContext.broadcast(np.full(1 << jc.SKETCH_BITS, 1, np.uint32))
        rows = [(12, [int(x) for x in np.arange(12) + 100 * i]) for i in range(20)]
        if hot:
            counts.value[0] = hot
            counts = spark.sparkContext.broadcast(counts.value)
        cost[name] = jc.choose_boundary(spark.createDataFrame(rows, "n long, small array<long>"), counts)
    assert cost["rare"] < 12 <= cost["hot"]


def test_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert jc.op13_jaccard_join(spark, str(tmp_path)).collect() == []


def test_further_keys_stay_whole(spark):
    """Keys that are given besides a set's own keep all their 64 bits, and the sieve tells shared keys from others."""
    text = " ".join(f"w{i}" for i in range(400))
    s = jc.shingle_sets([text.encode()], 5)[0]
    counts = spark.sparkContext.broadcast(np.zeros(1 << jc.SKETCH_BITS, np.uint32))
    row = jc.large_keys(frame(spark, [(1, text)]), "text", counts, 5, 80, 100, ring_keys).first()
    own = jc.prefix_keys(s, counts.value, 80, 100).view(np.int64).tolist()
    assert row["keys"] == own + ring_keys(s).tolist()


def test_keys_whose_nodes_are_all_compared_leave(spark, monkeypatch):
    """A key of two unlike nodes is compared once, one of DRAWS nodes is not compared again after they were all drawn."""
    names, keep = [], jc.written
    monkeypatch.setattr(jc, "written", lambda df, name: names.append(name) or keep(df, name))
    nodes = [(i, 64, [1 << (i % 60) + 1]) for i in range(14)]
    members = [(8 << 20 | 1, 0), (8 << 20 | 1, 1), *[(8 << 20 | 2, i) for i in range(2, 2 + jc.DRAWS)]]

    def turns(rows):
        names.clear()
        values = keep(spark.createDataFrame(nodes, "node long, n long, v array<long>"), "t-values")
        held = keep(spark.createDataFrame([(k, i, 64) for k, i in rows], "key long, node long, n long"), "t-members")
        assert jc.link(held, values.select("node", "v"), values, F.lit(False), 85, 100, "t") is None
        return names.count("t-odd")

    assert [turns(members[:2]), turns(members)] == [0, 1]
