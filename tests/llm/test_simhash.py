import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from loomwork.llm import simhash as sh
from loomwork.llm.simhash import dedup_simhash, fingerprint, pigeonring_classes, simhash_components

SCHEMA = "doc_id long, text string, component_id string"


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    votes = Counter(b for s in sh for b in range(64) if xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(sh))


def brute(rows):
    fp = [plain(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= 4:
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return Counter((d, fp[i], min((x for x in groups[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows))


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(5, None), (9, ""), (None, "a b"), (None, None), (7, "Zwölf boxer JAGEN"), (7, "Zwölf boxer JAGEN"), (3, "x " * 70_000)]
    df = spark.createDataFrame([(a, b, "clash") for a, b in rows], SCHEMA)
    got = Counter((r.id, r.fp & (2**64 - 1), r.component_id) for r in simhash_components(df).collect())
    assert got == brute(rows)


def test_links_are_complete(spark):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for k in range(1, 8):
            fps.add(b ^ sum(1 << i for i in rnd.sample(range(64), k)))
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    got = {}
    for r in pigeonring_classes(spark.createDataFrame([(x,) for x in signed], "fp long")).collect():
        got.setdefault(r.root, set()).add(r.node)
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 4}
    assert {frozenset(g) for g in got.values()} == {c for c in classes(signed, want) if len(c) > 1}


def classes(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    groups = {}
    for n in nodes:
        groups.setdefault(find(n), set()).add(n)
    return {frozenset(g) for g in groups.values()}


def test_every_near_pair_shares_a_key():
    rnd = random.Random(11)
    for _ in range(2000):
        a = rnd.getrandbits(64)
        b = a ^ sum(1 << i for i in rnd.sample(range(64), rnd.randrange(1, 5)))
        keys = sh._key_columns(np.array([[a], [b]], dtype=np.uint64))
        assert (keys[0] == keys[1]).any()


def test_long_texts_are_hashed_in_blocks():
    text = " ".join(str(i) for i in range(40_000))
    assert fingerprint(text.encode()) & (2**64 - 1) == plain(text)


def test_dedup_keeps_one_of_each_group(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, "other words here now again"), (3, "other words here now again"), (None, "a b c d e f"), (4, None), (5, "")]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], SCHEMA)
    out = dedup_simhash(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4]
    only = spark.createDataFrame([(None, "p q r s", "x"), (None, "p q r s", "x")], SCHEMA)
    assert [tuple(r) for r in dedup_simhash(only).collect()] == [(None, "p q r s", "x")]
    clash = spark.createDataFrame([(1, "a b", "x", 1, 2)], "doc_id int, text string, node string, row int, _rank int")
    out = dedup_simhash(clash)
    assert out.schema == clash.schema and out.count() == 1


def like(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_dedup_by_likeness(spark):
    """Every near copy goes, from a likeness of 0.8 on; nothing unlike goes; a chain of near copies is one group."""
    rnd = random.Random(17)
    rows, pairs = [], []
    for goal in (0.81, 0.83, 0.9, 0.6):
        for _ in range(40):
            a = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(12, 300))]
            b = list(a)
            while like(" ".join(a), " ".join(b)) > goal + 0.02:
                b[rnd.choice([0, 1, len(b) - 1, rnd.randrange(len(b))])] = f"x{rnd.randrange(5000)}"
            i = len(rows)
            rows += [(i, " ".join(a)), (i + 1, " ".join(b))]
            pairs.append((i, like(rows[i][1], rows[i + 1][1])))
    chain = [f"c{i}" for i in range(300)]
    for i in range(100):
        chain[rnd.randrange(300)] = f"d{i}"
        rows.append((10_000 + i, " ".join(chain)))
    # one shingle that makes up most of a text says nothing about the rest
    rows += [(20_000 + i, "row " * 120 + " ".join(f"{'ab'[i]}{k}" for k in range(60))) for i in range(2)]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], SCHEMA).repartition(6)
    kept = {r.doc_id for r in dedup_simhash(df).collect()}
    assert sum(10_000 <= d < 20_000 for d in kept) == 1 and {20_000, 20_001} <= kept
    assert all(i in kept for i, _ in pairs)
    assert [i + 1 in kept for i, _ in pairs] == [x < 0.8 for _, x in pairs]
    assert sum(0.8 <= x < 0.85 for _, x in pairs) > 50


def test_dedup_decides_by_row(spark):
    """Rows that share an id or have none are decided by their own texts."""
    text = {c: " ".join(f"{c}{i}" for i in range(40)) for c in "abcdefg"}
    near = text["a"] + " more"
    rows = [
        (1, text["a"]), (6, text["a"]), (6, text["b"]), (2, text["c"]), (2, text["d"]), (7, near), (7, near), (7, text["e"]), (8, text["e"]),
        (None, text["f"]), (None, text["f"]), (None, text["g"]), (None, near), (9, text["g"]), (3, text["b"] + " x"), (None, None), (4, None), (4, ""), (5, "one"),
    ]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], SCHEMA).repartition(3)
    out = dedup_simhash(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, (r.text or "")) for r in out.collect()), key=str)
    want = [(1, text["a"]), (3, text["b"] + " x"), (2, text["c"]), (2, text["d"]), (7, text["e"]), (None, text["f"]), (9, text["g"]), (4, ""), (5, "one")]
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash_components(df).count() == 0
    assert dedup_simhash(df).where(F.lit(True)).count() == 0
