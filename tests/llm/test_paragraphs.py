import random

import numpy as np
from pyspark.sql import functions as F

from loomwork.llm import paragraphs as pg
from loomwork.llm.common import connect

SCHEMA = "doc_id long, text string, cluster string"


def words(rnd, n):
    return " ".join(rnd.choice("aeiou") + str(rnd.randrange(10**6)) for _ in range(n))


def brute(rows):
    """Clusters by comparing all paragraphs: set of frozensets of (id, para)."""
    occ = [((d, i), set(pg.shingles(h).tolist())) for d, t in rows for i, (_, _, h) in enumerate(pg.paragraphs((t or "").encode()))]
    group = {i: {i} for i in range(len(occ))}
    for i in range(len(occ)):
        for j in range(i):
            a, b = occ[i][1], occ[j][1]
            if len(a & b) / len(a | b) >= pg.THRESHOLD - 1e-9 and group[i] is not group[j]:
                group[i] |= group[j]
                for k in group[j]:
                    group[k] = group[i]
    return {frozenset(occ[k][0] for k in g) for g in group.values() if len(g) > 1}


def clusters(df):
    got = {}
    for r in pg.repeated_paragraphs(df).collect():
        got.setdefault(r.cluster, set()).add((r.id, r.para))
    return {frozenset(x) for x in got.values()}


def near(rnd):
    rows = [(i, words(rnd, rnd.randrange(1, 90)) + "\n" + words(rnd, 30)) for i in range(30)]
    base = words(rnd, 11)
    for i in range(120):  # short texts that share shingles: ends changed, so that some are near and some are not
        w = base.split()
        w[rnd.choice([0, -1, 1, -2, 5])] = f"x{rnd.randrange(40)}"
        rows.append((100 + i, " ".join(w)))
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = near(random.Random(5))
    rows += [(900, None), (901, ""), (902, rows[3][1]), (903, rows[3][1]), (904, "é " * 50_000)]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], SCHEMA)
    want = brute(rows[:-1])
    got = {c for c in clusters(df) if not any(d == 904 for d, _ in c)}
    lost = [c for c in want if c not in got]
    assert len(lost) <= 0.01 * len(want) + 1 and sum(map(len, got)) >= 0.99 * sum(map(len, want))
    monkeypatch.setattr(pg, "HOT", 8)  # the other way of pairing finds the same links
    assert {c for c in clusters(df) if not any(d == 904 for d, _ in c)} == got


def test_passages_inside_other_text_are_caught_and_clean_texts_left_alone(spark):
    rnd = random.Random(9)
    passages = [words(rnd, 55) for _ in range(8)]
    rows = []
    for i in range(80):
        text = words(rnd, rnd.randrange(20, 120))
        if i < 40:
            text += " " + passages[i % 8] + " " + words(rnd, rnd.randrange(20, 120))
        rows.append((i, text))
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], SCHEMA)
    out = pg.repeated_paragraphs(df)
    found = {r.id for r in out.collect()}
    assert found == set(range(40))
    text = dict(rows)
    for r in out.where(F.col("removed")).collect():
        assert text[r.id][r["first"] : r["last"]].split() and r.keep_id < r.id
        assert len(text[r.id][r["first"] : r["last"]].split()) == r.n_words


def test_bands_reach_the_recall():
    assert 1 - (1 - pg.THRESHOLD**pg.ROWS) ** pg.BANDS >= pg.RECALL
    rng = np.random.default_rng(0)
    hits = []
    for _ in range(300):
        a = rng.integers(0, 2**63, 60).astype(np.uint64)
        b = a.copy()
        b[-4:] = rng.integers(0, 2**63, 4).astype(np.uint64)
        keys = pg.band_keys(pg.Units(np.append(a, b), *[np.zeros(2, int)] * 2, np.array([0, 60]), np.array([60, 120]), *[np.zeros(2, int)] * 3))
        hits.append((keys[0] == keys[1]).any())
    assert np.mean(hits) > 0.98


def test_empty_table_and_null_ids(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert pg.repeated_paragraphs(df).count() == 0
    same = "one two three four five six seven eight nine"
    got = pg.repeated_paragraphs(spark.createDataFrame([(None, same, "x"), (4, same, "x"), (4, same, "x")], SCHEMA)).collect()
    assert len(got) == 3 and all(r.keep_id == 4 for r in got)
    assert sorted((r.id or 0, r.removed) for r in got) == [(0, True), (4, False), (4, True)]


def test_near_lines_are_linked_whole(spark):
    """All pairs of uncut lines by exact likeness; one or two words changed cut pieces below the threshold."""
    rnd = random.Random(21)
    rows = []
    for i in range(60):
        base = words(rnd, rnd.choice([45, 60, 90, 120])).split()
        for j in range(2):
            w = list(base)
            for at in rnd.sample(range(len(w)), j * rnd.choice([1, 1, 2])):
                w[at] = f"edit{i}"
            rows.append((2 * i + j, words(rnd, 20) + "\n" + " ".join(w) + "\n" + words(rnd, 12)))
    got = pg.repeated_paragraphs(spark.createDataFrame([(a, b, "x") for a, b in rows], SCHEMA)).collect()
    text = dict(rows)
    marked = {(r.id, text[r.id][r["first"] : r["last"]]) for r in got if r.removed}
    like, caught = 0, 0
    for i in range(60):
        a, b = (text[2 * i + j].split("\n")[1] for j in range(2))
        sa, sb = ({tuple(x.split()[k : k + 5]) for k in range(len(x.split()) - 4)} for x in (a, b))
        if len(sa & sb) / len(sa | sb) >= 0.8:
            like += 1
            caught += (2 * i + 1, b) in marked
        else:
            assert (2 * i + 1, b) not in marked
    assert like >= 30 and caught >= 0.97 * like


def test_short_lines_and_short_pieces_are_not_lost(spark):
    rnd = random.Random(33)
    verse = "\n".join(words(rnd, 5) for _ in range(6))
    headed = words(rnd, 3) + "\n" + words(rnd, 25)
    rows = [(i, words(rnd, 40) + "\n" + t + "\n" + words(rnd, 40)) for i, t in enumerate([verse, verse, headed, headed])]
    rows += [(4, "three short words"), (5, "three short words"), (6, "Ünïcode wörds ïn ä shört lïne"), (7, "Ünïcode wörds ïn ä shört lïne")]
    text = dict(rows)
    out = pg.repeated_paragraphs(spark.createDataFrame([(a, b, "x") for a, b in rows], SCHEMA)).where("removed").collect()
    spans = {(r.id, text[r.id][r["first"] : r["last"]]) for r in out}
    assert {(1, verse), (3, headed), (5, rows[5][1]), (7, rows[7][1])} <= spans and {d for d, _ in spans} == {1, 3, 5, 7}
    for _ in range(200):
        h = np.array([rnd.getrandbits(64) for _ in range(rnd.randrange(7, 200))], dtype=np.uint64)
        cuts = [0, *pg.piece_starts(h, np.array([0]), np.array([len(h)])), len(h)]
        assert all(z - a >= pg.MIN_WORDS for a, z in zip(cuts, cuts[1:]))


def test_a_large_group_of_near_copies_is_one_cluster(spark):
    rnd = random.Random(2)
    base = words(rnd, 60).split()
    rows = []
    for i in range(800):
        w = list(base)
        w[rnd.randrange(60)] = f"edit{i}"
        rows.append((i, " ".join(w), "x"))
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    got = [r for r in pg.repeated_paragraphs(df).collect() if r.n_words == 60]
    assert len(got) == 800 and len({r.cluster for r in got}) == 1 and sum(not r.removed for r in got) == 1
    texts = [(k, h, s) for k in (0, 4) for h, s in ((i, sorted(map(hash, [f"{t}" for t in range(40)] + [f"{i}"]))) for i in range(500))]
    members = spark.createDataFrame(texts, "key long, node long, value array<long>")
    got = {r.node: r.root for r in pg.classes_of(members).collect()}
    assert got == {i: 0 for i in range(500)}


def test_connect_finds_all_components_with_few_links(spark):
    rnd = random.Random(8)
    rows = [(k, n, v) for k in range(3) for n, v in ((i, rnd.randrange(200 * (k + 1) ** 3)) for i in range(400))]
    near = lambda a, b: F.abs(a - b) <= 1
    parent = {n: n for n in range(400)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    value = {(k, n): v for k, n, v in rows}
    for k in range(3):
        for a in range(400):
            for b in range(a):
                if abs(value[k, a] - value[k, b]) <= 1:
                    parent[find(a)] = find(b)
    df = spark.createDataFrame(rows, "key long, node long, value long")
    got = {}
    for r in connect(df, near, "test").collect():
        got.setdefault(r.root, set()).add(r.node)
    want = {}
    for n in range(400):
        want.setdefault(find(n), set()).add(n)
    assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in want.values() if len(g) > 1}
    assert all(root == min(g) for root, g in got.items())
