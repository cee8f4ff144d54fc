import hashlib
import random
import zlib

import numpy as np
import pytest

from loomwork.llm import merkle as mk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, h string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(d, text, lang, source, n):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, text)))


def tree_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        at = levels[-1]
        levels.append([sha("".join(at[i : i + 2])) for i in range(0, len(at), 2)])
    return levels


def climb(levels, i, h):
    siblings = []
    for at in levels[:-1]:
        run = at[i - i % 2 : i - i % 2 + 2]
        siblings += run[: i % 2] + run[i % 2 + 1 :]
        run[i % 2] = h
        h, i = sha("".join(run)), i // 2
    return siblings, h


def brute(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        langs[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r[:5])))
        trees[lang] = tree_of([leaf(*r[:5]) for r in langs[lang]])
    top = tree_of([trees[x][-1][0] for x in order])
    root, out = top[-1][0], []
    for k, lang in enumerate(order):
        for i, (d, text, _, source, n, *_) in enumerate(langs[lang]):
            hit = d is not None and n is not None and zlib.crc32(str(d).encode()) % 7 == 0
            s1, h = climb(trees[lang], i, leaf(d, text, lang, source, n + hit if n is not None else None))
            s2, h = climb(top, k, h)
            out.append((d, leaf(d, text, lang, source, n), trees[lang][-1][0], root, sha("".join(s1 + s2)), h, h == root))
    return sorted(out, key=str)


def run(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    return sorted(map(tuple, mk.op11_merkle_multiproof(spark, str(path)).collect()), key=str)


@pytest.mark.parametrize("levels", [12, 2])
def test_against_brute_force(spark, tmp_path, monkeypatch, levels):
    """Whole levels in one task, and blocks of four places in several rounds and leaf partitions."""
    monkeypatch.setattr(mk, "LEVELS", levels)
    monkeypatch.setattr(mk, "PART", levels)
    monkeypatch.setattr(mk, "FEW", 7)
    rnd = random.Random(3)
    rows = [(i, f"text {i} é", rnd.choice(["en", "de", "fr"]), rnd.choice(["a", None]), rnd.choice([i, None]), "t", "h") for i in range(83)]
    rows += [(5, "other", "en", "a", 1, None, None)] * 3 + [(None, None, None, None, None, None, None)] * 2
    rows += [(None, "", "en", "", 0, None, None), (900, "x" * 200_000, "zz", "a", 5, None, None), (901, "", "", "", 0, None, None), (-4, "ß", "~", "a", 2**63 - 2, None, None)]
    got = run(spark, tmp_path, rows)
    assert got == brute(rows)
    assert {r[-1] for r in got} == {True, False}


def test_sizes_of_trees(spark, tmp_path):
    for n in (1, 5):
        rows = [(i, str(i), "en", "s", i, None, None) for i in range(n)]
        assert run(spark, tmp_path / str(n), rows) == brute(rows)


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_octopus_is_least():
    """What is missing is what no asked leaf lies below, whose parent has an asked leaf below it."""
    rnd = random.Random(5)
    for n in range(1, 40):
        known = sorted(rnd.sample(range(n), rnd.randrange(1, n + 1)))
        got, size = mk.octopus(np.array(known), n), n
        for level, places in enumerate(got):
            above = {k >> level for k in known}
            assert places.tolist() == sorted(i ^ 1 for i in above if i ^ 1 < size and i ^ 1 not in above)
            size = (size + 1) // 2
        assert size == 1


def test_some_leaves_of_a_manifest(spark, monkeypatch):
    """Proofs of a few leaves fetch nodes of the lowest levels too; a changed leaf is told, its neighbours are not."""
    monkeypatch.setattr(mk, "LEVELS", 3)
    monkeypatch.setattr(mk, "PART", 4)
    rows = [(i, f"t{i}", "=en" if i % 3 else "=de", sha(str(i))) for i in range(100)]
    m = mk.manifest(spark.createDataFrame(rows, "doc_id long, text string, tree string, h string"), ["doc_id"])
    from pyspark.sql import functions as F

    some = m.leaves.where("doc_id in (1, 2, 40, 99)").withColumn("claim", F.when(F.col("doc_id") == 40, F.lit(sha("no"))).otherwise(F.col("h")))
    assert {r.id: r.verified for r in mk.proofs(m, some, "doc_id").collect()} == {1: True, 2: True, 40: False, 99: True}
