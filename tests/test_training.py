"""Stratified splits, cross-validation, stored models, records of mixed types and folders."""

import pytest
from pyspark.sql import functions as F

from loomwork.operators import training as tr
from loomwork.operators.steps import StepError
from loomwork.sources import readers as rd


@pytest.fixture(scope="module")
def rows(spark):
    made = [(i, "rare" if i % 50 == 0 else "often", float(i % 13), f"c{i % 3}", 4.0 * (i % 13) + (i % 3) + 1) for i in range(600)]
    made += [(1000, "once", 1.0, "c0", 5.0), (1001, None, 2.0, "c1", 9.0), (1002, None, None, None, 3.0)]
    return spark.createDataFrame(made, "id long, kind string, x double, c string, y double")


def test_every_class_is_split_exactly(rows):
    cut = tr.split(rows, "kind", ["id"])
    got = {r.kind: (r.n, r.t) for r in cut.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("held_out").alias("t")).collect()}
    assert got == {"rare": (12, 2), "often": (588, 118), "once": (1, 0), None: (2, 1)}
    again = tr.split(rows.repartition(7), "kind", ["id"]).where("held_out")
    assert {r.id for r in again.collect()} == {r.id for r in cut.where("held_out").collect()}
    assert cut.columns == [*rows.columns, "held_out"]


def test_folds_hold_each_row_once(rows):
    out = tr.cross_validate(rows, "y", ["x", "c"], ["id"], "linear", 4).collect()
    assert [r.fold for r in out] == [0, 1, 2, 3] and sum(r.n for r in out) == 603 and max(r.n for r in out) - min(r.n for r in out) <= 1
    assert all(r.metric == "r2" and r.value > 0.98 for r in out)


def test_fit_is_checked(rows, spark):
    good = tr.fit_check(rows.where("x is not null"), "y", ["x", "c"], ["id"]).first()
    assert good.verdict == "balanced" and good.train > 0.98 and good.cross_validated > 0.98 and abs(good.gap) < 0.05
    noise = rows.where("id < 200").withColumn("y", F.pmod(F.xxhash64("id"), F.lit(1000)) / 7.0)
    assert tr.fit_check(noise, "y", ["x"], ["id"]).first().verdict == "underfitting"
    wide = noise.where("id < 60").withColumn("x", F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(100_000)) / 1.0)
    found = tr.fit_check(wide, "y", ["x"], ["id"], "gradient_boosting", 2).first()
    assert found.verdict == "overfitting" and found.gap > 0.15


def test_models_are_kept_by_name(rows, spark):
    told = tr.train_saved(rows, "y", ["x", "c"], ["id"], "line").first()
    model, about = tr.load_model(spark.newSession(), "line")
    assert about["features"] == ["x", "c"] and about["task"] == "regression" and about["held_out"] == told.n and about["value"] == told.value > 0.99
    got = tr.predict_saved(rows.where("id < 100"), "line")
    assert got.columns == [*rows.columns, "prediction"] and got.where("abs(prediction - y) > 0.3").count() == 0
    easy = rows.where("kind is not null").withColumn("big", F.when(F.col("x") > 6, "yes").otherwise("no"))
    tr.train_saved(easy, "big", ["x"], ["id"], "line", "logistic")  # takes the place of the other
    named = tr.predict_saved(easy, "line")
    assert {r.prediction for r in named.select("prediction").distinct().collect()} == {"yes", "no"} and named.where("prediction <> big").count() < 5
    with pytest.raises(StepError):
        tr.predict_saved(rows.drop("x"), "line")
    with pytest.raises(StepError):
        tr.load_model(spark, "../line")


def test_records_of_mixed_types(spark):
    lines = [
        '{"a":1,"b":{"c":"x","d":1.5},"l":[1,2],"t":0,"u":129600}', '{"a":2.5,"b":{"c":7},"m":true,"t":10,"u":300000}', "no json", None,
        '{"a":null,"b":3,"q r":"z","e":{"f":{"g":1}},"z":null}', "[1]", "{}",
    ]
    out = rd.read_mixed_records(spark.createDataFrame([(x,) for x in lines], "j string"), "j", ["t"], {"days": ("t", "u")})
    assert dict(out.dtypes) == {
        "a": "double", "b": "string", "b_c": "string", "b_d": "double", "e_f_g": "bigint", "l": "string", "m": "boolean", "q r": "string", "t": "timestamp", "u": "bigint", "z": "string", "days": "double",
    }
    got = [tuple(r) for r in out.select("a", "b", "b_c", "e_f_g", "l", "q r", "days").collect()]
    none = (None,) * 7
    assert got == [(1.0, '{"c":"x","d":1.5}', "x", None, "[1,2]", None, 1.5), (2.5, '{"c":7}', "7", None, None, None, 3.5), none, none, (None, "3", None, 1, None, "z", None), none, none]


def test_files_of_a_folder_by_header(spark, tmp_path):
    for name, text in (("a b.csv", "x,y\n1,2\n"), ("c.csv", "x,y\n3,4\n"), ("d+e.csv", "y,z\n5,6\n"), ("skip.txt", "q\n1\n")):
        (tmp_path / name).write_text(text)
    got = {(r.source_file.replace("%20", " "), r.x, r.y, r.z) for r in rd.read_folder(spark, str(tmp_path)).collect()}
    assert got == {("a b.csv", "1", "2", None), ("c.csv", "3", "4", None), ("d+e.csv", None, "5", "6")}


def test_slices_give_the_order_of_the_whole_class(rows):
    n = 600
    got = tr.ranked(rows, "kind", ["id"]).select("id", "kind", "_place", "_size", F.xxhash64(F.lit(42), "id").alias("h")).collect()
    for kind in {r.kind for r in got}:
        mine = sorted((r for r in got if r.kind == kind), key=lambda r: (r.h, r.id))
        assert [r._place for r in mine] == list(range(len(mine))) and {r._size for r in mine} == {len(mine)}
    assert len(got) == n + 3


def test_equal_rows_weigh_as_often_as_they_stand(rows):
    easy = rows.where("x is not null").withColumn("big", F.when((F.col("x") > 6) != (F.col("id") % 10 == 0), "yes").otherwise("no"))
    got = tr.cross_validate(easy, "big", ["x"], ["id"], "logistic", 3).collect()
    assert sum(r.n for r in got) == easy.count() and all(0.85 < r.value < 0.95 for r in got)


def test_prepared_rows_are_spread_by_size(rows, monkeypatch):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression, RandomForestRegressor

    from loomwork.operators import models as md

    ready = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(rows.where("x is not null")).withColumn("_k", F.xxhash64("id")).coalesce(1)
    monkeypatch.setattr(md, "TASK_BYTES", 8000)
    wide = md.spread(ready, RandomForestRegressor())
    assert wide.rdd.getNumPartitions() == 7 and max(wide.rdd.glom().map(len).collect()) < 150 and wide.count() == 602
    assert md.spread(ready, LinearRegression()) is ready


def test_leaves_by_masks_are_those_of_the_tree():
    import numpy as np

    from loomwork.operators.models import _masks

    rng = np.random.default_rng(4)
    tree = lambda d: float(rng.random()) if d == 0 or rng.random() < 0.1 else (int(rng.integers(3)), float(rng.integers(8)), tree(d - 1), tree(d - 1))
    t = (0, 3.0, tree(7), tree(7))
    leaves, by = _masks(t, 3)
    assert len(leaves) > 64
    for x in [*rng.integers(-1, 9, (300, 3)).astype(float), np.array([np.nan, 1.0, 2.0])]:
        node = t
        while isinstance(node, tuple):
            node = node[2] if x[node[0]] < node[1] else node[3]
        bits = np.unpackbits(np.bitwise_and.reduce([m[np.searchsorted(c, v, side="right")] for (c, m), v in zip(by, x)]).view(np.uint8), bitorder="little")
        assert leaves[bits.argmax()] == node


def test_masks_come_in_small_batches(spark, monkeypatch):
    from loomwork.operators import textjobs as tj

    monkeypatch.setattr(tj, "MASK_ROWS", 2)
    df = spark.createDataFrame([(1, "a@b.com x"), (2, None), (3, "plain"), (4, ""), (5, "x a@b.com")], "i int, t string").coalesce(1)
    assert [tuple(r) for r in tj.mask(df, "i", "t").orderBy("id").collect()] == [(1, "[email] x"), (2, ""), (3, "plain"), (4, ""), (5, "x [email]")]
