"""Effects against numpy, conformance to slots, fronts over several objectives, and designed experiments."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import effects as ef
from loomwork.operators import experiments as ex
from loomwork.operators import models as md
from loomwork.operators import process as pm
from loomwork.operators.steps import StepError


def solve(x, y):
    return np.linalg.lstsq(x, y, rcond=None)[0]


def units(spark, seed, drift=0.0, effect=4.0, n=24, periods=10, at=7):
    """A panel with unit levels, a common trend, and an effect from ``at`` on; some rows are missing and some come twice."""
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(n):
        level, treated = rng.normal(0, 3), int(u % 2)
        for t in range(periods):
            x = float(rng.normal())
            y = level + 0.7 * t + drift * treated * t + effect * treated * (t >= at) + 1.5 * x + rng.normal(0, 0.5)
            rows += [(u, treated, float(t), x, y)] * (0 if rng.random() < 0.1 else 2 if rng.random() < 0.1 else 1)
    return rows, spark.createDataFrame(rows, "unit int, treated int, t double, x double, y double")


def test_did_with_unit_and_period_effects_equals_dummies(spark):
    rows, df = units(spark, 3)
    u, d, t, x, y = map(np.array, zip(*rows))
    late = d * (t >= 7)
    dummies = np.column_stack([late, x, *[(u == k) for k in range(24)], *[(t == k) for k in range(1, 10)]]).astype(float)
    beta = solve(dummies, y)
    got = {r.term: r for r in ef.did_fixed(df, "y", "treated", "t", 7, "unit", ["x"]).collect()}
    assert [got["treated_after"].beta, got["x"].beta] == pytest.approx(beta[:2].tolist(), abs=1e-6)
    assert got["treated_after"].p < 1e-6 and abs(got["treated_after"].beta - 4) < 4 * got["treated_after"].se


def test_did_checks_tell_a_drift(spark):
    _, calm = units(spark, 5)
    _, drifting = units(spark, 6, drift=0.8)
    status = lambda df, at=7: {r.assumption: r.status for r in ef.did_checks(df, "y", "treated", "t", at, "unit").collect()}
    assert status(calm)["parallel_trends"] == "passed" and status(calm)["no_spillover"] == "not_testable"
    told = status(drifting)
    assert told["parallel_trends"] == told["placebo_date"] == "failed"
    trend = ef.did_pretrend(drifting, "y", "treated", "t", 7, "unit").first()
    assert trend.slope == pytest.approx(0.8, abs=0.25) and trend.implied_bias == pytest.approx(trend.slope * 5, rel=0.1)
    assert status(calm.where("t >= 5"))["parallel_trends"] == "not_testable"
    with pytest.raises(StepError):
        ef.cells(calm.where("t < 7"), "y", "treated", "t", 7)
    with pytest.raises(StepError):
        ef.did_placebo(calm.where("t >= 5"), "y", "treated", "t", 7)
    events = {r.time: (r.estimate, r.se) for r in ef.did_event_study(calm, "y", "treated", "t", 7).collect()}
    assert events[6.0] == (0.0, 0.0) and events[9.0][0] > events[2.0][0] + 2


def confounded(spark, n=3000):
    rng = np.random.default_rng(9)
    x, z = rng.normal(size=n), rng.normal(size=n)
    d = (rng.random(n) < 1 / (1 + np.exp(-x))).astype(int)
    y = 1 + 2 * d + 3 * x + 0.5 * z + rng.normal(size=n)
    return x, z, d, y, spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(x, z, d, y))], "i int, x double, z double, d double, y double")


def test_adjustment_overlap_and_refuters(spark):
    x, z, d, y, df = confounded(spark)
    one = np.ones(len(y))
    r = ef.adjust_effect(df, "y", "d", ["x", "z"]).first()
    assert r.naive == pytest.approx(solve(np.column_stack([one, d]), y)[1]) and r.estimate == pytest.approx(solve(np.column_stack([one, d, x, z]), y)[1])
    assert r.naive > 4 and r.estimate == pytest.approx(2, abs=0.15) and r.strongest == "x" and 0 < r.robustness_bound < r.robustness < 1
    f = abs(r.estimate / r.se) / math.sqrt(len(y) - 4)
    assert r.robustness == pytest.approx((math.sqrt(f**4 + 4 * f**2) - f**2) / 2)
    path = {p.adjusted_for: p.estimate for p in ef.adjust_path(df, "y", "d", ["x", "z"]).collect()}
    assert set(path) == {"", "x", "x,z", "z"} and path["z"] == pytest.approx(solve(np.column_stack([one, d, z]), y)[1]) and path["x,z"] == pytest.approx(r.estimate)
    outside = {o.confounder: o.outside for o in ef.adjust_range(df, "d", ["x", "z"]).collect()}
    assert outside["x"] == pytest.approx(np.mean((x[d == 1] < x[d == 0].min()) | (x[d == 1] > x[d == 0].max())))
    # scores by Newton's method
    m, b = np.column_stack([one, x, z]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-m @ b))
        b += np.linalg.solve((m.T * (p * (1 - p))) @ m, m.T @ (d - p))
    got = np.array([q.score for q in ef.propensity(df, "d", ["x", "z"]).orderBy("i").collect()])
    assert got == pytest.approx(1 / (1 + np.exp(-m @ b)), abs=1e-3)
    bins = ef.adjust_overlap(df, "d", ["x", "z"]).collect()
    assert sum(q.treated for q in bins) == d.sum() and sum(q.control for q in bins) == (1 - d).sum() and 0 <= bins[0].outside < 0.05
    cause = [q.effect for q in ef.refute_common_cause(df, "y", "d", ["x", "z"], ["i"], 12).collect()]
    subsets = [q.effect for q in ef.refute_subsets(df, "y", "d", ["x", "z"], ["i"], 0.8, 12).collect()]
    assert np.ptp(cause) > 0 and np.abs(np.array(cause) - r.estimate).max() < 0.01
    # spread of an 80 % subset about the estimate, from a loop
    rng = np.random.default_rng(1)
    loop = [solve(np.column_stack([one, d, x, z])[k], y[k])[1] for k in (rng.random(len(y)) < 0.8 for _ in range(200))]
    assert 0.4 < np.std(subsets) / np.std(loop) < 2 and abs(np.mean(subsets) - r.estimate) < 3 * np.std(loop)


@pytest.mark.parametrize("season", [None, 4])
def test_every_break_of_a_series_equals_its_own_fit(spark, season):
    rng = np.random.default_rng(2)
    rows = []
    for g in ("a", "b"):
        for t in range(36):
            rows.append((g, float(t + 100), 3 + 0.2 * t + 2 * (t % 4 == 1) + 5 * (t >= 20) + rng.normal(0, 0.3)))
    df = spark.createDataFrame(rows, "g string, t double, y double")
    got = {(r.g, r.time): r for r in ef.its_scan(df, "y", "t", ["g"], season).collect()}
    for g in ("a", "b"):
        t, y = map(np.array, zip(*[(r[1] - 100, r[2]) for r in rows if r[0] == g]))
        for c in range(3, 34):
            late = (t >= c).astype(float)
            m = np.column_stack([np.ones(36), t, *[(t % 4 == s) for s in range(1, season or 1)], late, late * (t - c)])
            b = solve(m, y)
            r = got[g, c + 100.0]
            assert (r.level, r.slope) == pytest.approx((b[-2], b[-1]), abs=1e-6)
            s2 = ((y - m @ b) ** 2).sum() / (36 - m.shape[1])
            assert r.se == pytest.approx(math.sqrt(s2 * np.linalg.inv(m.T @ m)[-2, -2]), rel=1e-6)
        cf = {r.time: r for r in ef.its_counterfactual(df.where(F.col("g") == g), "y", "t", 120, ["g"], season).collect()}
        late = (t >= 20).astype(float)
        m = np.column_stack([np.ones(36), t, late, late * (t - 20), *[(t % 4 == s) for s in range(1, season or 1)]])
        b = solve(m, y)
        assert [cf[k + 100.0].fitted for k in t] == pytest.approx((m @ b).tolist())
        b[2:4] = 0
        assert [cf[k + 100.0].counterfactual for k in t] == pytest.approx((m @ b).tolist())
        assert all(r.p > 1e-4 for (k, at), r in got.items() if k == g and at < 110) or season is None
    assert ef.its_placebo(df, "y", "t", 120, ["g"], season).where("time >= 120").count() == 0


def test_slots_in_any_order_and_optional(spark):
    traces = {"ok": "ABCE", "swapped": "ACBE", "full": "ABCDE", "no_c": "ABE", "early_d": "ADBCE", "foreign": "ABCXE", "twice": "ABBCE"}
    rows = [(c, a, i, f"{c}{i}") for c, w in traces.items() for i, a in enumerate(w)]
    log = spark.createDataFrame(rows, '`case` string, activity string, `end` int, row_id string').withColumn("end", F.timestamp_seconds("end")).withColumn("start", F.lit(None).cast("timestamp"))
    slots = [pm.slot("A"), pm.slot("B", "C"), pm.slot(optional=("D",)), pm.slot("E")]
    got = {(r.kind, r.detail): r.cases for r in pm.slot_summary(pm.slot_deviations(log, slots)).collect()}
    assert got == {("fits", ""): 3, ("skipped", "C"): 1, ("inserted", "X"): 1, ("repeated", "B"): 1, ("reordered", "D before B"): 1, ("reordered", "D before C"): 1}
    with pytest.raises(ValueError):
        pm.slot_deviations(log, [pm.slot("A"), pm.slot("A")])


@pytest.mark.parametrize("shape", ["random", "front", "ties"])
def test_skyline(spark, shape):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(400, 3))
    if shape == "front":
        points[:, 2] = -points[:, 0] - points[:, 1]  # nobody beats anybody
    if shape == "ties":
        points = rng.integers(0, 4, (400, 3)).astype(float)
    rows = [(i, *map(float, p)) for i, p in enumerate(points)] + [(900, None, 1.0, 1.0), (901, math.nan, -99.0, -99.0)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double").repartition(5)
    want = {i for i, p in enumerate(points) if not any((q <= p).all() and (q < p).any() for q in points)}
    assert {r.i for r in md.skyline(df, ["a", "b", "c"]).collect()} == want


def test_lack_of_fit_and_lenth(spark):
    rng = np.random.default_rng(8)
    grid = [(a, b) for a in (-1.0, 0.0, 1.0) for b in (-1.0, 1.0) for _ in range(4)]
    y = [2 + a + 0.5 * b + 3 * a * a + rng.normal(0, 0.2) for a, b in grid]
    df = spark.createDataFrame([(*g, v) for g, v in zip(grid, y)], "a double, b double, y double")
    r = ex.lack_of_fit(df, ["a", "b"], "y").first()
    m = np.array([(1, a, b, a * b) for a, b in grid])
    rss = ((np.array(y) - m @ solve(m, np.array(y))) ** 2).sum()
    pure = sum(np.var([v for g, v in zip(grid, y) if g == k]) * 4 for k in set(grid))
    assert (r.rss, r.ss_pure, r.dof, r.dof_pure, r.dof_lack) == pytest.approx((rss, pure, 20, 18, 2)) and r.p < 1e-9
    assert r.f == pytest.approx((rss - pure) / 2 / (pure / 18))
    assert ex.lack_of_fit(df.dropDuplicates(["a", "b"]), ["a", "b"], "y").first().f is None
    two = [(a, b, c) for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)]
    flat = spark.createDataFrame([(*t, 5 * t[0] + 0.1 * t[1] - 0.2 * t[2] + 0.05 * t[0] * t[1]) for t in two], "a int, b int, c int, y double")
    out = {x.term: x for x in ex.lenth(flat, ["a", "b", "c"], "y").collect()}
    effects = np.abs([10, 0.2, -0.4, 0.1, 0, 0])
    s0 = 1.5 * np.median(effects)
    pse = 1.5 * np.median(effects[effects < 2.5 * s0])
    assert out["a"].pse == pytest.approx(pse) and [t for t, x in out.items() if x.active] == ["a"] and out["a"].simultaneous > out["a"].margin


def test_parameters_of_activities(spark):
    rows = [("c1", "a", 0, 60, "r1"), ("c1", "b", None, 120, "r2"), ("c2", "a", 30, 90, "r1"), ("c2", "b", 100, 160, None), ("c3", "a", 90, 80, "r3")]
    log = spark.createDataFrame([(c, a, s, e, r, f"{i}") for i, (c, a, s, e, r) in enumerate(rows)], '`case` string, activity string, start int, `end` int, resource string, row_id string')
    log = log.withColumns({c: F.timestamp_seconds(F.col(c) * 60) for c in ("start", "end")})
    got = {r.activity: r for r in pm.activity_parameters(log).collect()}
    a, b = got["a"], got["b"]
    assert (a.visits, a.basis, a.samples, a.servers, a.servers_basis) == (3, "service", 3, 2, "resources") and a.mean_hours == pytest.approx(2 / 3, abs=1e-6)
    assert (b.basis, b.samples, b.servers) == ("elapsed", 2, None) and b.mean_hours == pytest.approx((60 + 70) / 120, abs=1e-6)
    alone = {r.activity: r for r in pm.activity_parameters(log.where("activity = 'a' and `case` <> 'c3'").withColumn("resource", F.lit(None).cast("string"))).collect()}
    assert (alone["a"].servers, alone["a"].servers_basis) == (2, "concurrency")
