"""Small literal tables for what SQL does not cover."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomwork.functions import tails
from loomwork.operators import migrate as mg
from loomwork.operators import models as md
from loomwork.operators import semantic as sm
from loomwork.operators import stats as sa
from loomwork.operators import steps as st
from loomwork.operators import textjobs as tj
from loomwork.plans.source_queries import dataset
from loomwork.plans.versions import linear


def test_contracts_name_what_is_wrong(spark):
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    for op, params in (("filtr", {}), ("select", {"column": ["id"]}), ("select", {}), ("rename", {"mapping": {"nam": "x"}}), ("drop", {"columns": ["id", "name"]})):
        with pytest.raises(st.StepError):
            st.apply_step(df, op, params)


def test_forward_fill_over_ranges(spark):
    rows = [(i, float(i) if i % 37 == 0 else None) for i in range(300)]
    got = st.forward_fill(spark.createDataFrame(rows, "k long, v double").repartition(5), "v", ["k"], []).collect()
    assert {r.k: r.v for r in got} == {i: float(i - i % 37) for i in range(300)}


def test_claims_over_two_keys(spark):
    rows = [(i, random.Random(i).randrange(12), random.Random(i + 99).randrange(12)) for i in range(40)]
    plan = {"a": ("a", "INTEGER"), "b": ("b", "INTEGER")}
    got = {r.rid: r.reason for r in mg.load(spark.createDataFrame(rows, "rid long, a long, b long"), plan, "rid", primary=["a"], unique=[["b"]]).collect()}
    seen_a, seen_b, want = set(), set(), {}
    for i, a, b in rows:
        want[i] = "duplicate_primary_key" if a in seen_a else "duplicate_unique_key" if b in seen_b else None
        if want[i] is None:
            seen_a.add(a)
            seen_b.add(b)
    assert got == want


def test_load_order():
    assert mg.load_order({"line": ["order"], "order": ["customer"], "customer": []}) == ["customer", "order", "line"]
    with pytest.raises(ValueError):
        mg.load_order({"a": ["b"], "b": ["a"]})


def test_versions(spark):
    d = dataset(spark.createDataFrame([(1, None), (2, 5)], "id int, v int"), "small")
    d.apply("fill_null", {"column": "v", "value": 0})
    d.apply("filter", {"expr": "v > 0"})
    assert d.frame().count() == 1 and d.move(-1) == 1 and d.frame().count() == 2
    d.move(1)
    told = d.refresh(spark.createDataFrame([(1,)], "id int"))
    assert told["applied"] == 0 and told["stopped_at"]["op"] == "fill_null" and spark.table("small").count() == 1
    with pytest.raises(st.StepError):
        linear({"a": {"op": "source"}, "b": {"op": "x"}, "c": {"op": "y"}}, [("a", "b"), ("a", "c")])


def test_semantic_validation(spark):
    df = spark.createDataFrame([(1, "x")], "v int, g string")
    bad = sm.Model({"g": "g", "h": "nope"}, {"m": "sum(v)", "n": ("n", "-1 month"), "o": ("m", "soon")})
    assert len(sm.validate(df, bad)) == 3 and sm.validate(df, sm.Model({"g": "g"}, {"m": "sum(v)"})) == []


def test_tails():
    assert abs(tails.t_tail(2.228138852, 10) - 0.05) < 1e-8 and abs(tails.normal_tail(1.959963985) - 0.05) < 1e-8
    assert abs(tails.chi2_tail(3.841458821, 1) - 0.05) < 1e-8 and abs(tails.f_tail(4.964602744, 1, 10) - 0.05) < 1e-7
    assert abs(tails.t_quantile(0.95, 10) - 2.228138852) < 1e-6 and abs(tails.binom_two_sided(8, 10, 0.5) - 0.109375) < 1e-9


def test_ols_recovers_parameters(spark):
    rnd = random.Random(1)
    rows = [(x, z, 3 * x - 2 * z + 5 + rnd.gauss(0, 0.1), i % 10, i) for i in range(400) for x, z in [(rnd.random(), rnd.random())]]
    df = spark.createDataFrame(rows, "x double, z double, y double, g int, t int")
    for cov, more in (("classical", {}), ("HC3", {}), ("cluster", {"groups": "g"}), ("HAC", {"order_by": ["t"]})):
        fit = {r.term: (r.beta, r.se) for r in sa.ols(df, "y", ["x", "z"], cov, **more).collect()}
        assert all(abs(fit[k][0] - v) < 0.1 and 0 < fit[k][1] < 0.1 for k, v in (("x", 3), ("z", -2), ("intercept", 5)))


def test_forecast_and_anomalies(spark):
    rows = [("a", i, 100.0 + i + 10 * math.sin(i * math.pi / 6)) for i in range(48)]
    out = md.forecast(spark.createDataFrame(rows, "g string, period int, value double"), ["g"]).collect()
    assert all(abs(r.forecast - (100 + 47 + r.step + 10 * math.sin((47 + r.step) * math.pi / 6))) < 5 for r in out)
    pts = [(i, random.Random(i).gauss(0, 1), random.Random(-i).gauss(0, 1)) for i in range(400)] + [(999, 15.0, 15.0)]
    odd = md.isolation_forest(spark.createDataFrame(pts, "id int, x double, y double"), ["x", "y"], ["id"], trees=40)
    assert odd.orderBy(F.desc("anomaly_score")).first().id == 999


def test_personal_data():
    text = "a@b.org, 12345678Z not 12345678A, DE89370400440532013000, 4111111111111111, 4111111111111112"
    assert [k for _, _, k in tj.pii_spans(text, ["email", "dni", "iban", "card"])] == ["email", "dni", "iban", "card"]


def test_company_numbers():
    # digits 1234567 have the control 4, the letter D; A to H take digits, P letters, C both
    good, bad = ["A58818501", "B12345674", "P1234567D", "C12345674", "C1234567D"], ["A58818502", "B1234567D", "P12345674", "C12345675", "K12345674"]
    assert [tj.pii_spans(f"({x})", ["cif"]) for x in good] == [[(1, 10, "cif")]] * len(good)
    assert [tj.pii_spans(f"({x})", ["cif"]) for x in bad] == [[]] * len(bad)


def test_amounts_by_the_mark_of_their_column(spark):
    def read(values):
        df = spark.createDataFrame(list(enumerate(values)), "i int, a string")
        mark = tj.decimal_mark(df, "a").first()
        return mark, [r.v for r in tj.parse_amounts(df, "a", "v").orderBy("i").collect()]

    spanish = ["1.234", "12,5", "1.234.567", "9.999,95", "-0,125", None, "none", "7", "12."]
    assert read(spanish) == ((",", 0, 4), [1234.0, 12.5, 1234567.0, 9999.95, -0.125, None, None, 7.0, 12.0])
    english = ["1.234", "12.5", "1,234", "1,234.5"]
    assert read(english) == ((".", 2, 0), [1.234, 12.5, 1234.0, 1234.5])
    assert read(["1.234", "1,234"]) == ((None, 0, 0), [1234.0, 1234.0])
    assert read([]) == ((None, 0, 0), [])


def test_trend_findings(spark):
    rng = random.Random(5)
    rows = [(f"2024-01-{d:02d}", g, value) for d in range(1, 11) for g, value in (("up", 10.0 * d), ("flat", 50.0 + rng.random()), (None, 1.0)) for _ in range(5)]
    rows += [("2024-01-20", "up", 1e6)] * 4 + [(None, "up", 1.0), ("2024-01-21", "up", None)]  # a period of four rows, rows without a date or value
    df = spark.createDataFrame(rows, "d string, g string, v double").withColumn("d", F.to_date("d"))
    got = {r.g: r for r in sa.trend_findings(df, "d", "v", "g").collect()}
    assert set(got) == {None, "up", "flat"} and {r.grain for r in got.values()} == {"day"} and {r.periods for r in got.values()} == {10}
    assert abs(got["up"].r - 1) < 1e-9 and got["up"].found and got["up"].p < 1e-6 and got[None].found and not got["flat"].found
    assert {r.g for r in sa.trend_findings(df, "d", "v", "g", top=1).collect()} == {None, "up"}
    assert [tuple(r) for r in sa.trend_findings(df.limit(0), "d", "v", "g").collect()] == []


def test_weighted_columns(spark):
    df = spark.createDataFrame([(1, "red", "blue"), (2, "blue", "red red"), (3, None, "green"), (4, "red", None)], "i int, a string, b string")
    once = {r.id: r.score for r in tj.bm25(df, "i", {"a": 1.0, "b": 1.0}, ["red"]).collect()}
    twice = {r.id: r.score for r in tj.bm25(df, "i", {"a": 5.0, "b": 1.0}, ["red"]).collect()}
    assert set(once) == {1, 2, 4} == set(twice) and once[2] > once[1] and twice[1] > twice[2]
    assert tj.bm25(df, "i", {"a": 0.0, "b": 3.0}, ["red"]).select("id").collect() == [(2,)]


def test_chunks_cover_the_text():
    text = ("word " * 50 + ".\n") * 40
    spans = tj.chunk_spans(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(b[0] < a[1] <= b[1] for a, b in zip(spans, spans[1:]))
    assert tj.chunk_spans("") == [] and max(e - s for s, e in spans) <= 900 + 200


def test_readable_page():
    title, text = tj.readable("<title>A &amp; b</title><nav>menu</nav><p>One <b>two</b></p><script>x()</script><div>three</div>")
    assert (title, text) == ("A & b", "One two\nthree")


def test_dayfirst_looks_at_the_whole_column(spark):
    from loomwork.sources.readers import sniff_dayfirst

    early = ["01/02/2024"] * 600
    kinds = {"dd/MM/yyyy": ["13/02/2024"], "MM/dd/yyyy": ["02/13/2024"], None: ["13/02/2024", "02/13/2024"]}
    for want, late in kinds.items():
        df = spark.createDataFrame([(v,) for v in early + late], "d string").coalesce(1)
        assert sniff_dayfirst(df, "d") == want
    odd = spark.createDataFrame([(v,) for v in ["13/02/2024", *early, "soon"]], "d string").coalesce(1)
    assert sniff_dayfirst(odd, "d") is None


def test_what_moves_in_a_page_is_no_change(spark):
    from pyspark.sql import functions as F

    lines = ["Seen 12:30:05 by 7 people", "  2024-05-01T10:00:00Z  news", "built deadbeefdeadbeef01 today", "Posted 5 minutes ago", "5 minutes left", "12 apples", "ago", "day ago", "face 3 days", ""]
    want = ["seen by 7 people", "news", "built today", "posted", "5 minutes left", "12 apples", "", "", "face 3 days", ""]
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    assert [r.y for r in df.select(tj.stable_line(F.col("x")).alias("y")).collect()] == want
    page = lambda rows: spark.createDataFrame(rows, "k int, t string")
    got = tj.page_changes(page([(1, "a 10:00\nb"), (1, "c"), (2, "x")]), page([(1, "a 11:00\nc\nd\nd"), (3, "n"), (4, None)]), "k", "t")
    assert sorted(map(tuple, got.collect())) == [(1, "added", "d"), (1, "removed", "b"), (2, "removed", "x"), (3, "added", "n")]


def test_dates_ages_and_marks_of_a_page_are_no_change(spark):
    from pyspark.sql import functions as F

    lines = ["Read on 2024-05-01 10:00 (10:05, by all)", "2024-05-01 was fine", "hace 5 minutos hoy", "Quedan 3 dias", "quedan pocos", "5 mins ago!", "7 sec ago", "id [deadbeefdeadbeef01]", "3 hace 2"]
    want = ["read on by all)", "2024-05-01 was fine", "hoy", "", "quedan pocos", "", "", "id", "3 hace 2"]
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    assert [r.y for r in df.select(tj.stable_line(F.col("x")).alias("y")).collect()] == want
