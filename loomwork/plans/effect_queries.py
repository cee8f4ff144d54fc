"""Queries over effects: difference in differences, adjustment, interrupted series and refuters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import effects as ef
from ..operators import experiments as ex
from .analysis_queries import rounded
from .registry import Registry

#: Intervention, in months.
AT = 1998 * 12 + 1


def _month(c: str):
    return (F.year(c) * 12 + F.month(c)).cast("double")


def panel(orders):
    return orders.select(
        F.col("o_totalprice").alias("y"), (F.col("o_custkey") % 2).alias("treated"), _month("o_orderdate").alias("t"), F.col("o_custkey").alias("unit"), "o_orderkey",
        (F.col("o_orderkey") % 7).cast("double").alias("x1"), (F.length("o_orderpriority") % 5).cast("double").alias("x2"),
    )


P = "p AS (SELECT o_totalprice AS y, o_custkey % 2 AS treated, (year(o_orderdate) * 12 + month(o_orderdate))::DOUBLE AS t, o_custkey AS unit, o_orderkey, (o_orderkey % 7)::DOUBLE AS x1, (length(o_orderpriority) % 5)::DOUBLE AS x2 FROM orders)"


def yearly(orders):
    """A balanced panel: one row a priority and year."""
    per = orders.groupBy(F.col("o_orderpriority").alias("unit"), F.year("o_orderdate").cast("double").alias("t")).agg(F.avg("o_totalprice").alias("y"), F.avg(F.col("o_orderkey") % 7).alias("x"))
    return per.withColumn("treated", F.col("unit").isin("1-URGENT", "2-HIGH").cast("int"))


Y = "q AS (SELECT o_orderpriority AS unit, year(o_orderdate)::DOUBLE AS t, avg(o_totalprice) AS y, avg(o_orderkey % 7) AS x, ((o_orderpriority IN ('1-URGENT', '2-HIGH')) AND year(o_orderdate) >= 1998)::INT AS d FROM orders GROUP BY 1, 2, 5)"


def months(orders):
    return orders.groupBy(F.col("o_orderpriority").alias("g"), _month("o_orderdate").alias("t")).agg(F.avg("o_totalprice").alias("y"))


M = "m AS (SELECT o_orderpriority AS g, (year(o_orderdate) * 12 + month(o_orderdate))::DOUBLE AS t, avg(o_totalprice) AS y FROM orders GROUP BY 1, 2)"


def _cells(value: str, at: str, where: str = "true") -> str:
    cell = lambda tr, late: f"avg({value}) FILTER (treated = {tr} AND t {'>=' if late else '<'} {at} AND {where})"
    return f"({cell(1, 1)} - {cell(1, 0)} - {cell(0, 1)} + {cell(0, 0)})"


def _partial(a: str, b: str, c: str) -> str:
    """Slope of ``a`` on ``b`` in rows freed of ``c``, from sums of products s_.."""
    s = lambda x, y: f"covar_pop({x}, {y})"
    return f"({s(a, b)} - {s(a, c)} * {s(b, c)} / var_pop({c})) / (var_pop({b}) - {s(b, c)} ** 2 / var_pop({c}))"


def register(r: Registry) -> None:
    add = r.add
    add("did__cells", "orders", lambda d: rounded(ef.cells(panel(d), "y", "treated", "t", AT), 4), f"WITH {P} SELECT treated::INT AS treated, (t >= {AT})::INT AS after, count(*) AS n, round(avg(y), 4) AS mean FROM p GROUP BY 1, 2")
    add("did__covariates", "orders", lambda d: rounded(ef.did_covariates(panel(d), "y", "treated", "t", AT, ["x1", "x2"], "unit").select("estimate"), 3),
        f"""WITH {P}, c AS (SELECT *, y - avg(y) OVER w AS yd, x1 - avg(x1) OVER w AS a, x2 - avg(x2) OVER w AS b FROM p WINDOW w AS (PARTITION BY treated, t >= {AT})), s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * yd) AS ay, sum(b * yd) AS byd FROM c),
            v AS (SELECT (bb * ay - ab * byd) / (aa * bb - ab * ab) AS u, (aa * byd - ab * ay) / (aa * bb - ab * ab) AS w FROM s)
            SELECT round({_cells("y - u * x1 - w * x2", str(AT))}, 3) AS estimate FROM p, v""")
    add("did__fixed", "orders", lambda d: rounded(ef.did_fixed(yearly(d), "y", "treated", "t", 1998, "unit").select("term", "beta"), 3),
        f"""WITH {Y}, f AS (SELECT y - avg(y) OVER (PARTITION BY unit) - avg(y) OVER (PARTITION BY t) + avg(y) OVER () AS y, d - avg(d) OVER (PARTITION BY unit) - avg(d) OVER (PARTITION BY t) + avg(d) OVER () AS d FROM q)
            SELECT 'treated_after' AS term, round(sum(d * y) / sum(d * d), 3) AS beta FROM f""")
    add("did__fixed_covariates", "orders", lambda d: rounded(ef.did_fixed(yearly(d), "y", "treated", "t", 1998, "unit", ["x"]).select("term", "beta"), 3),
        f"""WITH {Y}, f AS (SELECT y - avg(y) OVER u - avg(y) OVER v + avg(y) OVER () AS y, d - avg(d) OVER u - avg(d) OVER v + avg(d) OVER () AS d, x - avg(x) OVER u - avg(x) OVER v + avg(x) OVER () AS x FROM q WINDOW u AS (PARTITION BY unit), v AS (PARTITION BY t)),
            s AS (SELECT sum(d * d) AS dd, sum(d * x) AS dx, sum(x * x) AS xx, sum(d * y) AS dy, sum(x * y) AS xy FROM f)
            SELECT unnest(['treated_after', 'x']) AS term, round(unnest([(xx * dy - dx * xy) / (dd * xx - dx * dx), (dd * xy - dx * dy) / (dd * xx - dx * dx)]), 3) AS beta FROM s""")
    add("did__pretrend", "orders", lambda d: rounded(ef.did_pretrend(panel(d), "y", "treated", "t", AT, "unit").select("slope", "implied_bias"), 3),
        f"""WITH {P}, s AS (SELECT regr_slope(y, t) FILTER (treated = 1 AND t < {AT}) - regr_slope(y, t) FILTER (treated = 0 AND t < {AT}) AS slope, avg(t) FILTER (t >= {AT}) - avg(t) FILTER (t < {AT}) AS ahead FROM p) SELECT round(slope, 3) AS slope, round(slope * ahead, 3) AS implied_bias FROM s""")
    add("did__events", "orders", lambda d: rounded(ef.did_event_study(panel(d), "y", "treated", "t", AT), 3),
        f"""WITH {P}, e AS (SELECT t, avg(y) FILTER (treated = 1) - avg(y) FILTER (treated = 0) AS gap, var_samp(y) FILTER (treated = 1) / count(*) FILTER (treated = 1) + var_samp(y) FILTER (treated = 0) / count(*) FILTER (treated = 0) AS v FROM p GROUP BY t),
            l AS (SELECT t AS lt, gap AS lg, v AS lv FROM e WHERE t < {AT} AND gap IS NOT NULL ORDER BY t DESC LIMIT 1)
            SELECT t AS time, round(gap - lg, 3) AS estimate, round(CASE WHEN t = lt THEN 0 ELSE sqrt(v + lv) END, 3) AS se FROM e, l WHERE gap IS NOT NULL""")
    add("did__placebo", "orders", lambda d: rounded(ef.did_placebo(panel(d), "y", "treated", "t", AT, "unit").select("placebo_at", "estimate"), 3),
        f"""WITH {P}, d AS (SELECT list_sort(list(DISTINCT t)) AS l FROM p WHERE t < {AT}), c AS (SELECT l[len(l) // 2 + 1] AS c FROM d) SELECT c AS placebo_at, round({_cells("y", "c", f"t < {AT}")}, 3) AS estimate FROM p, c GROUP BY c""")
    add("did__checks", "orders", lambda d: ef.did_checks(panel(d), "y", "treated", "t", AT, "unit"))
    step = "regr_slope(y, treated)"
    add("adjust__effect", "orders", lambda d: rounded(ef.adjust_effect(panel(d), "y", "treated", ["x1", "x2"]).select("naive", "estimate", "shift"), 3),
        f"""WITH {P}, k AS (SELECT regr_slope(y, x1) AS a, regr_slope(treated, x1) AS b, regr_slope(x2, x1) AS c FROM p), f AS (SELECT y - a * x1 AS y, treated - b * x1 AS d, x2 - c * x1 AS x FROM p, k), e AS (SELECT {_partial("y", "d", "x")} AS e FROM f), n AS (SELECT {step} AS n FROM p)
            SELECT round(n, 3) AS naive, round(e, 3) AS estimate, round(e - n, 3) AS shift FROM e, n""")
    add("adjust__path", "orders", lambda d: rounded(ef.adjust_path(panel(d), "y", "treated", ["x1", "x2"]).drop("se"), 3),
        f"""WITH {P}, k AS (SELECT regr_slope(y, x1) AS a, regr_slope(treated, x1) AS b, regr_slope(x2, x1) AS c FROM p), f AS (SELECT y - a * x1 AS y, treated - b * x1 AS d, x2 - c * x1 AS x FROM p, k)
            SELECT '' AS adjusted_for, 0 AS n_confounders, round({step}, 3) AS estimate FROM p UNION ALL SELECT 'x1', 1, round({_partial("y", "treated", "x1")}, 3) FROM p
            UNION ALL SELECT 'x2', 1, round({_partial("y", "treated", "x2")}, 3) FROM p UNION ALL SELECT 'x1,x2', 2, round({_partial("y", "d", "x")}, 3) FROM f""")
    add("adjust__range", "orders", lambda d: rounded(ef.adjust_range(panel(d).withColumn("y0", F.col("y")), "treated", ["x1", "y0"]), 6),
        f"WITH {P} " + " UNION ALL ".join(f"SELECT '{n}' AS confounder, round(avg(({c} < (SELECT min({c}) FROM p WHERE treated = 0) OR {c} > (SELECT max({c}) FROM p WHERE treated = 0))::INT), 6) AS outside FROM p WHERE treated = 1" for n, c in (("x1", "x1"), ("y0", "y"))))
    add("adjust__overlap", "orders", lambda d: rounded(ef.adjust_overlap(panel(d), "treated", ["x1", "x2"]), 4))
    level = "(regr_intercept(y, t) FILTER (t >= c) + regr_slope(y, t) FILTER (t >= c) * c) - (regr_intercept(y, t) FILTER (t < c) + regr_slope(y, t) FILTER (t < c) * c)"
    add("its__placebo", "orders", lambda d: rounded(ef.its_placebo(months(d), "y", "t", 1999 * 12, ["g"]).select("g", "time", "level", "slope"), 2),
        f"""WITH {M}, r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY t) AS i, count(*) OVER (PARTITION BY g) AS n FROM m WHERE t < {1999 * 12}), k AS (SELECT g, t AS c FROM r WHERE i > 4 AND i <= n - 3)
            SELECT g, c AS time, round({level}, 2) AS level, round(regr_slope(y, t) FILTER (t >= c) - regr_slope(y, t) FILTER (t < c), 2) AS slope FROM r JOIN k USING (g) GROUP BY g, c""")
    add("its__counterfactual", "orders", lambda d: rounded(ef.its_counterfactual(months(d), "y", "t", 1999 * 12, ["g"]), 2),
        f"""WITH {M}, f AS (SELECT g, regr_intercept(y, t) FILTER (t < {1999 * 12}) AS a, regr_slope(y, t) FILTER (t < {1999 * 12}) AS b, regr_intercept(y, t) FILTER (t >= {1999 * 12}) AS c, regr_slope(y, t) FILTER (t >= {1999 * 12}) AS d FROM m GROUP BY g)
            SELECT g, t AS time, round(y, 2) AS y, round(CASE WHEN t < {1999 * 12} THEN a + b * t ELSE c + d * t END, 2) AS fitted, round(a + b * t, 2) AS counterfactual, round(y - a - b * t, 2) AS effect FROM m JOIN f USING (g)""")
    add("its__seasons", "orders", lambda d: rounded(ef.its_counterfactual(months(d), "y", "t", 1999 * 12, ["g"], 12), 2))
    add("refute__cause", "orders", lambda d: ef.refute_common_cause(panel(d), "y", "treated", ["x1", "x2"], ["o_orderkey"]))
    add("refute__subsets", "orders", lambda d: ef.refute_subsets(panel(d), "y", "treated", ["x1", "x2"], ["o_orderkey"]))
    line = lambda d: d.select(F.col("o_totalprice").alias("y"), (F.col("o_orderkey") % 5 - 2).cast("double").alias("a"))
    add("factorial__anova", "orders", lambda d: rounded(ex.lack_of_fit(line(d), ["a"], "y").drop("p", "rss", "ss_pure", "ss_lack"), 4),
        """WITH p AS (SELECT o_totalprice AS y, (o_orderkey % 5 - 2)::DOUBLE AS a FROM orders), c AS (SELECT a, count(*) AS n, var_pop(y) * count(*) AS ss FROM p GROUP BY a), s AS (SELECT sum(n) AS n, count(*) AS k, sum(ss) AS pure FROM c), r AS (SELECT regr_syy(y, a) - regr_sxy(y, a) ** 2 / regr_sxx(y, a) AS rss FROM p)
           SELECT CAST(n - 2 AS BIGINT) AS dof, CAST(n - k AS BIGINT) AS dof_pure, CAST(k - 2 AS BIGINT) AS dof_lack, round((rss - pure) / (k - 2) / (pure / (n - k)), 4) AS f FROM s, r""")
    three = "o_orderkey % 2 * 2 - 1 as a", "o_custkey % 2 * 2 - 1 as b", "(length(o_orderpriority) % 2) * 2 - 1 as c"
    effect = " UNION ALL ".join(f"SELECT '{n}' AS term, round(avg(y) FILTER ({e} > 0) - avg(y) FILTER ({e} < 0), 6) AS effect FROM p" for n, e in (("a", "a"), ("b", "b"), ("c", "c"), ("a:b", "a * b"), ("a:c", "a * c"), ("b:c", "b * c")))
    add("factorial__lenth", "orders", lambda d: rounded(ex.lenth(d.selectExpr("o_totalprice as y", *three), ["a", "b", "c"], "y").select("term", "effect", "pse"), 4),
        f"""WITH p AS (SELECT o_totalprice AS y, {", ".join(three)} FROM orders), e AS ({effect}), s AS (SELECT 1.5 * median(abs(effect)) AS s FROM e), f AS (SELECT 1.5 * median(abs(effect)) AS pse FROM e, s WHERE abs(effect) < 2.5 * s)
            SELECT term, round(effect, 4) AS effect, round(pse, 4) AS pse FROM e, f""")
