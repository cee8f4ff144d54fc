"""Queries over series, imputation, regressions in time, findings and event-log roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as se
from ..operators.profile import correlation
from .registry import Registry


def rounded(df, places: int = 5):
    return df.withColumns({c: F.round(c, places) for c, t in df.dtypes if t == "double"})


def users(events):
    return events.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("x"), "value")


#: Days of sales per priority: a series each.
def daily(orders):
    day = F.datediff("o_orderdate", F.lit("1992-01-01")).cast("double")
    return orders.groupBy(F.col("o_orderpriority").alias("g"), day.alias("day")).agg(F.avg("o_totalprice").alias("y"), F.count("*").cast("double").alias("u"))


U = "u AS (SELECT user_id, epoch_us(ts) / 1e6 AS x, value FROM events)"
D = "d AS (SELECT o_orderpriority AS g, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS day, avg(o_totalprice) AS y, count(*)::DOUBLE AS u FROM orders GROUP BY 1, 2)"
STEPS = f"{U}, s AS (SELECT user_id, x, x - lag(x) OVER (PARTITION BY user_id ORDER BY x) AS step FROM u), m AS (SELECT user_id, median(step) AS med FROM s GROUP BY 1), gap AS (SELECT user_id, x - step AS x_before, x AS x_after, step AS size FROM s JOIN m USING (user_id) WHERE med > 0 AND step > 2.5 * med)"
SMOOTH = """n AS (SELECT user_id, x, value, greatest(3, count(*) OVER (PARTITION BY user_id) // 20) AS w FROM u),
    sm AS (SELECT user_id, x, value, avg(value) OVER (PARTITION BY user_id ORDER BY x ROWS BETWEEN w // 2 PRECEDING AND (w - 1) // 2 FOLLOWING) AS smooth, lag(value) OVER (PARTITION BY user_id ORDER BY x) AS before FROM n)"""



def register(r: Registry) -> None:
    add = r.add
    add("gaps", "events", lambda e: rounded(se.gaps(users(e), ["user_id"], "x"), 4), f"WITH {STEPS} SELECT user_id, round(x_before, 4) AS x_before, round(x_after, 4) AS x_after, round(size, 4) AS size FROM gap")
    add("smooth", "events", lambda e: rounded(se.smooth(users(e), ["user_id"], "x", "value"), 4), f"WITH {U}, {SMOOTH} SELECT user_id, round(x, 4) AS x, round(value, 4) AS value, round(smooth, 4) AS smooth FROM sm")
    add("curves", "events", lambda e: rounded(se.curves(users(e), ["user_id"], "x", "value")),
        f"""WITH {STEPS}, {SMOOTH}, k AS (SELECT user_id, count(*) AS gaps FROM gap GROUP BY 1), c AS (SELECT *, (value - before) / nullif(before, 0) AS growth FROM sm)
            SELECT user_id, count(*) AS n, coalesce(max(gaps), 0) AS gaps, round(stddev_pop(value - smooth) / coalesce(nullif(stddev_pop(value), 0), 1), 5) AS noise_ratio,
                round(avg(growth), 5) AS growth_mean, round(median(growth), 5) AS growth_median, round(stddev_pop(growth), 5) AS growth_std FROM c LEFT JOIN k USING (user_id) GROUP BY user_id""")
    add("curves__bias", "orders", lambda o: rounded(se.curve_bias(daily(o), "g", "day", "y", "1-URGENT", "5-LOW"), 3),
        f"""WITH {D}, e AS (SELECT max(lo) AS lo, min(hi) AS hi FROM (SELECT min(day) AS lo, max(day) AS hi FROM d WHERE g IN ('1-URGENT', '5-LOW') GROUP BY g)),
            t AS (SELECT i, lo + (hi - lo) * i / 49 AS pos FROM e, range(50) r(i)), k AS (SELECT unnest(['1-URGENT', '5-LOW']) AS g),
            p AS (SELECT g, i, pos, (SELECT max(struct_pack(x := day, y := y)) FROM d WHERE d.g = k.g AND day <= pos) AS p, (SELECT min(struct_pack(x := day, y := y)) FROM d WHERE d.g = k.g AND day >= pos) AS q FROM k, t),
            v AS (SELECT g, i, CASE WHEN p.x = q.x THEN p.y ELSE p.y + (q.y - p.y) * (pos - p.x) / (q.x - p.x) END AS v FROM p), f AS (SELECT i, max(v) FILTER (g = '5-LOW') - max(v) FILTER (g = '1-URGENT') AS d FROM v GROUP BY i)
            SELECT round(avg(d), 3) AS mean_bias, round(stddev_pop(d), 3) AS std_bias, round(max(abs(d)), 3) AS max_abs_bias FROM f""")
    add("longest_run", "orders", lambda o: se.longest_run(daily(o), ["g"], "day", ["y", "u"]),
        f"""WITH {D}, s AS (SELECT g, day, day - lag(day) OVER (PARTITION BY g ORDER BY day) AS step FROM d), m AS (SELECT g, median(step) AS dt FROM s WHERE step > 0 GROUP BY g),
            b AS (SELECT s.*, sum((step IS NULL OR step <= 0.5 * dt OR step >= 1.5 * dt)::INT) OVER (PARTITION BY g ORDER BY day) AS island FROM s JOIN m USING (g)),
            i AS (SELECT g, island, min(day) AS start, max(day) AS "end", count(*) AS n FROM b GROUP BY 1, 2 HAVING count(*) > 1)
            SELECT g, start, "end", n FROM i QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, start) = 1""")
    holed = lambda o: o.select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.round("o_totalprice", 1)).alias("v"))
    for name, fill in (("mean", "(SELECT avg(v) FROM h)"), ("median", "(SELECT median(v) FROM h)"), ("mode", "(SELECT v FROM h WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1)"), ("constant", "5.0"),
                       ("forward", "coalesce(last_value(v IGNORE NULLS) OVER (ORDER BY o_orderkey), (SELECT v FROM h WHERE v IS NOT NULL ORDER BY o_orderkey LIMIT 1))")):
        add(f"eda_impute_preview__{name}", "orders", lambda o, name=name: rounded(se.imputation_preview(holed(o), "v", name, 5.0, ["o_orderkey"]), 3),
            f"""WITH h AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice, 1) END AS v FROM orders), a AS (SELECT 'before' AS stage, v FROM h UNION ALL SELECT 'after', coalesce(v, {fill}) FROM h)
                SELECT stage, count(v) AS n, count(*) FILTER (v IS NULL) AS missing, round(avg(v), 3) AS mean, round(stddev_samp(v), 3) AS std, round(min(v), 3) AS min, round(max(v), 3) AS max FROM a GROUP BY stage""")
    add("st_rank", "lineitem", lambda d: rounded(se.ranked_findings(pairs(d), 4), 3),
        """WITH p AS (SELECT * FROM (SELECT 'l_quantity' AS a, corr(l_quantity, l_extendedprice) AS r FROM lineitem UNION ALL SELECT 'l_quantity', corr(l_quantity, l_discount) FROM lineitem UNION ALL SELECT 'l_quantity', corr(l_quantity, l_tax) FROM lineitem
            UNION ALL SELECT 'l_extendedprice', corr(l_extendedprice, l_discount) FROM lineitem UNION ALL SELECT 'l_extendedprice', corr(l_extendedprice, l_tax) FROM lineitem UNION ALL SELECT 'l_discount', corr(l_discount, l_tax) FROM lineitem)),
            s AS (SELECT 'pair' AS kind, a AS key, max(-log10(greatest(exp(-abs(r) * 100), 1e-300)) + least(abs(r), 1)) AS strength FROM p GROUP BY a)
            SELECT kind, key, round(strength, 3) AS strength, row_number() OVER (ORDER BY strength DESC, kind, key)::INT AS rank FROM s ORDER BY rank LIMIT 4""")
    add("el_mapping", "events", se.suggest_mapping)
    add("arx", "orders", lambda o: rounded(se.arx(daily(o), ["g"], "day", ["y"], ["u"], 1, 1).select("output", "term", "beta"), 4),
        f"""WITH {D}, l AS (SELECT y, lag(y) OVER w AS a, lag(u) OVER w AS b FROM d WINDOW w AS (PARTITION BY g ORDER BY day)), r AS (SELECT covar_pop(y, a) AS ya, covar_pop(y, b) AS yb, covar_pop(a, b) AS ab, var_pop(a) AS aa, var_pop(b) AS bb, avg(y) AS my, avg(a) AS ma, avg(b) AS mb FROM l WHERE a IS NOT NULL),
            f AS (SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS ba, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS bbeta FROM r)
            SELECT 'y' AS output, unnest(['intercept', 'y_lag1', 'u_lag1']) AS term, round(unnest([my - ba * ma - bbeta * mb, ba, bbeta]), 4) AS beta FROM f""")
    add("prais_winsten", "orders", lambda o: rounded(se.prais_winsten(daily(o), "y", ["day", "u"], ["g"], "day")))
    add("its", "orders", lambda o: rounded(se.interrupted(daily(o), "y", "day", 1200.0, ["g"])))
    add("its__hac", "orders", lambda o: rounded(se.interrupted(daily(o), "y", "day", 1200.0, ["g"], "hac", 3)))


def pairs(lineitem):
    """Correlations as findings; p is a stand-in that falls with the size."""
    r = correlation(lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return r.select(F.lit("pair").alias("kind"), F.col("a").alias("key"), F.exp(-F.abs("r") * 100).alias("p"), F.col("r").alias("size"))
