"""Queries over tests, drift, findings, least squares and models."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from ..operators import models as md
from ..operators import stats as sa
from ..operators import training as tr
from ..operators.profile import column_roles
from ..operators.ranks import global_rank, mid_ranks
from .registry import Registry


def rounded(df, places: int = 5):
    return df.withColumns({c: F.round(c, places) for c, t in df.dtypes if t == "double"})


def two(orders):
    return orders.where("o_orderstatus in ('F', 'O')").select("o_totalprice", "o_orderstatus")


def panel(orders):
    return orders.select(
        F.col("o_totalprice").alias("y"), (F.col("o_custkey") % 2).alias("treated"), (F.month("o_orderdate") > 6).cast("long").alias("after"), F.col("o_custkey").alias("unit"), "o_orderkey",
        (F.col("o_orderkey") % 7).cast("double").alias("x1"), (F.length("o_orderpriority") % 5).cast("double").alias("x2"),
    )


PANEL = """p AS (SELECT o_totalprice AS y, o_custkey % 2 AS treated, (month(o_orderdate) > 6)::BIGINT AS after, o_custkey AS unit, o_orderkey, (o_orderkey % 7)::DOUBLE AS x1, (length(o_orderpriority) % 5)::DOUBLE AS x2 FROM orders)"""


def monthly(orders):
    return md.resample(orders, "o_orderdate", "o_totalprice", "month", ["o_orderpriority"])


def register(r: Registry) -> None:
    add = r.add
    add("describe", "orders", lambda d: rounded(sa.describe(d, "o_totalprice").drop("ci_low", "ci_high", "skew")),
        "SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 5) AS mean, round(stddev_samp(o_totalprice), 5) AS sd, round(median(o_totalprice), 5) AS median, round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 5) AS iqr FROM orders")
    add("ttest_1samp", "orders", lambda d: rounded(sa.ttest_1samp(d, "o_totalprice", 150000).drop("p")), "SELECT round((avg(o_totalprice) - 150000) / (stddev_samp(o_totalprice) / sqrt(count(*))), 5) AS t, (count(*) - 1)::DOUBLE AS df FROM orders")
    add("ttest_ind", "orders", lambda d: rounded(sa.ttest_ind(two(d), "o_totalprice", "o_orderstatus").drop("p", "df")),
        """WITH g AS (SELECT o_orderstatus AS g, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1) SELECT round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 5) AS t, round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 5) AS cohen_d FROM g a, g b WHERE a.g = 'F' AND b.g = 'O'""")
    add("ttest_rel", "lineitem", lambda d: rounded(sa.ttest_rel(d, "l_discount", "l_tax").drop("p")), "SELECT round(avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))), 5) AS t, (count(*) - 1)::DOUBLE AS df FROM lineitem")
    add("mannwhitneyu", "orders", lambda d: sa.mannwhitney(two(d), "o_totalprice", "o_orderstatus").drop("p"),
        "WITH r AS (SELECT o_orderstatus AS g, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS r FROM orders WHERE o_orderstatus IN ('F', 'O')) SELECT (sum(r) - count(*) * (count(*) + 1) / 2)::DOUBLE AS u FROM r WHERE g = 'F'")
    add("wilcoxon", "lineitem", lambda d: sa.wilcoxon(d, "l_discount", "l_tax"))
    add("pearson", "lineitem", lambda d: rounded(sa.pearson(d, "l_quantity", "l_extendedprice").drop("p")), "SELECT round(corr(l_quantity, l_extendedprice), 5) AS r, count(*) AS n FROM lineitem")
    ranks = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"
    add("spearman", "lineitem", lambda d: rounded(sa.spearman(d, "l_quantity", "l_extendedprice").drop("p")), f"SELECT round(corr(a, b), 5) AS r, count(*) AS n FROM (SELECT {ranks.format('l_quantity')} AS a, {ranks.format('l_extendedprice')} AS b FROM lineitem)")
    add("linregress", "lineitem", lambda d: rounded(sa.linregress(d, "l_quantity", "l_extendedprice")), "SELECT round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 5) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 5) AS r2, count(*) AS n FROM lineitem")
    add("chi2_contingency", "lineitem", lambda d: rounded(sa.chi2_contingency(d, "l_returnflag", "l_linestatus").drop("p")),
        """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2), x AS (SELECT a, sum(n) AS ra FROM c GROUP BY 1), y AS (SELECT b, sum(n) AS cb FROM c GROUP BY 1), g AS (SELECT coalesce(n, 0) AS n, ra * cb / (SELECT sum(n) FROM c) AS e FROM x CROSS JOIN y LEFT JOIN c USING (a, b))
           SELECT round(sum((n - e) ** 2 / e), 5) AS chi2, (((SELECT count(*) FROM x) - 1) * ((SELECT count(*) FROM y) - 1))::DOUBLE AS df FROM g""")
    add("fisher_exact", "part", lambda d: rounded(sa.fisher_exact(d.selectExpr("p_size > 25 as a", "p_partkey % 3 > 0 as b"), "a", "b").drop("p")), "SELECT round(count(*) FILTER (a AND b) * count(*) FILTER (NOT a AND NOT b) / (count(*) FILTER (a AND NOT b) * count(*) FILTER (NOT a AND b))::DOUBLE, 5) AS odds FROM (SELECT p_size > 25 AS a, p_partkey % 3 > 0 AS b FROM part)")
    add("proportion_ci", "orders", lambda d: sa.proportion_ci(d, "o_orderstatus = 'F'"),
        """WITH k AS (SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS k, 1.959963984540054::DOUBLE AS z FROM orders), p AS (SELECT *, k / n::DOUBLE AS p FROM k) SELECT n, k, round(p, 6) AS share, round(((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS low, round(((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS high FROM p""")
    add("binom_test", "orders", lambda d: sa.binom_test(d, "o_orderstatus = 'F'", 0.5).drop("p"), "SELECT count(*) FILTER (o_orderstatus = 'F') AS k, count(*) AS n FROM orders")
    add("eda_corr__spearman_ranks", "part", lambda d: mid_ranks(d.select("p_partkey", "p_size"), "p_size", "r"), f"SELECT p_partkey, p_size, ({ranks.format('p_size')})::DOUBLE AS r FROM part")
    add("global_rank", "orders", lambda d: global_rank(d.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]), "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank FROM orders")
    add("drift", "orders", lambda d: rounded(sa.drift(d.where("o_orderstatus = 'F'"), d.where("o_orderstatus = 'O'"), "o_totalprice").select("ks", "wasserstein", "mean_shift"), 4),
        """WITH a AS (SELECT o_totalprice AS v, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_totalprice AS v, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
           c AS (SELECT coalesce(a.v, b.v) AS v, coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb FROM a FULL JOIN b ON a.v = b.v), d AS (SELECT v, abs(sum(na) OVER w / (SELECT sum(n) FROM a)::DOUBLE - sum(nb) OVER w / (SELECT sum(n) FROM b)::DOUBLE) AS g, lead(v) OVER (ORDER BY v) AS nx FROM c WINDOW w AS (ORDER BY v))
           SELECT round(max(g), 4) AS ks, round(sum(g * (nx - v)), 4) AS wasserstein, round((SELECT avg(o_totalprice) FROM orders WHERE o_orderstatus = 'O') - (SELECT avg(o_totalprice) FROM orders WHERE o_orderstatus = 'F'), 4) AS mean_shift FROM d""")
    add("st_trend", "orders", lambda d: sa.trend(d, "o_orderdate", "o_totalprice"),
        """WITH g AS (SELECT date_trunc('year', o_orderdate)::DATE AS period, count(*) AS n, sum(o_totalprice) AS t, avg(o_totalprice) AS m FROM orders GROUP BY 1 HAVING count(*) >= 5) SELECT period, n, round(t, 2) AS total, round(m, 4) AS mean, (SELECT round(corr(date_diff('day', DATE '1970-01-01', period)::DOUBLE, t), 6) FROM g) AS r FROM g""")
    add("st_trend__groups", "orders", lambda d: rounded(sa.trend_findings(d, "o_orderdate", "o_totalprice", "o_orderpriority", 3).drop("p"), 6),
        """WITH c AS (SELECT date_trunc('year', o_orderdate)::DATE AS period, o_orderpriority AS g, count(*) AS n, sum(o_totalprice) AS t FROM orders GROUP BY 1, 2), top AS (SELECT g FROM c GROUP BY g ORDER BY sum(t) DESC, g LIMIT 3),
           s AS (SELECT NULL AS g, period, sum(n) AS n, sum(t) AS t FROM c GROUP BY period UNION ALL SELECT g, period, n, t FROM c JOIN top USING (g)), k AS (SELECT g, count(*) AS k, corr(date_diff('day', DATE '1970-01-01', period)::DOUBLE, t) AS r FROM s WHERE n >= 5 GROUP BY g)
           SELECT g AS o_orderpriority, 'year' AS grain, k AS periods, round(r, 6) AS r, k >= 5 AND abs(r) >= 0.5 AND abs(r) * sqrt((k - 2) / (1 - r * r)) > (CASE k WHEN 5 THEN 3.182446 WHEN 6 THEN 2.776445 WHEN 7 THEN 2.570582 WHEN 8 THEN 2.446912 WHEN 9 THEN 2.364624 END) AS found FROM k""")
    add("st_groups", "orders", lambda d: rounded(sa.group_gap(d, "o_orderpriority", "o_totalprice").select("best", "worst", "t", "gap")),
        """WITH g AS (SELECT o_orderpriority AS g, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1 HAVING count(*) >= 5), a AS (SELECT * FROM g ORDER BY m DESC, g LIMIT 1), b AS (SELECT * FROM g ORDER BY m, g LIMIT 1) SELECT a.g AS best, b.g AS worst, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 5) AS t, round((a.m - b.m) / abs(b.m), 5) AS gap FROM a, b""")
    add("st_outliers", "orders", lambda d: sa.outlier_share(d, "o_totalprice"),
        "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders), k AS (SELECT count(*) AS n, count(*) FILTER (o_totalprice < a - 1.5 * (b - a) OR o_totalprice > b + 1.5 * (b - a)) AS outliers FROM orders, q) SELECT n, outliers, round(outliers / n::DOUBLE, 6) AS share, n >= 20 AND outliers > 0 AND outliers / n::DOUBLE <= 0.1 AS found FROM k")
    add("st_concentration", "orders", lambda d: sa.concentration(d, "o_orderpriority", "o_totalprice"),
        "WITH g AS (SELECT o_orderpriority AS g, sum(o_totalprice) AS s FROM orders GROUP BY 1), x AS (SELECT s / (SELECT sum(s) FROM g) AS p, row_number() OVER (ORDER BY s DESC, g) AS i FROM g) SELECT round(sum(p) FILTER (i = 1), 6) AS top1, round(sum(p) FILTER (i <= 3), 6) AS top3, sum(p) FILTER (i = 1) >= 0.4 OR sum(p) FILTER (i <= 3) >= 0.6 AS found FROM x")
    add("st_change", "orders", lambda d: rounded(sa.change(d, "o_orderdate", "o_totalprice").select("before", "after", "t")),
        """WITH c AS (SELECT median(epoch_us(o_orderdate)::DOUBLE) AS c FROM orders), g AS (SELECT epoch_us(o_orderdate) > c AS late, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders, c GROUP BY 1) SELECT round(b.m, 5) AS before, round(a.m, 5) AS after, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 5) AS t FROM g a, g b WHERE a.late AND NOT b.late""")
    add("ols", "lineitem", lambda d: rounded(sa.ols(d, "l_extendedprice", ["l_quantity"]).select("term", "beta", "se"), 4),
        """WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_sxx(l_extendedprice, l_quantity) AS sxx, count(*) AS n, avg(l_quantity) AS m, regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity) AS rss FROM lineitem)
           SELECT 'l_quantity' AS term, round(b, 4) AS beta, round(sqrt(rss / (n - 2) / sxx), 4) AS se FROM s UNION ALL SELECT 'intercept', round(a, 4), round(sqrt(rss / (n - 2) * (1.0 / n + m * m / sxx)), 4) FROM s""")
    for cov in ("HC3", "cluster", "HAC"):
        add(f"ols__{cov.lower()}", "orders", lambda d, cov=cov: rounded(sa.ols(panel(d), "y", ["x1", "x2"], cov, "unit" if cov != "HC3" else None, ["o_orderkey"])))
    add("residual_checks", "orders", lambda d: rounded(sa.residual_checks(d, "o_totalprice", ["o_orderkey"], 2, "o_custkey").select("lag", "acf", "durbin_watson")),
        """WITH d AS (SELECT o_custkey, o_orderkey, o_totalprice - avg(o_totalprice) OVER () AS d FROM orders), l AS (SELECT d, lag(d) OVER w AS l1, lag(d, 2) OVER w AS l2 FROM d WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), s AS (SELECT sum(d * d) AS s, sum(d * l1) AS c1, sum(d * l2) AS c2, sum((d - l1) ** 2) AS dw FROM l)
           SELECT 1 AS lag, round(c1 / s, 5) AS acf, round(dw / s, 5) AS durbin_watson FROM s UNION ALL SELECT 2, round(c2 / s, 5), round(dw / s, 5) FROM s""")
    add("did", "orders", lambda d: rounded(sa.did(panel(d), "y", "treated", "after", "unit").drop("se", "p"), 4),
        f"WITH {PANEL}, m AS (SELECT avg(y) FILTER (treated = 0 AND after = 0) AS m00, avg(y) FILTER (treated = 0 AND after = 1) AS m01, avg(y) FILTER (treated = 1 AND after = 0) AS m10, avg(y) FILTER (treated = 1 AND after = 1) AS m11 FROM p) SELECT round(m11 - m10 - m01 + m00, 4) AS beta, round(m00, 4) AS mean_00, round(m01, 4) AS mean_01, round(m10, 4) AS mean_10, round(m11, 4) AS mean_11 FROM m")
    add("adjust__balance", "orders", lambda d: sa.balance(panel(d), "treated", ["x1", "x2"]), f"WITH {PANEL} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round((avg({c}) FILTER (treated = 1) - avg({c}) FILTER (treated = 0)) / sqrt((var_samp({c}) FILTER (treated = 1) + var_samp({c}) FILTER (treated = 0)) / 2), 6) AS smd FROM p" for c in ("x1", "x2")))
    add("refute__permutations", "orders", lambda d: sa.permuted_effects(panel(d), "y", "treated", "o_orderkey", 20))
    add("factorial_effects", "orders", lambda d: sa.factorial_effects(d.selectExpr("o_totalprice as y", "o_orderkey % 2 * 2 - 1 as a", "o_custkey % 2 * 2 - 1 as b"), ["a", "b"], "y"),
        "WITH p AS (SELECT o_totalprice AS y, o_orderkey % 2 * 2 - 1 AS a, o_custkey % 2 * 2 - 1 AS b FROM orders) " + " UNION ALL ".join(f"SELECT '{n}' AS term, round(avg(y) FILTER ({e} > 0) - avg(y) FILTER ({e} < 0), 6) AS effect FROM p" for n, e in (("a", "a"), ("b", "b"), ("a:b", "a * b"))))

    # models
    feats = ["l_quantity", "l_discount", "l_returnflag"]
    key = ["l_orderkey", "l_linenumber"]
    add("ml_train__linear", "lineitem", lambda d: md.regression_metrics(md.train(d, "l_extendedprice", feats, key)[1]))
    add("ml_train__random_forest", "lineitem", lambda d: md.regression_metrics(md.train(d, "l_extendedprice", feats, key, "random_forest")[1]))
    add("ml_train__logistic", "lineitem", lambda d: md.precision_recall(md.train(d, "l_linestatus", ["l_quantity", "l_returnflag"], key, "logistic")[1], "_y", "prediction"))
    add("ml_train__mlp", "part", lambda d: md.precision_recall(md.train(d.withColumn("dear", F.when(F.col("p_retailprice") > 1100, "yes").otherwise("no")), "dear", ["p_size", "p_retailprice", "p_type"], ["p_partkey"], "mlp")[1], "_y", "prediction"))
    add("ml_predict", "lineitem", lambda d: md.train(d, "l_extendedprice", feats, key)[0].transform(d.withColumn("_y", F.lit(0.0))).select(*key, "prediction"))
    add("ml_importance", "lineitem", lambda d: md.permutation_importance(md.train(d, "l_extendedprice", ["l_quantity", "l_discount"], key)[0], d.withColumn("_y", F.col("l_extendedprice")), "l_extendedprice", ["l_quantity", "l_discount"], key))
    add("ml_fit_gap", "lineitem", lambda d: md.fit_gap(d, "l_extendedprice", feats, key))
    add("ml_tune", "lineitem", lambda d: md.random_search(d, "l_extendedprice", feats, key, 3))
    add("ml_kmeans", "part", lambda d: md.kmeans(d, ["p_size", "p_retailprice"])[1])
    add("ml_pca", "lineitem", lambda d: md.pca(d.select(*key, "l_quantity", "l_extendedprice", "l_discount"), ["l_quantity", "l_extendedprice", "l_discount"])[0])
    add("ml_anomaly", "lineitem", lambda d: md.isolation_forest(d.select(*key, "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"], key))
    pred = lambda d: d.select("l_returnflag", F.col("l_extendedprice").alias("_y"), (F.col("l_quantity") * 1500).alias("prediction"))
    add("ml_evaluate__regression", "lineitem", lambda d: md.regression_metrics(pred(d)),
        "WITH p AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem) SELECT round(sqrt(avg((y - p) ** 2)), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae, round(1 - sum((y - p) ** 2) / (sum(y * y) - sum(y) ** 2 / count(*)), 6) AS r2, round(avg(y - p), 6) AS bias, count(*) AS n FROM p")
    add("ml_evaluate__by_group", "lineitem", lambda d: md.error_by_group(pred(d), "l_returnflag"), "SELECT l_returnflag, count(*) AS n, round(avg(abs(l_extendedprice - l_quantity * 1500)), 6) AS mae, round(avg(l_extendedprice - l_quantity * 1500), 6) AS bias FROM lineitem GROUP BY 1")
    flags = lambda d: d.select((F.col("l_discount") > 0.05).cast("int").alias("y"), (F.col("l_quantity") / 51).alias("s"), (F.col("l_quantity") > 25).cast("int").alias("p"))
    add("ml_evaluate__confusion", "lineitem", lambda d: md.confusion(flags(d), "y", "p"), "SELECT (l_discount > 0.05)::INT AS actual, (l_quantity > 25)::INT AS predicted, count(*) AS n FROM lineitem GROUP BY 1, 2")
    add("ml_evaluate__calibration", "lineitem", lambda d: md.calibration(flags(d), "s", "y"), "SELECT least(9, floor(l_quantity / 51 * 10))::INT AS bin, count(*) AS n, round(avg(l_quantity / 51), 6) AS score, round(avg((l_discount > 0.05)::INT), 6) AS share FROM lineitem GROUP BY 1")
    add("ml_evaluate__roc", "lineitem", lambda d: md.roc(flags(d), "s", "y"), f"WITH r AS (SELECT (l_discount > 0.05)::INT AS y, {ranks.format('l_quantity')} AS r FROM lineitem), k AS (SELECT sum(r) FILTER (y = 1) AS r1, count(*) FILTER (y = 1)::DOUBLE AS n1, count(*) FILTER (y = 0)::DOUBLE AS n0 FROM r) SELECT round((r1 - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auc FROM k")
    add("ml_knn", "part", lambda d: md.knn(d, d.where("p_partkey % 20 = 0"), "p_partkey", ["p_size", "p_retailprice"], "p_brand"),
        """WITH d AS (SELECT q.p_partkey AS query, t.p_brand AS label, row_number() OVER (PARTITION BY q.p_partkey ORDER BY (t.p_size - q.p_size)::DOUBLE ** 2 + (t.p_retailprice - q.p_retailprice) ** 2, t.p_partkey) AS r FROM part q, part t WHERE q.p_partkey % 20 = 0 AND q.p_partkey <> t.p_partkey), v AS (SELECT query, label, count(*) AS n FROM d WHERE r <= 5 GROUP BY 1, 2)
           SELECT query, label AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, label) = 1""")
    add("ml_resample", "orders", lambda d: monthly(d).withColumn("value", F.round("value", 2)),
        """WITH g AS (SELECT o_orderpriority, date_trunc('month', o_orderdate)::DATE AS period, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), s AS (SELECT o_orderpriority, unnest(generate_series(min(period)::TIMESTAMP, max(period)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS period FROM g GROUP BY 1)
           SELECT s.o_orderpriority, s.period, round(coalesce(v, 0), 2) AS value FROM s LEFT JOIN g USING (o_orderpriority, period)""")
    add("ml_forecast__naive", "orders", lambda d: md.seasonal_naive(monthly(d), ["o_orderpriority"], 12, 18).withColumn("forecast", F.round("forecast", 2)),
        """WITH g AS (SELECT o_orderpriority, date_trunc('month', o_orderdate)::DATE AS period, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), s AS (SELECT o_orderpriority, unnest(generate_series(min(period)::TIMESTAMP, max(period)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS period FROM g GROUP BY 1),
           f AS (SELECT s.*, coalesce(v, 0) AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY period DESC) AS r FROM s LEFT JOIN g USING (o_orderpriority, period)) SELECT o_orderpriority, h::INT AS step, round(v, 2) AS forecast FROM f, range(1, 19) t(h) WHERE r <= 12 AND (h - 1) % 12 = 12 - r""")
    add("ml_forecast__holt_winters", "orders", lambda d: md.forecast(monthly(d), ["o_orderpriority"]))
    add("ml_pareto", "part", lambda d: md.pareto_front(d.select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y")), "x", "y"),
        "SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice AS y FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size <= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size < a.p_size OR b.p_retailprice < a.p_retailprice))")
    three = lambda d: d.select("l_orderkey", "l_linenumber", (-F.col("l_quantity")).cast("double").alias("x"), F.col("l_extendedprice").alias("y"), (-F.col("l_discount")).alias("z"))
    add("ml_pareto__three", "lineitem", lambda d: md.skyline(three(d), ["x", "y", "z"]),
        """WITH p AS (SELECT l_orderkey, l_linenumber, -l_quantity::DOUBLE AS x, l_extendedprice AS y, -l_discount AS z FROM lineitem), u AS (SELECT x, z, min(y) AS y FROM p GROUP BY 1, 2)
           SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.x <= a.x AND b.y <= a.y AND b.z <= a.z AND (b.x < a.x OR b.y < a.y OR b.z < a.z))""")
    add("ml_split__strata", "orders", lambda d: tr.split(d.select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"]).groupBy("o_orderstatus").agg(F.count_if(~F.col("held_out")).alias("train"), F.count_if("held_out").alias("test")),
        "SELECT o_orderstatus, CAST(n - t AS BIGINT) AS train, CAST(t AS BIGINT) AS test FROM (SELECT o_orderstatus, count(*) AS n, least(count(*) - 1, greatest(1, round(0.2 * count(*)))) AS t FROM orders GROUP BY 1)")
    add("ml_train__cv", "lineitem", lambda d: tr.cross_validate(d, "l_extendedprice", feats, key))
    add("ml_train__cv_classes", "lineitem", lambda d: tr.cross_validate(d, "l_linestatus", ["l_quantity", "l_returnflag"], key, "logistic", 3))
    add("ml_fit_gap__check", "lineitem", lambda d: tr.fit_check(d, "l_extendedprice", feats, key))
    add("ml_train__ridge", "lineitem", lambda d: md.regression_metrics(md.train(d, "l_extendedprice", feats, key, "ridge")[1]))
    add("ml_train__gradient_boosting", "part", lambda d: md.regression_metrics(md.train(d, "p_retailprice", ["p_size", "p_type"], ["p_partkey"], "gradient_boosting")[1]))

    def kept(d):
        """A stored model, loaded twice, gives the same predictions."""
        tr.train_saved(d, "l_extendedprice", feats, key, "price")
        model, _ = tr.load_model(d.sparkSession, "price")
        both = model.transform(tr.predict_saved(d, "price").withColumnRenamed("prediction", "first"))
        return both.agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("prediction") - F.col("first")) < 1e-9).alias("equal"))

    add("ml_predict__saved", "lineitem", kept, "SELECT count(*) AS n, count(*) AS equal FROM lineitem")
    add("ml_roles", "lineitem", lambda d: d.sparkSession.createDataFrame([(c, "numeric" if r == "numeric" else "other", md.is_id_like(d, c)) for c, r in column_roles(d.schema).items()], "name string, role string, id_like boolean"),
        """SELECT name, CASE WHEN name IN ('l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax') THEN 'numeric' ELSE 'other' END AS role, coalesce(d > 30 AND d > 0.05 * n, false) AS id_like
           FROM (SELECT column_name AS name FROM duckdb_columns() WHERE table_name = 'lineitem') LEFT JOIN (SELECT 'l_shipdate' AS name, count(DISTINCT l_shipdate) AS d, count(*) AS n FROM lineitem) USING (name)""")
    add("ml_evaluate__residuals", "lineitem", lambda d: md.residual_histogram(pred(d)),
        """WITH e AS (SELECT l_extendedprice - l_quantity * 1500 AS e FROM lineitem), s AS (SELECT min(e) AS a, (max(e) - min(e)) / 10 AS w FROM e), b AS (SELECT least(9, floor((e - a) / w))::INT AS bin, a, w FROM e, s)
           SELECT bin, round(a + bin * w, 6) AS low, round(a + (bin + 1) * w, 6) AS high, count(*) AS n FROM b GROUP BY bin, a, w""")
    add("ml_evaluate__bias_over_time", "lineitem", lambda d: md.bias_over_time(d.select("l_shipdate", F.col("l_extendedprice").alias("_y"), (F.col("l_quantity") * 1500).alias("prediction")), "l_shipdate"),
        """WITH g AS (SELECT date_trunc('month', l_shipdate)::DATE AS period, count(*) AS n, sum(l_extendedprice - l_quantity * 1500) AS s FROM lineitem GROUP BY 1)
           SELECT period, n, round(s / n, 6) AS bias, round(sum(s) OVER w / sum(n) OVER w, 6) AS rolling FROM g WINDOW w AS (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
    add("drift__psi", "orders", lambda d: rounded(sa.drift(d.where("o_orderstatus = 'F'"), d.where("o_orderstatus = 'O'"), "o_totalprice").select("psi", "sd_shift"), 4),
        """WITH a AS (SELECT o_totalprice AS v FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_totalprice AS v FROM orders WHERE o_orderstatus = 'O'), q AS (SELECT DISTINCT unnest(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS c FROM a),
           x AS (SELECT (SELECT count(*) FROM q WHERE v > c) AS k, 1 AS s FROM a UNION ALL SELECT (SELECT count(*) FROM q WHERE v > c), 0 FROM b), n AS (SELECT k, greatest(sum(s) / (SELECT count(*) FROM a), 1e-6) AS fa, greatest(sum(1 - s) / (SELECT count(*) FROM b), 1e-6) AS fb FROM x GROUP BY k)
           SELECT round((SELECT sum((fb - fa) * ln(fb / fa)) FROM n), 4) AS psi, round((SELECT stddev_pop(v) FROM b) - (SELECT stddev_pop(v) FROM a), 4) AS sd_shift""")

    def line(d):
        rows = d.withColumn("_y", F.col("l_extendedprice"))
        return Pipeline(stages=[*md.prep_stages(d, ["l_quantity", "l_discount"]), md.estimator("linear", "regression")]).fit(rows)

    slopes = """WITH s AS (SELECT covar_pop(l_extendedprice, l_quantity) AS yq, covar_pop(l_extendedprice, l_discount) AS yd, covar_pop(l_quantity, l_discount) AS qd, var_pop(l_quantity) AS qq, var_pop(l_discount) AS dd, avg(l_extendedprice) AS y, avg(l_quantity) AS q, avg(l_discount) AS d, count(*) AS n FROM lineitem),
           b AS (SELECT *, (dd * yq - qd * yd) / (qq * dd - qd * qd) AS bq, (qq * yd - qd * yq) / (qq * dd - qd * qd) AS bd FROM s)"""
    add("ml_pdp", "lineitem", lambda d: rounded(md.partial_dependence(line(d), d, "l_quantity", [1.0, 10.0, 25.0, 50.0]), 2), slopes + " SELECT v AS value, round(y + bq * (v - q), 2) AS prediction, n FROM b, (SELECT unnest([1.0, 10.0, 25.0, 50.0])::DOUBLE AS v)")
    first = "l_extendedprice = (SELECT max(l_extendedprice) FROM lineitem)"
    add("ml_pdp__row", "lineitem", lambda d: rounded(md.row_contributions(line(d), d, F.col("l_extendedprice") == d.agg(F.max("l_extendedprice")).first()[0], ["l_quantity", "l_discount"]), 2),
        slopes + f" SELECT unnest(['l_quantity', 'l_discount']) AS feature, unnest([l_quantity::DOUBLE, l_discount]) AS value, round(unnest([bq * (l_quantity - q), bd * (l_discount - d)]), 2) AS contribution FROM b, (SELECT * FROM lineitem WHERE {first} LIMIT 1)")
