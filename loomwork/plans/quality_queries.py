"""Queries over profiles, quality rules, reconciliation, migration and the semantic layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import migrate as mg
from ..operators import profile as pf
from ..operators import quality as ql
from ..operators import reconcile as rc
from ..operators import semantic as sm
from .registry import Registry

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
RULES = {
    "status": {"kind": "accepted_values", "column": "o_orderstatus", "values": ["F", "O"]},
    "price": {"kind": "range", "column": "o_totalprice", "min": 1000, "max": 300000},
    "priority": {"kind": "regex", "column": "o_orderpriority", "pattern": "[1-3]-.*"},
    "present": {"kind": "not_null", "columns": ["o_custkey", "o_orderdate"]},
    "count": {"kind": "row_count", "min": 1, "max": 100},
    "fresh": {"kind": "freshness", "column": "o_orderdate", "max_age_days": 36500},
    "custkey": {"kind": "referential", "column": "o_custkey", "ref_table": "customer", "ref_column": "c_custkey"},
    "one_each": {"kind": "unique", "columns": ["o_custkey", "o_orderpriority"]},
}
#: Orders beside a perturbed copy: prices, padded keys, rows on one side, doubled and missing keys.
LEFT = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat(' k', o_orderkey, ' ') END AS code, o_totalprice AS price, o_orderstatus AS status FROM orders"
RIGHT = """SELECT o_orderkey AS id, concat('K', CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey + 1 ELSE o_orderkey END) AS code,
    CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 0.005 WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS price,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE lower(o_orderstatus) END AS status FROM orders WHERE o_orderkey % 17 <> 0"""
SIDES = f"""WITH l AS (SELECT *, lower(trim(code)) AS k FROM ({LEFT})), r AS (SELECT *, lower(trim(code)) AS k FROM ({RIGHT})),
    nl AS (SELECT k, count(*) AS na FROM l WHERE k IS NOT NULL GROUP BY k), nr AS (SELECT k, count(*) AS nb FROM r WHERE k IS NOT NULL GROUP BY k),
    c AS (SELECT coalesce(nl.k, nr.k) AS k, na, nb FROM nl FULL JOIN nr ON nl.k = nr.k),
    ls AS (SELECT l.*, CASE WHEN l.k IS NULL THEN 'missing_key' WHEN nb IS NULL THEN 'only_left' WHEN na > 1 OR nb > 1 THEN 'ambiguous' ELSE 'paired' END AS s FROM l LEFT JOIN c ON l.k = c.k),
    rs AS (SELECT r.*, CASE WHEN r.k IS NULL THEN 'missing_key' WHEN na IS NULL THEN 'only_right' WHEN na > 1 OR nb > 1 THEN 'ambiguous' ELSE 'paired' END AS s FROM r LEFT JOIN c ON r.k = c.k)"""


def sides(orders):
    run = lambda q: orders.sparkSession.sql(q.replace("FROM orders", "FROM {t}"), t=orders)
    return rc.statuses(run(LEFT), run(RIGHT), rc.key(["code"]), rc.key(["code"]))


#: Orders to migrate, with faults: bad numbers, missing values, doubled keys, orphans.
FAULTY = """SELECT o_orderkey AS rid, CASE WHEN o_orderkey % 9 = 0 THEN CAST(o_orderkey - 1 AS {s}) WHEN o_orderkey % 31 = 0 THEN 'x' ELSE CAST(o_orderkey AS {s}) END AS oid,
    CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN CAST(-o_custkey AS {s}) ELSE CAST(o_custkey AS {s}) END AS cust, CASE WHEN o_orderkey % 37 = 0 THEN '' ELSE o_orderstatus END AS st FROM orders"""
PLAN = {"oid": ("oid", "INTEGER"), "cust": ("cust", "INTEGER"), "st": ("st", "TEXT")}


def faulty(orders):
    return orders.sparkSession.sql(FAULTY.format(s="STRING").replace("FROM orders", "FROM {t}"), t=orders)


LOADED = f"""WITH f AS ({FAULTY.format(s='VARCHAR')}), e AS (
      SELECT rid, try_cast(oid AS BIGINT) AS oid, try_cast(cust AS BIGINT) AS cust, st,
             CASE WHEN oid = 'x' THEN 'cast_failure' WHEN oid IS NULL OR st = '' THEN 'missing_required' END AS early,
             try_cast(cust AS BIGINT) IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = try_cast(f.cust AS BIGINT)) AS lost FROM f),
    w AS (SELECT *, min(rid) FILTER (early IS NULL AND NOT lost) OVER (PARTITION BY oid) AS first FROM e)
    SELECT rid, oid, cust, st, coalesce(early, CASE WHEN first < rid AND oid IS NOT NULL THEN 'duplicate_primary_key' WHEN lost THEN 'foreign_key_not_found' END) AS reason FROM w"""


def loaded(orders, customer):
    return mg.load(faulty(orders), PLAN, "rid", ["oid", "st"], ["oid"], foreign={"cust": (customer, "c_custkey")})


MODEL = sm.Model(
    {"day": "o_orderdate", "status": "o_orderstatus", "priority": "o_orderpriority"},
    {"revenue": "round(sum(o_totalprice), 2)", "orders": "count(*)", "revenue_before": ("revenue", "-1 month")},
    "day",
)


def register(r: Registry) -> None:
    add = r.add
    add("profile__nulls", "orders", lambda d: pf.null_profile(d.select(F.nullif("o_orderstatus", F.lit("F")).alias("s"), "o_custkey")).drop("distinct"),
        "SELECT 's' AS \"column\", count(*) AS rows, count(*) FILTER (o_orderstatus = 'F') AS nulls, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 4) AS null_percent FROM orders UNION ALL SELECT 'o_custkey', count(*), 0, 0 FROM orders")
    add("profile__temporal", "orders", lambda d: pf.temporal_profile(d), "SELECT 'o_orderdate' AS \"column\", min(o_orderdate)::TIMESTAMP AS low, max(o_orderdate)::TIMESTAMP AS high, date_diff('day', min(o_orderdate), max(o_orderdate))::INT AS days FROM orders")
    add("profile__text", "orders", lambda d: pf.text_profile(d, ["o_orderstatus", "o_orderpriority"]),
        """WITH c AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2)
           SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value)::INT AS rank FROM c WHERE value IS NOT NULL QUALIFY rank <= 5""")
    ranked = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount"))
    spearman = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM k" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")))
    three = ["l_quantity", "l_extendedprice", "l_discount"]
    add("eda_corr__spearman", "lineitem", lambda d: pf.rank_correlation(d, three), f"WITH k AS (SELECT {ranked} FROM lineitem) {spearman}")
    add("eda_corr__top_pairs", "lineitem", lambda d: pf.top_pairs(pf.rank_correlation(d, three), 2), f"WITH k AS (SELECT {ranked} FROM lineitem), p AS ({spearman}) SELECT * FROM p ORDER BY abs(r) DESC, a, b LIMIT 2")
    add("profile__numeric", "lineitem", lambda d: pf.numeric_profile(d, NUMBERS), " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", min({c}) AS low, max({c}) AS high, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS sd, round(median({c}), 4) AS median, round(any_value(q1), 4) AS q1, round(any_value(q3), 4) AS q3,
            count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers
            FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem)""" for c in NUMBERS))
    add("correlation", "lineitem", lambda d: pf.correlation(d, NUMBERS), " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1:]))
    add("compare_profiles", "orders", lambda d: pf.compare_profiles(d.select("o_orderkey", "o_custkey", "o_orderstatus"), d.select("o_orderkey", F.nullif(F.col("o_custkey"), F.lit(1).cast("long")).alias("o_custkey"), F.length("o_orderstatus").alias("o_orderstatus"), "o_totalprice")),
        """SELECT 'o_orderkey' AS "column", 'shared' AS status, 0::BIGINT AS null_delta UNION ALL SELECT 'o_custkey', 'shared', (SELECT count(*) FROM orders WHERE o_custkey = 1)
           UNION ALL SELECT 'o_orderstatus', 'type_changed', 0 UNION ALL SELECT 'o_totalprice', 'added', NULL""")
    add("fingerprint", "lineitem", pf.fingerprint)
    add("eda_nulls", "orders", lambda d: pf.null_patterns(d.select(F.nullif("o_orderstatus", F.lit("F")).alias("a"), F.expr("nullif(if(o_orderstatus = 'F', 'x', o_orderpriority), 'x')").alias("b"), F.expr("nullif(o_orderkey % 2, 0)").alias("c")), ["a", "b", "c"]),
        "SELECT 'a' AS a, 'b' AS b, 1.0::DOUBLE AS r UNION ALL SELECT 'a', x, r FROM (SELECT 'c' AS x, round(corr((o_orderstatus = 'F')::INT, (o_orderkey % 2 = 0)::INT), 6) AS r FROM orders) WHERE abs(r) > 0.05 UNION ALL SELECT 'b', x, r FROM (SELECT 'c' AS x, round(corr((o_orderstatus = 'F')::INT, (o_orderkey % 2 = 0)::INT), 6) AS r FROM orders) WHERE abs(r) > 0.05")
    add("eda_outliers", "lineitem", lambda d: pf.outliers_report(d, ["l_extendedprice", "l_quantity"]), " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER ({c} < lo OR {c} > hi) AS iqr_outliers, count(*) FILTER (abs(({c} - m) / s) > 3) AS z_outliers, min({c}) FILTER ({c} >= lo AND {c} <= hi) AS low_whisker, max({c}) FILTER ({c} >= lo AND {c} <= hi) AS high_whisker
            FROM lineitem, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, m, s FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, avg({c}) AS m, stddev_samp({c}) AS s FROM lineitem))""" for c in ("l_extendedprice", "l_quantity")))
    label = "CASE WHEN d > 30 AND d > 0.05 * n THEN 'id_like' WHEN d <= 12 THEN 'one_hot' ELSE 'target_or_frequency' END"
    text_sql = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", d AS distinct, {label} AS suggestion FROM (SELECT count(DISTINCT {c}) AS d, count(*) AS n FROM part)" for c in ("p_brand", "p_type", "p_name"))
    add("eda_encoding", "part", lambda d: pf.encoding_suggestions(d, ["p_brand", "p_type", "p_size", "p_name"]),
        f"""{text_sql} UNION ALL SELECT 'p_size', d, CASE WHEN abs(k) < 0.5 THEN 'standard' WHEN abs(k) < 1 THEN 'minmax' WHEN lo > 0 THEN 'log' ELSE 'yeo_johnson' END
            FROM (SELECT count(DISTINCT p_size) AS d, min(p_size) AS lo, (avg(p_size ** 3) - 3 * avg(p_size) * avg(p_size ** 2) + 2 * avg(p_size) ** 3) / stddev_pop(p_size) ** 3 AS k FROM part)""")
    rates = " + ".join(f"(SELECT avg(({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a))::INT) FROM orders, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM orders))" for c in ("o_orderkey", "o_custkey", "o_totalprice"))
    add("eda_score", "orders", pf.quality_score,
        f"""WITH p AS (SELECT 1.0::DOUBLE AS completeness, (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) / count(*)::DOUBLE AS uniqueness,
                1 - count(*) FILTER (lower(trim(o_orderpriority)) IN ('', 'null', 'n/a', 'na', 'none', 'unknown', 'unk', '?', '-', '--', 'missing', '#n/a', 'nan')) / (2.0 * count(*)) AS validity,
                1 - least(1, 4 * ({rates}) / 3) AS outliers, 1.0::DOUBLE AS constants FROM orders)
            SELECT round(completeness, 6) AS completeness, round(uniqueness, 6) AS uniqueness, round(validity, 6)::DOUBLE AS validity, round(outliers, 6) AS outliers, constants,
                round(CASE WHEN least(uniqueness, validity, outliers) = 1 THEN 100 ELSE least(99, 30 + 20 * uniqueness + 20 * validity + 15 * outliers + 15) END, 4)::DOUBLE AS score FROM p""")

    # rules
    kept = lambda d: d.select("o_orderkey")
    add("not_null", "orders", lambda d: kept(ql.failing_rows(d.withColumn("o_custkey", F.nullif(F.col("o_custkey") % 5, F.lit(0).cast("long"))), {"kind": "not_null", "columns": ["o_custkey", "o_orderdate"]})), "SELECT o_orderkey FROM orders WHERE o_custkey % 5 = 0")
    add("unique", "orders", lambda d: kept(ql.failing_rows(d, RULES["one_each"])), "SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderpriority) IN (SELECT (o_custkey, o_orderpriority) FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(*) > 1)")
    add("unique__summary", "orders", lambda d: ql.unique_summary(d, ["o_custkey", "o_orderpriority"]), "SELECT count(*) FILTER (n > 1) AS groups, CAST(sum(n - 1) AS BIGINT) AS extra, count(*) AS after FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderpriority)")
    add("accepted_values", "orders", lambda d: kept(ql.failing_rows(d, RULES["status"])), "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
    add("range", "orders", lambda d: kept(ql.failing_rows(d, RULES["price"])), "SELECT o_orderkey FROM orders WHERE o_totalprice < 1000 OR o_totalprice > 300000")
    add("regex", "orders", lambda d: kept(ql.failing_rows(d, RULES["priority"])), "SELECT o_orderkey FROM orders WHERE NOT regexp_full_match(o_orderpriority, '[1-3]-.*')")
    add("row_count", "orders", lambda d: ql.scalar_rule(d, RULES["count"]), "SELECT count(*) AS checked, CASE WHEN count(*) BETWEEN 1 AND 100 THEN 0 ELSE 1 END::BIGINT AS failed FROM orders")
    add("freshness", "orders", lambda d: ql.scalar_rule(d, {"kind": "freshness", "column": "o_orderdate", "max_age_days": 100}, "2000-01-01"), "SELECT count(*) AS checked, CASE WHEN date_diff('day', max(o_orderdate), TIMESTAMP '2000-01-01') <= 100 THEN 0 ELSE 1 END::BIGINT AS failed FROM orders")
    add("referential", "orders customer", lambda o, c: kept(ql.failing_rows(o, RULES["custkey"], {"customer": c.where("c_custkey % 7 > 0")})), "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 > 0)")
    add("custom_sql", "orders", lambda d: ql.failing_rows(d, {"kind": "custom_sql", "sql": "SELECT o_orderkey FROM {t} WHERE o_totalprice > 10 * o_custkey"}), "SELECT o_orderkey FROM orders WHERE o_totalprice > 10 * o_custkey")
    add("rule_suite", "orders customer", lambda o, c: ql.run_suite(o, RULES, {"customer": c}, "2000-01-01"),
        """WITH n AS (SELECT count(*) AS c FROM orders), f AS (
            SELECT 'status' AS rule, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS failed FROM orders UNION ALL SELECT 'price', count(*) FILTER (o_totalprice < 1000 OR o_totalprice > 300000) FROM orders
            UNION ALL SELECT 'priority', count(*) FILTER (NOT regexp_full_match(o_orderpriority, '[1-3]-.*')) FROM orders UNION ALL SELECT 'present', 0
            UNION ALL SELECT 'count', CASE WHEN count(*) BETWEEN 1 AND 100 THEN 0 ELSE 1 END FROM orders UNION ALL SELECT 'fresh', 0
            UNION ALL SELECT 'custkey', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
            UNION ALL SELECT 'one_each', CAST(coalesce(sum(k) FILTER (k > 1), 0) AS BIGINT) FROM (SELECT count(*) AS k FROM orders GROUP BY o_custkey, o_orderpriority))
           SELECT rule, c AS checked, failed, failed = 0 AS passed FROM f, n""")

    # reconcile
    add("rec_profile", "orders", lambda d: rc.profile(d.select(F.nullif(F.col("o_custkey") % 3, F.lit(1).cast("long")).alias("a"), F.expr("if(o_orderkey % 2 = 0, ' ', o_orderstatus)").alias("b"), "o_orderkey")),
        """SELECT 'a' AS "column", count(*) AS rows, count(*) FILTER (o_custkey % 3 = 1) AS missing, 0 AS empty, count(*) FILTER (o_custkey % 3 = 0) AS zeros, count(DISTINCT nullif(o_custkey % 3, 1)) AS "distinct", false AS is_unique FROM orders
           UNION ALL SELECT 'b', count(*), 0, count(*) FILTER (o_orderkey % 2 = 0), 0, count(DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE o_orderstatus END), false FROM orders
           UNION ALL SELECT 'o_orderkey', count(*), 0, 0, count(*) FILTER (o_orderkey = 0), count(DISTINCT o_orderkey), true FROM orders""")
    add("rec_suggest", "customer orders", lambda c, o: rc.suggest(c.select("c_custkey", "c_name", "c_nationkey"), o.select("o_custkey", "o_orderstatus", "o_orderkey")))
    add("rec_key", "orders", lambda d: sides(d)[0].select("id", F.col("_key").alias("k")), f"{SIDES} SELECT id, k FROM l")
    add("rec_status", "orders", lambda d: rc.bucket_counts(*sides(d)), f"{SIDES} SELECT 'left' AS side, s AS status, count(*) AS n FROM ls GROUP BY s UNION ALL SELECT 'right', s, count(*) FROM rs GROUP BY s")
    add("rec_cells", "orders", lambda d: rc.cells(*sides(d), [("price", "price"), ("status", "status")], 0.01),
        f"""{SIDES}, p AS (SELECT ls.price AS a, rs.price AS b, ls.status AS c, rs.status AS d FROM ls JOIN rs ON ls.k = rs.k WHERE ls.s = 'paired' AND rs.s = 'paired')
            SELECT 'price' AS field, CASE WHEN a IS NULL AND b IS NULL THEN 'both_missing' WHEN b IS NULL THEN CASE WHEN a = 0 THEN 'zero_vs_missing' ELSE 'only_left_value' END WHEN a = b THEN 'equal' WHEN abs(a - b) <= 0.01 THEN 'equal_within_tolerance' ELSE 'different' END AS category, count(*) AS n FROM p GROUP BY 2
            UNION ALL SELECT 'status', CASE WHEN d IS NULL THEN 'only_left_value' WHEN c = d THEN 'equal' ELSE 'different' END, count(*) FROM p GROUP BY 2""")
    add("rec_rows", "orders", lambda d: rc.rows_table(*sides(d), "id", "id"),
        f"""{SIDES} SELECT ls.k AS key, ls.id AS left_id, rs.id AS right_id, 'paired' AS status FROM ls JOIN rs ON ls.k = rs.k WHERE ls.s = 'paired' AND rs.s = 'paired'
            UNION ALL SELECT k, id, NULL, s FROM ls WHERE s <> 'paired' UNION ALL SELECT k, NULL, id, s FROM rs WHERE s <> 'paired'""")

    # migration
    add("mig_cast", "part", lambda d: d.select("p_partkey", *[mg.cast_strict(F.expr("case p_partkey % 4 when 0 then cast(p_size as string) when 1 then concat(p_size, '.0') when 2 then concat(p_size, '.5') else p_brand end"), k).alias(k) for k in ("INTEGER", "REAL", "TEXT")]),
        """SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN p_size::BIGINT END AS "INTEGER", CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size WHEN 2 THEN p_size + 0.5 END::DOUBLE AS "REAL",
           CASE p_partkey % 4 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_size || '.0' WHEN 2 THEN p_size || '.5' ELSE p_brand END AS "TEXT" FROM part""")
    add("mig_reject", "orders customer", loaded, LOADED)
    add("mig_reject__counts", "orders customer", lambda o, c: loaded(o, c).groupBy("reason").agg(F.count("*").alias("n")), f"SELECT reason, count(*) AS n FROM ({LOADED}) GROUP BY reason")
    add("mig_semantics", "orders", lambda d: mg.column_semantics(d.select(F.expr("case o_orderkey % 3 when 0 then concat(o_orderkey, '.0') when 1 then cast(o_orderkey as string) else 'n/a' end").alias("k")), {"key": ("k", "INTEGER")}),
        "SELECT 'key' AS \"column\", count(*) AS considered, count(*) FILTER (o_orderkey % 3 = 2) AS changed, count(*) FILTER (o_orderkey % 3 = 0) AS format_only, count(*) FILTER (o_orderkey % 3 = 1) AS exact FROM orders")
    add("mig_totals", "orders", lambda d: mg.totals(d, d.where("o_orderkey % 100 > 0"), {"rows": ("count(*)", "count(*)"), "price": ("sum(o_totalprice)", "sum(o_totalprice)")}, 1.0),
        "SELECT 'rows' AS \"check\", count(*)::DOUBLE AS source, count(*) FILTER (o_orderkey % 100 > 0)::DOUBLE AS target, abs(count(*) - count(*) FILTER (o_orderkey % 100 > 0)) <= 1 AS ok FROM orders UNION ALL SELECT 'price', round(sum(o_totalprice), 4), round(sum(o_totalprice) FILTER (o_orderkey % 100 > 0), 4), false FROM orders")
    add("mig_idempotent", "orders customer", lambda o, c: pf.fingerprint(mg.upsert(mg.upsert(x := loaded(o, c).where("reason is null").drop("reason"), x, ["oid"]), x, ["oid"])))
    add("mig_suggest", "orders", lambda d: mg.suggest_table(d.select("o_orderkey", "o_orderstatus", "o_totalprice", F.nullif("o_custkey", F.lit(1).cast("long")).alias("c"), F.col("o_orderdate").cast("date").alias("d"))),
        """SELECT 'o_orderkey' AS "column", 'INTEGER' AS kind, true AS required, true AS is_key UNION ALL SELECT 'o_orderstatus', 'TEXT', true, false UNION ALL SELECT 'o_totalprice', 'REAL', true, (SELECT count(DISTINCT o_totalprice) = count(*) FROM orders)
           UNION ALL SELECT 'c', 'INTEGER', (SELECT count(*) = 0 FROM orders WHERE o_custkey = 1), (SELECT count(DISTINCT o_custkey) = count(*) FROM orders) UNION ALL SELECT 'd', 'DATE', true, (SELECT count(DISTINCT o_orderdate::DATE) = count(*) FROM orders)""")
    add("query_compare", "orders", lambda d: mg.query_diff(d.select("o_custkey", "o_orderstatus"), d.where("o_orderkey % 10 > 0").select("o_custkey", "o_orderstatus")),
        "SELECT o_custkey, o_orderstatus, count(*) AS n_source, count(*) FILTER (o_orderkey % 10 > 0) AS n_target FROM orders GROUP BY 1, 2 HAVING count(*) <> count(*) FILTER (o_orderkey % 10 > 0)")

    # semantic layer
    month = "date_trunc('month', o_orderdate)::DATE"
    add("sem_query", "orders", lambda d: sm.query(d, MODEL, ["revenue", "orders"], ["day", "status"], grain="month"), f"SELECT {month} AS day, o_orderstatus AS status, round(sum(o_totalprice), 2) AS revenue, count(*) AS orders FROM orders GROUP BY 1, 2")
    add("sem_query__order_limit", "orders", lambda d: sm.query(d, MODEL, ["orders"], ["priority"], order=["-orders", "priority"], limit=3), "SELECT o_orderpriority AS priority, count(*) AS orders FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
    add("sem_filter", "orders", lambda d: sm.query(d, MODEL, ["orders"], ["status"], [{"dim": "priority", "op": "contains", "value": "HIGH"}, {"dim": "status", "op": "in", "value": ["F", "O"]}, {"dim": "day", "op": "gte", "value": "1995-01-01"}, {"dim": "status", "op": "eq", "value": "all"}]),
        "SELECT o_orderstatus AS status, count(*) AS orders FROM orders WHERE o_orderpriority ILIKE '%high%' AND o_orderstatus IN ('F', 'O') AND o_orderdate >= '1995-01-01' GROUP BY 1")
    add("sem_offset_scalar", "orders", lambda d: sm.query(d, MODEL, ["revenue", "revenue_before"], [], [{"dim": "day", "op": "between", "value": ["1995-03-31", "1995-06-30"]}]),
        "SELECT (SELECT round(sum(o_totalprice), 2) FROM orders WHERE o_orderdate BETWEEN '1995-03-31' AND '1995-06-30') AS revenue, (SELECT round(sum(o_totalprice), 2) FROM orders WHERE o_orderdate BETWEEN '1995-02-28' AND '1995-05-30') AS revenue_before")
    offset_sql = f"""WITH g AS (SELECT {month} AS day, round(sum(o_totalprice), 2) AS revenue FROM orders WHERE o_orderdate >= '1995-01-01' GROUP BY 1)
        SELECT a.day, a.revenue, b.revenue AS revenue_before FROM g a LEFT JOIN g b ON a.day = (b.day + INTERVAL 1 MONTH)::DATE"""
    offset = lambda d: sm.query(d, MODEL, ["revenue", "revenue_before"], ["day"], [{"dim": "day", "op": "gte", "value": "1995-01-01"}], grain="month")
    add("sem_offset_grouped", "orders", offset, offset_sql)
    add("sem_delta", "orders", lambda d: sm.delta(offset(d), "revenue", "revenue_before").withColumn("delta_percent", F.round("delta_percent", 4)), f"SELECT *, CASE WHEN revenue_before <> 0 THEN round(100 * (revenue - revenue_before) / revenue_before, 4) END AS delta_percent FROM ({offset_sql})")
    add("sem_top_loop", "orders", lambda d: sm.top_loop(d, MODEL, "priority", "orders", 2, ["orders"], "status"),
        "SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS orders FROM orders WHERE o_orderpriority IN (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2) GROUP BY 1, 2")
    add("sem_select_options", "orders", lambda d: sm.options(d, MODEL, "priority"), "SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderpriority IS NOT NULL")
