"""Queries over the step catalogue, joins, aggregates, windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as tx
from ..operators import charts as ch
from ..operators import steps as st
from .registry import Registry

FLAG = "SELECT l_returnflag, l_linestatus"


def pricing_summary(lineitem):
    """Filter, derive, group and sort: the pricing summary of lineitem."""
    out = st.filter_rows(lineitem, "l_shipdate <= timestamp_ntz'1998-09-02'")
    out = st.derive(out, "revenue", "l_extendedprice * (1 - l_discount)")
    out = st.group(out, ["l_returnflag", "l_linestatus"], [
        {"fn": "sum", "column": "l_quantity", "alias": "sum_qty"}, {"fn": "sum", "column": "revenue", "alias": "sum_revenue"},
        {"fn": "avg", "column": "l_discount", "alias": "avg_disc"}, {"fn": "count", "alias": "n_rows"},
    ])
    out = out.withColumn("sum_revenue", F.round("sum_revenue", 2)).withColumn("avg_disc", F.round("avg_disc", 6))
    return st.sort(out, ["l_returnflag", "l_linestatus"])


def register(r: Registry) -> None:
    add = r.add
    add("pricing_summary", "lineitem", pricing_summary, """
        SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_revenue,
               round(avg(l_discount), 6) AS avg_disc, count(*) AS n_rows
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
    add("filter", "lineitem", lambda d: st.select(st.filter_rows(d, "l_quantity > 45 AND l_discount < 0.02"), ["l_orderkey", "l_linenumber", "l_quantity"]),
        "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.02")
    add("select", "part", lambda d: st.select(d, ["p_brand", "p_partkey"]), "SELECT p_brand, p_partkey FROM part")
    add("drop", "customer", lambda d: st.drop(d, ["c_name", "c_acctbal"]), "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
    add("rename", "supplier", lambda d: st.rename(d, {"s_name": "supplier", "s_acctbal": "balance"}),
        "SELECT s_suppkey, s_name AS supplier, s_nationkey, s_acctbal AS balance FROM supplier")
    add("cast__integer_half_even", "lineitem", lambda d: st.cast(d.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 2).alias("half")), "half", "integer"),
        "SELECT l_orderkey, l_linenumber, CAST(l_quantity / 2 AS BIGINT) AS half FROM lineitem")
    add("cast__spanish_number", "orders", lambda d: st.cast(d.select("o_orderkey", F.concat(F.lit("1."), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.lit(",25")).alias("v")), "v", "double", spanish_number=True),
        "SELECT o_orderkey, 1000 + o_orderkey % 1000 + 0.25::DOUBLE AS v FROM orders")
    add("cast__date_format", "orders", lambda d: st.cast(d.select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("d")), "d", "date", date_format="%d/%m/%Y"),
        "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders")
    price = lambda d: d.select("p_partkey", F.round(F.col("p_retailprice") + F.col("p_size") / 4, 2).cast("decimal(12,2)").alias("v"))
    for to, sql in (("integer", "BIGINT"), ("double", "DOUBLE"), ("text", "VARCHAR"), ("decimal", "DECIMAL(18,4)")):
        add(f"cast__decimal_{to}", "part", lambda d, to=to: st.cast(price(d), "v", to), f"SELECT p_partkey, CAST(CAST(round(p_retailprice + p_size / 4, 2) AS DECIMAL(12,2)) AS {sql}) AS v FROM part")
    add("cast__bigint_text", "orders", lambda d: st.cast(d.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" 9007199254"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))).otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit(".5"))).alias("v")), "v", "integer"),
        "SELECT o_orderkey, try_cast(CASE WHEN o_orderkey % 2 = 0 THEN ' 9007199254' || lpad(o_orderkey::VARCHAR, 8, '0') ELSE o_orderkey || '.5' END AS BIGINT) AS v FROM orders")
    add("cast__failure_is_null", "part", lambda d: st.cast(d.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.lit("x")).alias("v")), "v", "integer"),
        "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS BIGINT) END AS v FROM part")
    gap = lambda d: d.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 5 != 0, F.round("o_totalprice", 0)).alias("v"))
    gap_sql = "(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 <> 0 THEN round(o_totalprice, 0) END AS v FROM orders)"
    add("fill_null__value", "orders", lambda d: st.fill_null(gap(d), "v", "value", -1.0), f"SELECT o_orderkey, o_custkey, coalesce(v, -1) AS v FROM {gap_sql}")
    add("fill_null__mean", "orders", lambda d: st.fill_null(gap(d), "v", "mean").withColumn("v", F.round("v", 4)),
        f"SELECT o_orderkey, o_custkey, round(coalesce(v, (SELECT avg(v) FROM {gap_sql})), 4) AS v FROM {gap_sql}")
    add("fill_null__median", "orders", lambda d: st.fill_null(gap(d), "v", "median"), f"SELECT o_orderkey, o_custkey, coalesce(v, (SELECT median(v) FROM {gap_sql})) AS v FROM {gap_sql}")
    add("fill_null__mode", "part", lambda d: st.fill_null(d.select("p_partkey", F.when(F.col("p_partkey") % 4 != 0, F.col("p_size")).alias("v")), "v", "mode"),
        """WITH g AS (SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS v FROM part),
           m AS (SELECT v FROM g WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1)
           SELECT p_partkey, coalesce(v, (SELECT v FROM m)) AS v FROM g""")
    add("fill_null__forward", "orders", lambda d: st.fill_null(gap(d), "v", "forward", order_by=["o_orderkey"]),
        f"SELECT o_orderkey, o_custkey, last_value(v IGNORE NULLS) OVER (ORDER BY o_orderkey) AS v FROM {gap_sql}")
    add("fill_null__forward_by_key", "orders", lambda d: st.fill_null(gap(d), "v", "forward", order_by=["o_orderkey"], partition_by=["o_custkey"]),
        f"SELECT o_orderkey, o_custkey, last_value(v IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS v FROM {gap_sql}")
    add("drop_duplicates", "lineitem", lambda d: st.drop_duplicates(d.select("l_orderkey", "l_suppkey", "l_linenumber"), ["l_suppkey"], ["l_orderkey", "l_linenumber"]),
        "SELECT l_orderkey, l_suppkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) = 1")
    add("drop_duplicates__all_columns", "part", lambda d: st.drop_duplicates(d.select("p_brand", "p_size")), "SELECT DISTINCT p_brand, p_size FROM part")
    add("derive", "part", lambda d: st.derive(d.select("p_partkey", "p_retailprice"), "p_retailprice", "floor(p_retailprice * 10)"),
        "SELECT p_partkey, CAST(floor(p_retailprice * 10) AS BIGINT) AS p_retailprice FROM part")
    add("split_column", "customer", lambda d: st.split_column(d.select("c_name"), "c_name", ["a", "b", "c"], "#"),
        "SELECT c_name, nullif(split_part(c_name, '#', 1), '') AS a, nullif(split_part(c_name, '#', 2), '') AS b, nullif(split_part(c_name, '#', 3), '') AS c FROM customer")
    for op, sql in (("trim", "trim(v)"), ("upper", "upper(replace(v, 'ß', 'SS'))"), ("lower", "lower(v)"), ("collapse_spaces", "trim(regexp_replace(v, '\\s+', ' ', 'g'))"),
                    ("strip_accents", "strip_accents(v)"),
                    ("title", "array_to_string(list_transform(regexp_extract_all(v, '([\\p{L}\\p{M}]+|[^\\p{L}\\p{M}]+)'), lambda p: upper(replace(p[1], 'ß', 'SS')) || lower(p[2:])), '')")):
        add(f"text__{op}", "documents", lambda d, op=op: st.text(d.select("doc_id", F.concat(F.lit("  "), "text", F.lit("  ")).alias("v")), "v", op),
            f"SELECT doc_id, {sql} AS v FROM (SELECT doc_id, '  ' || text || '  ' AS v FROM documents)")
    add("replace__literal", "part", lambda d: st.replace(d.select("p_partkey", "p_type"), "p_type", "E", "3"), "SELECT p_partkey, replace(p_type, 'E', '3') AS p_type FROM part")
    add("replace__regex", "customer", lambda d: st.replace(d.select("c_custkey", "c_name"), "c_name", "([A-Za-z]+)#0*(\\d+)", "\\2-\\1", regex=True),
        "SELECT c_custkey, regexp_replace(c_name, '([A-Za-z]+)#0*(\\d+)', '\\2-\\1', 'g') AS c_name FROM customer")
    add("bin__edges", "part", lambda d: st.bin_edges(d.select("p_partkey", "p_size"), "p_size", [1, 10, 30, 45], "bin", ["small", "mid", "large"]),
        "SELECT p_partkey, p_size, CASE WHEN p_size >= 1 AND p_size < 10 THEN 'small' WHEN p_size >= 10 AND p_size < 30 THEN 'mid' WHEN p_size >= 30 AND p_size < 45 THEN 'large' END AS bin FROM part")
    add("bin__width", "part", lambda d: st.bin_width(d.select("p_partkey", "p_size"), "p_size", "bin", 7),
        "SELECT p_partkey, p_size, CAST(least(6, floor((p_size - lo) / (hi - lo)::DOUBLE * 7)) AS BIGINT) AS bin FROM part, (SELECT min(p_size) lo, max(p_size) hi FROM part)")
    add("bin__width_constant", "nation", lambda d: st.bin_width(d.select("n_nationkey", F.lit(4).alias("v")), "v", "bin", 5), "SELECT n_nationkey, 4 AS v, 4::BIGINT AS bin FROM nation")
    add("date_parts", "orders", lambda d: st.date_parts(d.select("o_orderkey", F.col("o_orderdate").alias("d")), "d", list(st.DATE_PARTS)),
        """SELECT o_orderkey, o_orderdate AS d, year(o_orderdate) AS d_year, month(o_orderdate) AS d_month, day(o_orderdate) AS d_day, dayofweek(o_orderdate) AS d_dow,
           quarter(o_orderdate) AS d_quarter, week(o_orderdate) AS d_week, hour(o_orderdate) AS d_hour, minute(o_orderdate) AS d_minute FROM orders""")
    add("sql", "orders", lambda d: st.sql(d, "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM {prev} GROUP BY o_orderstatus"),
        "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_orderstatus")

    # joins
    on = [{"left": "c_custkey", "right": "o_custkey"}]
    few = lambda c, o: (c.select("c_custkey", "c_name"), o.select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("c_name")))
    for how in ("inner", "left", "right", "full"):
        add(f"join__{how}", "customer orders", lambda c, o, how=how: st.join(*few(c, o), on, how),
            f"""SELECT c.c_custkey, c.c_name, o.o_orderkey, o.o_orderstatus AS c_name_1 FROM (SELECT * FROM customer) c
                {how} JOIN (SELECT * FROM orders) o ON c.c_custkey = o.o_custkey""")
    add("join_match_rate", "customer orders", lambda c, o: ch.match_rate(c, o, on),
        """SELECT count(*) AS rows, count(*) FILTER (m) AS matched, round(count(*) FILTER (m) / count(*)::DOUBLE, 4) AS rate
           FROM (SELECT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS m FROM customer)""")
    add("semi", "customer orders", lambda c, o: c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"),
        "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
    add("anti", "customer orders", lambda c, o: c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"),
        "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
    add("cross_scalar", "part", lambda d: d.select("p_partkey", "p_retailprice").crossJoin(F.broadcast(d.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi")))),
        "SELECT p_partkey, p_retailprice, lo, hi FROM part, (SELECT min(p_retailprice) lo, max(p_retailprice) hi FROM part)")

    # aggregates and reshaping
    fns = [{"fn": f, "column": "p_size"} for f in st.AGGREGATES] + [{"fn": "count"}]
    agg_sql = """CAST(sum(p_size) AS BIGINT) AS sum_p_size, avg(p_size) AS avg_p_size, min(p_size) AS min_p_size, max(p_size) AS max_p_size, count(p_size) AS count_p_size,
        count(DISTINCT p_size) AS count_distinct_p_size, median(p_size) AS median_p_size, stddev_samp(p_size) AS stddev_p_size, count(*) AS count"""
    six = lambda d: d.withColumns({c: F.round(c, 6) for c in ("avg_p_size", "stddev_p_size")})
    six_sql = "* REPLACE (round(avg_p_size, 6) AS avg_p_size, round(stddev_p_size, 6) AS stddev_p_size)"
    add("group", "part", lambda d: six(st.group(d, ["p_brand"], fns)), f"SELECT {six_sql} FROM (SELECT p_brand, {agg_sql} FROM part GROUP BY p_brand)")
    add("group__grand_total", "part", lambda d: six(st.group(d, [], fns)), f"SELECT {six_sql} FROM (SELECT {agg_sql} FROM part)")
    add("pivot", "orders", lambda d: st.pivot(d, "o_orderstatus", "o_totalprice", "max", ["o_custkey"]),
        """SELECT o_custkey, max(o_totalprice) FILTER (o_orderstatus = 'F') AS "F", max(o_totalprice) FILTER (o_orderstatus = 'O') AS "O", max(o_totalprice) FILTER (o_orderstatus = 'P') AS "P"
           FROM orders GROUP BY o_custkey""")
    add("unpivot", "lineitem", lambda d: st.unpivot(d.select("l_orderkey", "l_linenumber", F.nullif("l_discount", F.lit(0.0)).alias("l_discount"), "l_tax"), ["l_discount", "l_tax"]),
        """SELECT l_orderkey, l_linenumber, 'l_discount' AS key, l_discount AS value FROM lineitem WHERE l_discount <> 0
           UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem""")
    add("frequencies", "part", lambda d: ch.frequencies(d, "p_size", 0, 50),
        "SELECT p_size AS value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM part GROUP BY 1 ORDER BY n DESC, value NULLS LAST LIMIT 50")
    add("top_values", "part", lambda d: ch.top_values(d, "p_type", 5), "SELECT p_type AS value, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
    for bins in (10, 20):
        add(f"histogram__{bins}", "lineitem", lambda d, bins=bins: ch.histogram(d, "l_extendedprice", bins),
            f"""SELECT CAST(least({bins - 1}, floor((l_extendedprice - lo) / (hi - lo) * {bins})) AS BIGINT) AS bin, count(*) AS n
                FROM lineitem, (SELECT min(l_extendedprice) lo, max(l_extendedprice) hi FROM lineitem) GROUP BY 1""")
    add("box", "orders", lambda d: ch.box(d, "o_totalprice", "o_orderpriority"),
        """SELECT o_orderpriority AS x, min(o_totalprice) AS low, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(median(o_totalprice), 4) AS median,
           round(quantile_cont(o_totalprice, 0.75), 4) AS q3, max(o_totalprice) AS high FROM orders GROUP BY 1""")
    add("series_1d", "orders", lambda d: ch.series(d, "o_orderpriority", "o_totalprice", "avg"), "SELECT o_orderpriority AS x, round(avg(o_totalprice), 4) AS y FROM orders GROUP BY 1")
    add("series_2d", "orders", lambda d: ch.series(d, "o_orderpriority", "o_totalprice", "max", "o_orderstatus", "o_totalprice > 1000"),
        "SELECT o_orderpriority AS x, o_orderstatus AS color, round(max(o_totalprice), 4) AS y FROM orders WHERE o_totalprice > 1000 GROUP BY 1, 2")
    add("heatmap", "part", lambda d: ch.heatmap(d, "p_brand", "p_size"), "SELECT p_brand AS x, p_size AS y, count(*) AS value FROM part GROUP BY 1, 2")
    add("top_share", "part", lambda d: ch.top_share(d, "p_type"), "SELECT p_type AS x, count(*)::DOUBLE AS y FROM part WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
    add("pareto", "part", lambda d: ch.pareto(d, "p_brand", "p_size", "sum"),
        """WITH t AS (SELECT p_brand AS x, sum(p_size)::DOUBLE AS y FROM part WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)
           SELECT x, y, round(100 * sum(y) OVER (ORDER BY y DESC, x) / sum(y) OVER (), 4) AS cumulative FROM t""")
    add("kpi", "orders", lambda d: ch.kpi(d, "round(sum(o_totalprice) / count(distinct o_custkey), 4)"), "SELECT round(sum(o_totalprice) / count(DISTINCT o_custkey), 4) AS value FROM orders")

    # windows
    base = "SELECT o_orderkey, o_custkey, o_totalprice,"
    over = "OVER (PARTITION BY o_custkey ORDER BY o_orderkey"
    cols = lambda d: d.select("o_orderkey", "o_custkey", "o_totalprice")
    for fn, sql in (("lag", f"lag(o_totalprice, 2) {over})"), ("lead", f"lead(o_totalprice, 2) {over})"),
                    ("rolling_mean", f"round(avg(o_totalprice) {over} ROWS 2 PRECEDING), 4)"), ("rolling_sum", f"round(sum(o_totalprice) {over} ROWS 2 PRECEDING), 4)"),
                    ("row_number", f"row_number() {over})"), ("rank", f"rank() {over})")):
        def run(d, fn=fn):
            column = None if fn in ("row_number", "rank") else "o_totalprice"
            out = st.window(cols(d), fn, ["o_orderkey"], column, ["o_custkey"], offset=2, new_column="w")
            return out.withColumn("w", F.round("w", 4)) if fn.startswith("rolling") else out
        add(f"window__{fn}", "orders", run, f"{base} {sql} AS w FROM orders")

    whole = "OVER (ORDER BY o_totalprice, o_orderkey"
    for fn, sql in (("lag", f"lag(o_totalprice, 2) {whole})"), ("lead", f"lead(o_totalprice, 2) {whole})"), ("rolling_mean", f"round(avg(o_totalprice) {whole} ROWS 2 PRECEDING), 4)"),
                    ("rolling_sum", f"round(sum(o_totalprice) {whole} ROWS 2 PRECEDING), 4)"), ("row_number", f"row_number() {whole})"), ("rank", "rank() OVER (ORDER BY o_custkey)")):
        def run_all(d, fn=fn):
            column = None if fn in ("row_number", "rank") else "o_totalprice"
            out = st.window(cols(d), fn, ["o_custkey"] if fn == "rank" else ["o_totalprice", "o_orderkey"], column, offset=2, new_column="w")
            return out.withColumn("w", F.round("w", 4)) if fn.startswith("rolling") else out
        add(f"window__whole_{fn}", "orders", run_all, f"{base} {sql} AS w FROM orders")

    # sort, limit, sets
    add("sort_limit", "orders", lambda d: st.sort(d.select("o_orderkey", "o_totalprice"), [{"column": "o_totalprice", "desc": True}, "o_orderkey"]).limit(100),
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100")
    add("page", "orders", lambda d: ch.page(st.sort(d.select("o_orderkey", "o_custkey"), ["o_orderkey"]), 50, 20), "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 21 OFFSET 50")
    add("sample__n", "orders", lambda d: st.sample(d.select("o_orderkey"), n=100))
    add("sample__frac", "orders", lambda d: st.sample(d.select("o_orderkey"), frac=0.1))
    add("union", "customer supplier", lambda c, s: st.union(c.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("bal"), "c_mktsegment"), s.select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("bal"))),
        "SELECT c_custkey AS key, c_acctbal AS bal, c_mktsegment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
    add("union__distinct", "customer supplier", lambda c, s: st.union(c.select(F.col("c_nationkey").alias("n")), s.select(F.col("s_nationkey").alias("n")), True),
        "SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier")
    add("compare_rows", "lineitem", lambda d: ch.compare_rows(d.select("l_suppkey", "l_returnflag"), d.select(F.col("l_partkey").alias("l_suppkey"), "l_returnflag")),
        """WITH a AS (SELECT l_suppkey, l_returnflag FROM lineitem), b AS (SELECT l_partkey AS l_suppkey, l_returnflag FROM lineitem)
           SELECT 'only_a' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'only_b', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")

    # scalar functions
    add("fn__strings", "customer", lambda d: d.selectExpr("c_custkey", "upper(trim(c_name)) AS a", "lower(c_mktsegment) AS b", "length(c_name) AS c", "substr(c_name, 3, 4) AS d", "split_part(c_name, '#', 2) AS e", "instr(c_name, '#') AS f", "concat_ws('-', c_mktsegment, c_nationkey) AS g", "c_mktsegment ILIKE '%build%' AS h"),
        "SELECT c_custkey, upper(trim(c_name)) AS a, lower(c_mktsegment) AS b, length(c_name) AS c, substr(c_name, 3, 4) AS d, split_part(c_name, '#', 2) AS e, strpos(c_name, '#') AS f, concat_ws('-', c_mktsegment, c_nationkey) AS g, c_mktsegment ILIKE '%build%' AS h FROM customer")
    add("fn__nulls_and_math", "part", lambda d: d.selectExpr("p_partkey", "nullif(p_size, 1) AS a", "coalesce(nullif(p_size, 1), -5) AS b", "abs(p_size - 25) AS c", "floor(p_retailprice / 7) AS d", "least(p_size, 20, NULL) AS e", "round(ln(p_size), 6) AS f", "nullif(p_size, 1) IS DISTINCT FROM 7 AS g", "p_size BETWEEN 5 AND 9 OR p_size IN (1, 2) AS h"),
        "SELECT p_partkey, nullif(p_size, 1) AS a, coalesce(nullif(p_size, 1), -5) AS b, abs(p_size - 25) AS c, CAST(floor(p_retailprice / 7) AS BIGINT) AS d, least(p_size, 20, NULL) AS e, round(ln(p_size), 6) AS f, nullif(p_size, 1) IS DISTINCT FROM 7 AS g, p_size BETWEEN 5 AND 9 OR p_size IN (1, 2) AS h FROM part")
    add("fn__regexp", "part", lambda d: d.selectExpr("p_partkey", "regexp_replace(p_type, '[AEIOU]', '*') AS a", "p_type RLIKE '^[SM]' AS b", "p_brand RLIKE '^(?:Brand#[1-3]\\\\d*)$' AS c", "array_join(transform(regexp_extract_all(p_type, '([A-Z]+)', 1), x -> lower(x)), '+') AS d"),
        "SELECT p_partkey, regexp_replace(p_type, '[AEIOU]', '*', 'g') AS a, regexp_matches(p_type, '^[SM]') AS b, regexp_full_match(p_brand, 'Brand#[1-3]\\d*') AS c, array_to_string(list_transform(regexp_extract_all(p_type, '([A-Z]+)'), lambda x: lower(x)), '+') AS d FROM part")
    add("fn__time", "orders", lambda d: d.selectExpr("o_orderkey", "date_trunc('month', o_orderdate) AS a", "datediff(o_orderdate, timestamp_ntz'1995-01-01') AS b", "add_months(o_orderdate, -1) AS c", "o_orderdate + interval 3 days AS d", "extract(quarter from o_orderdate) AS e", "unix_micros(cast(o_orderdate as timestamp)) / 1e6 AS f"),
        "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS a, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS b, CAST(o_orderdate - INTERVAL 1 MONTH AS DATE) AS c, o_orderdate + INTERVAL 3 DAYS AS d, quarter(o_orderdate) AS e, epoch(o_orderdate) AS f FROM orders")
    add("fn__try", "customer", lambda d: d.selectExpr("c_custkey", "try_cast(split_part(c_name, '#', 2) AS bigint) AS a", "try_cast(c_mktsegment AS bigint) AS b", "count_if(c_acctbal > 0) OVER (PARTITION BY c_nationkey) AS c"),
        "SELECT c_custkey, try_cast(split_part(c_name, '#', 2) AS BIGINT) AS a, try_cast(c_mktsegment AS BIGINT) AS b, count(*) FILTER (c_acctbal > 0) OVER (PARTITION BY c_nationkey) AS c FROM customer")
    add("fn__json", "events", lambda d: d.selectExpr("event_id", "get_json_object(props, '$.k') AS k", "get_json_object(props, '$.v') AS v"), "SELECT event_id, props->>'$.k' AS k, props->>'$.v' AS v FROM events")

    # dates
    pair = lambda d: d.select("o_orderkey", F.col("o_orderdate").cast("date").alias("a"), F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 900).cast("int")).alias("b"))
    pair_sql = "(SELECT o_orderkey, o_orderdate::DATE AS a, o_orderdate::DATE + (o_orderkey % 900)::INT AS b FROM orders)"
    add("date_diff_calendar", "orders", lambda d: pair(d).select("o_orderkey", *dates.diff("a", "b")),
        f"SELECT o_orderkey, date_diff('day', a, b) AS days, date_diff('day', a, b) // 7 AS weeks, date_sub('month', a, b) AS months, date_sub('year', a, b) AS years FROM {pair_sql}")
    add("date_add", "orders", lambda d: pair(d).select("o_orderkey", dates.add("a", days=3, weeks=1, months=1, years=1).alias("d")), f"SELECT o_orderkey, (a + INTERVAL 13 MONTH)::DATE + 10 AS d FROM {pair_sql}")
    add("date_weekday", "orders", lambda d: pair(d).select("o_orderkey", *dates.weekday("b")),
        f"SELECT o_orderkey, isodow(b) AS iso_weekday, isodow(b) >= 6 AS weekend, isoyear(b) AS iso_year, week(b) AS iso_week FROM {pair_sql}")
    add("date_business_days", "orders", lambda d: dates.business_days(pair(d), "a", "b"),
        f"""SELECT o_orderkey, a, b, (SELECT count(*) FROM range(a, b + INTERVAL 1 DAY, INTERVAL 1 DAY) t(x) WHERE isodow(x) < 6 AND NOT (month(x) = 1 AND day(x) = 1) AND NOT (month(x) = 12 AND day(x) = 25)) AS business_days FROM {pair_sql}""")
    add("date_age", "orders", lambda d: pair(d).select("o_orderkey", *dates.age("a", "b")),
        f"SELECT o_orderkey, date_sub('month', a, b) // 12 AS years, date_sub('month', a, b) % 12 AS months, date_diff('day', a, b) AS total_days FROM {pair_sql}")
    add("date_convert_tz", "orders", lambda d: d.select("o_orderkey", F.convert_timezone(F.lit("UTC"), F.lit("Europe/Madrid"), F.col("o_orderdate")).alias("t")),
        "SELECT o_orderkey, timezone('Europe/Madrid', timezone('UTC', o_orderdate)) AS t FROM orders")

    # normal forms
    add("norm_fold", "documents", lambda d: d.select("doc_id", tx.fold(F.col("text")).alias("v")), "SELECT doc_id, lower(strip_accents(text)) AS v FROM documents")
    add("norm_slug", "documents", lambda d: d.select("doc_id", tx.slugify(F.col("text"), 1 << 30).alias("v")),
        "SELECT doc_id, regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS v FROM documents")
    add("norm_email", "customer", lambda d: d.select("c_custkey", tx.normalize_email(F.expr("case c_custkey % 3 when 0 then concat('Ann <A.b+x', c_custkey, '@GoogleMail.com>') when 1 then concat('u+t', c_custkey, '@Ex.org') else 'none' end")).alias("v")),
        "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'ab@gmail.com' WHEN 1 THEN 'u@ex.org' END AS v FROM customer")
    add("norm_phone", "customer", lambda d: d.select("c_custkey", tx.normalize_phone(F.expr("concat(case when c_custkey % 2 = 0 then '0034 ' else '' end, '600-', lpad(cast(c_custkey % 1000000 as string), 6, '0'))")).alias("v")),
        "SELECT c_custkey, '+34600' || lpad((c_custkey % 1000000)::VARCHAR, 6, '0') AS v FROM customer")
    add("norm_domain", "pages", lambda d: d.select("page_id", tx.domain_of(F.col("url")).alias("v")), "SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/:?#]*)', 1)), '^www\\.', '') AS v FROM pages")
