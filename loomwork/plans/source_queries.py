"""Queries that write the tables out, read them back, version them and stream them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers as rd
from ..streaming import jobs
from ..tables import scratch
from .registry import Registry
from .versions import Dataset, linear, replay


def delimited(part: DataFrame) -> DataFrame:
    path = scratch(part.sparkSession, "csv")
    rd.export(part.select("p_partkey", "p_name", "p_size", F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("code")), "csv", path)
    return rd.read_delimited(part.sparkSession, path, text_columns=["code"])


def locale(part: DataFrame) -> DataFrame:
    text = part.select("p_partkey", F.replace(F.format_string("%.2f", "p_retailprice"), F.lit("."), F.lit(",")).alias("price"), F.col("p_brand").alias("brand"))
    return rd.normalise_numbers(text)


def dayfirst(orders: DataFrame) -> DataFrame:
    text = orders.select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("d"))
    return rd.parse_dayfirst(text, ["d"])


def json_flat(orders: DataFrame) -> DataFrame:
    path = scratch(orders.sparkSession, "json")
    rd.export(orders.select("o_orderkey", F.struct("o_custkey", F.struct("o_orderstatus").alias("s")).alias("c")), "json", path)
    return rd.read_json(orders.sparkSession, path, flat=True)


def folder(customer: DataFrame) -> DataFrame:
    spark, path = customer.sparkSession, scratch(customer.sparkSession, "folder")
    a = customer.where("c_custkey % 2 = 0").select("c_custkey", "c_mktsegment")
    b = customer.where("c_custkey % 2 = 1").select("c_mktsegment", "c_nationkey", "c_custkey")
    for i, d in enumerate((a, b)):
        d.write.option("header", True).csv(f"{path}/part={i}")
    out = rd.read_folder(spark, path)
    return out.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_mktsegment", F.col("c_nationkey").cast("int").alias("c_nationkey"))


def records(events: DataFrame) -> DataFrame:
    item = F.struct("event_id", F.struct("event_type", "value").alias("what"), F.array("user_id").alias("users"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    answers = events.groupBy("user_id").agg(F.collect_list(item).alias("items")).select(F.struct(F.col("items").alias("rows")).alias("data"))
    out = rd.read_records(answers, epoch_columns=["at"])
    return out.select("event_id", "what_event_type", F.round("what_value", 4).alias("what_value"), "users", F.col("at").cast("timestamp_ntz").alias("at"))


STEPS = [
    {"op": "filter", "params": {"expr": "o_totalprice > 1000"}},
    {"op": "derive", "params": {"name": "year", "expr": "year(o_orderdate)"}},
    {"op": "group", "params": {"group_by": ["year", "o_orderstatus"], "aggregations": [{"fn": "count", "alias": "n"}]}},
]
GROUPED = "SELECT year(o_orderdate) AS year, o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1, 2"


def dataset(df: DataFrame, name: str) -> Dataset:
    d = Dataset(df.sparkSession, name, scratch(df.sparkSession, "versions"))
    d.ingest(df)
    return d


def undo_redo(orders: DataFrame) -> DataFrame:
    d = dataset(orders, "orders_undo")
    for s in STEPS:
        d.apply(s["op"], s["params"])
    d.move(-2)
    d.apply(*[("derive", {"name": "year", "expr": "year(o_orderdate)"})[i] for i in (0, 1)])
    d.apply(STEPS[2]["op"], STEPS[2]["params"])
    return d.frame()


def preview(orders: DataFrame) -> DataFrame:
    got = dataset(orders, "orders_preview").preview("filter", {"expr": "o_orderstatus = 'F'"})
    return orders.sparkSession.createDataFrame([(len(got["before"]), len(got["after"]), got["rows"])], "before int, after int, rows long")


def refreshed(orders: DataFrame) -> DataFrame:
    """A recipe whose last step no longer applies to the new data keeps what worked."""
    d = dataset(orders, "orders_refresh")
    for s in STEPS:
        d.apply(s["op"], s["params"])
    told = d.refresh(orders.drop("o_orderstatus"))
    return d.frame().agg(F.count("*").alias("rows")).withColumn("applied", F.lit(told["applied"]))


def graph(orders: DataFrame) -> DataFrame:
    nodes = {"s": {"op": "source"}} | {str(i): s for i, s in enumerate(STEPS)}
    return replay(orders, linear(nodes, [("s", "0"), ("0", "1"), ("1", "2")]))


def streamed(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, str]:
    """A table as a file stream, and a folder for the job."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    work = scratch(spark, "stream")
    table.repartitionByRange(4, table.columns[0]).write.parquet(f"{work}/in")
    return jobs.file_stream(spark, f"{work}/in", table.schema), work


def drained(stream: DataFrame, work: str) -> DataFrame:
    """All that a stateful stream gives, as a written table.  States of many kinds need the RocksDB store."""
    spark, key = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = stream.writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    spark.conf.unset(key)
    return spark.read.schema(stream.schema).parquet(f"{work}/out")


def ss_ingest(spark, sf_dir):
    stream, work = streamed(spark, sf_dir, "orders")
    jobs.ingest(stream, STEPS[:2], f"{work}/table", f"{work}/cp").awaitTermination()
    return spark.read.parquet(f"{work}/table").select("o_orderkey", "year")


def ss_quality(spark, sf_dir):
    stream, work = streamed(spark, sf_dir, "orders")
    rules = {"status": {"kind": "accepted_values", "column": "o_orderstatus", "values": ["F", "O"]}, "price": {"kind": "range", "column": "o_totalprice", "min": 1000}}
    jobs.quality_gate(stream, rules, f"{work}/good", f"{work}/bad", f"{work}/results", f"{work}/cp").awaitTermination()
    good, bad = (spark.read.parquet(f"{work}/{x}").select("o_orderkey", F.lit(x).alias("where")) for x in ("good", "bad"))
    return good.unionByName(bad)


def ss_rollup(spark, sf_dir):
    stream, work = streamed(spark, sf_dir, "events")
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    out = drained(jobs.rollup(timed, "ts", "1 hour", {"n": "count(*)", "total": "round(sum(value), 4)"}, ["event_type"], "6 hours"), work)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def ss_sliding(spark, sf_dir):
    stream, work = streamed(spark, sf_dir, "events")
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    out = drained(jobs.rollup(timed, "ts", "1 hour", {"n": "count(*)"}, ["event_type"], "6 hours", "2 hours"), work)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def ss_session(spark, sf_dir):
    stream, work = streamed(spark, sf_dir, "events")
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    out = drained(jobs.rollup(timed, "ts", "1 hour", {"n": "count(*)"}, ["user_id"], session_gap="30 minutes"), work)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "user_id", "n")


def ss_dedupe(spark, sf_dir):
    stream, work = streamed(spark, sf_dir, "events")
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return drained(jobs.dedupe(timed, "ts", ["user_id", "event_type"], "1000 days").select("user_id", "event_type"), work)


def ss_pair(spark, sf_dir):
    """Starts and completes lie in different files, each a micro-batch; a closing event of its own key comes last and moves the watermark past all."""
    events, work = spark.read.parquet(f"{sf_dir}/events.parquet"), scratch(spark, "stream")
    keyed = events.select(F.col("user_id").alias("case"), F.col("event_type").alias("activity"), F.col("ts").cast("timestamp").alias("at"))
    both = F.explode(F.array(F.struct("at", F.lit("start").alias("lifecycle")), F.struct((F.col("at") + F.expr("interval 1 minute")).alias("at"), F.lit("complete").alias("lifecycle"))))
    life = keyed.select("case", "activity", both.alias("e")).select("case", "activity", F.col("e.at").alias("ts"), "e.lifecycle")
    life.repartition(2, "lifecycle", "ts").write.parquet(f"{work}/in")
    closing = life.agg((F.max("ts") + F.expr("interval 2000 days")).alias("ts"))
    closing = closing.select(F.lit(-1).cast(life.schema["case"].dataType).alias("case"), F.lit("").alias("activity"), "ts", F.lit("start").alias("lifecycle"))
    closing.coalesce(1).write.mode("append").parquet(f"{work}/in")
    stream = jobs.file_stream(spark, f"{work}/in", life.schema, files_per_batch=1)
    return drained(jobs.pair(stream, 3_600_000, "1000 days"), work)


def ss_change(spark, sf_dir):
    """Every page is fetched twice, the second time with another first line."""
    stream, work = streamed(spark, sf_dir, "pages")
    later = F.concat(F.lit("Fetched  anew\n"), F.regexp_replace("html", "^[^\n]*\n", ""))
    both = F.explode(F.array(F.struct((2 * F.col("page_id")).alias("ms"), F.col("html").alias("text")), F.struct((2 * F.col("page_id") + 1).alias("ms"), later.alias("text"))))
    fetches = stream.select("url", both.alias("f")).select("url", "f.ms", "f.text", F.lit(False).alias("blocked"))
    return drained(jobs.changes(fetches), work)


CHANGE_SQL = r"""WITH f AS (SELECT url, 2 * page_id AS ms, html AS text FROM pages UNION ALL SELECT url, 2 * page_id + 1, 'Fetched  anew' || chr(10) || regexp_replace(html, '^[^\n]*\n', '') FROM pages),
    l AS (SELECT url, ms, list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(lower(x), '\s+', ' ', 'g'))), lambda x: x <> '')) AS l FROM f),
    p AS (SELECT url, ms, l, lag(l) OVER (PARTITION BY url ORDER BY ms) AS before FROM l)
    SELECT url, ms, unnest(list_filter(l, lambda x: NOT list_contains(before, x))) AS line FROM p WHERE before IS NOT NULL"""
#: Every start has its complete a minute later, so the first in is the first out.
PAIR_SQL = "SELECT user_id AS \"case\", event_type AS activity, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts + INTERVAL 1 MINUTE) // 1000 AS end_ms, 'paired' AS status FROM events"


def register(r: Registry) -> None:
    add = r.add
    add("src_delimited", "part", delimited, "SELECT p_partkey::INT AS p_partkey, p_name, p_size, lpad(p_partkey::VARCHAR, 8, '0') AS code FROM part")
    add("src_locale_numbers", "part", locale, "SELECT p_partkey, round(p_retailprice, 2) AS price, p_brand AS brand FROM part")
    add("src_dayfirst", "orders", dayfirst, "SELECT o_orderkey, o_orderdate::DATE AS d FROM orders")
    add("src_parquet", "lineitem", lambda d: d, "SELECT * FROM lineitem")
    add("src_json", "orders", json_flat, "SELECT o_orderkey, o_custkey AS c_o_custkey, o_orderstatus AS c_s_o_orderstatus FROM orders")
    add("src_folder", "customer", folder, "SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 2 = 1 THEN c_nationkey END AS c_nationkey FROM customer")
    add("src_records", "events", records, "SELECT event_id, event_type AS what_event_type, round(value, 4) AS what_value, '[' || user_id || ']' AS users, date_trunc('second', ts) AS at FROM events")
    def mixed(e):
        number = F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise(F.concat(F.col("event_id").cast("string"), F.lit(".5")))
        value = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise(F.col("event_id").cast("string"))
        made = F.format_string('{"id":%s,"who":{"u":%s},"v":%s,"n":%s%s,"from":%s,"to":%s}', "event_id", "user_id", value, number, F.when(F.col("event_id") % 5 == 0, ',"odd":[1]').otherwise(""), F.lit("86400"), F.col("event_id") * 43200)
        return rd.read_mixed_records(e.select(made.alias("j")), "j", ["to"], {"days": ("from", "to")})

    add("src_records__mixed", "events", mixed,
        """SELECT event_id AS id, user_id AS who_u, CASE WHEN event_id % 3 = 0 THEN event_type ELSE event_id::VARCHAR END AS v, event_id + CASE WHEN event_id % 2 = 0 THEN 0.0 ELSE 0.5 END::DOUBLE AS n, CASE WHEN event_id % 5 = 0 THEN '[1]' END AS odd,
           86400::BIGINT AS "from", round((event_id * 43200 - 86400) / 86400.0, 1) AS days, make_timestamp(event_id * 43200 * 1000000) AS "to" FROM events""")
    add("snk_append_cols", "part", lambda d: rd.write_output(d.select("p_partkey", "p_size"), d.select("p_partkey", (F.col("p_size") * 2).alias("score")), ["p_partkey"]), "SELECT p_partkey, p_size, p_size * 2 AS score FROM part")
    add("snk_handoff", "part", lambda d: rd.handoff(d, ["p_partkey"], ["p_partkey", "p_brand"], "p_size > 10")[0], "SELECT p_partkey, p_brand FROM part WHERE p_size > 10 ORDER BY p_partkey LIMIT 2000")
    add("snk_handoff__print", "part", lambda d: rd.handoff(d, ["p_partkey"], ["p_partkey", "p_brand"])[1],
        """SELECT sha256(string_agg('{"p_partkey":' || p_partkey || ',"p_brand":"' || p_brand || '"}', chr(10) ORDER BY p_partkey)) AS sha256, count(*) AS rows FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 2000)""")
    add("snk_version", "orders", undo_redo, GROUPED)
    add("step_preview", "orders", preview, "SELECT (SELECT count(*) FROM duckdb_columns() WHERE table_name = 'orders')::INT AS before, (SELECT count(*) FROM duckdb_columns() WHERE table_name = 'orders')::INT AS after, -count(*) FILTER (o_orderstatus <> 'F') AS rows FROM orders")
    add("recipe_refresh", "orders", refreshed, "SELECT count(*) FILTER (o_totalprice > 1000) AS rows, 2 AS applied FROM orders")
    add("pipeline_graph", "orders", graph, GROUPED)
    streams = {
        "ss_ingest": (ss_ingest, "SELECT o_orderkey, year(o_orderdate) AS year FROM orders WHERE o_totalprice > 1000"),
        "ss_quality": (ss_quality, "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') AND o_totalprice >= 1000 THEN 'good' ELSE 'bad' END AS \"where\" FROM orders"),
        "ss_rollup": (ss_rollup, "SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2 HAVING start + INTERVAL 6 HOURS <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"),
        "ss_rollup__sliding": (ss_sliding, """WITH w AS (SELECT event_type, ts, time_bucket(INTERVAL 2 HOURS, ts) - INTERVAL 2 HOURS * i AS start FROM events, range(3) r(i))
            SELECT start, event_type, count(*) AS n FROM w GROUP BY 1, 2 HAVING start + INTERVAL 6 HOURS <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""),
        "ss_rollup__session": (ss_session, """WITH l AS (SELECT user_id, ts, (coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTES, true))::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
            s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
            SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k HAVING "end" <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""),
        "ss_dedupe": (ss_dedupe, "SELECT DISTINCT user_id, event_type FROM events"),
        "ss_pair": (ss_pair, PAIR_SQL),
        "ss_change": (ss_change, CHANGE_SQL),
    }
    for name, (fn, sql) in streams.items():
        r.queries[name] = fn
        if sql:
            r.oracle[name] = sql
