"""Queries over event logs: case = user, activity = event type; intervals from orders and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import eventlog as el
from ..operators import process as pm
from .registry import Registry


def log(events):
    """Completions only; the resource is a fifth of the users, the cost the value."""
    return events.select(
        F.col("user_id").alias("case"), F.col("event_type").alias("activity"), F.col("ts").alias("end"), F.lit(None).cast("timestamp_ntz").alias("start"),
        F.concat(F.lit("r"), (F.col("event_id") % 5).cast("string")).alias("resource"), F.col("value").alias("cost"), F.col("event_id").alias("row_id"),
    )


def intervals(events):
    """With a start up to 99 minutes before the end."""
    return log(events).withColumn("start", F.expr("end - make_dt_interval(0, 0, cast(row_id % 100 as int))"))


L = """l AS (SELECT user_id AS "case", event_type AS activity, ts AS "end", NULL::TIMESTAMP AS start, 'r' || event_id % 5 AS resource, value AS cost, event_id AS row_id FROM events)"""
I = """l AS (SELECT user_id AS "case", event_type AS activity, ts AS "end", ts - to_minutes(CAST(event_id % 100 AS INTEGER)) AS start, 'r' || event_id % 5 AS resource, value AS cost, event_id AS row_id FROM events)"""
SEC = lambda a, b: f"(epoch_us({b}) - epoch_us({a})) / 1e6"
OVER = 'OVER (PARTITION BY "case" ORDER BY "end", row_id)'
S = f"""s AS (SELECT *, lead(activity) {OVER} AS nxt, lead(activity, 2) {OVER} AS nxt2, greatest(0, {SEC('"end"', f'lead(coalesce(start, "end")) {OVER}')}) AS wait FROM l)"""
DFG = f"""e AS (SELECT activity AS a, nxt AS b, count(*) AS n, count(DISTINCT "case") AS cases, avg(wait) AS m, quantile_cont(wait, 0.5) AS q5, quantile_cont(wait, 0.9) AS q9, sum(wait) AS t FROM s WHERE nxt IS NOT NULL GROUP BY 1, 2),
  p AS (SELECT activity AS a, nxt AS b, count(*) AS aba FROM s WHERE activity = nxt2 AND activity <> nxt GROUP BY 1, 2),
  g AS (SELECT e.a, e.b, e.n, e.cases, round(e.m, 4) AS wait_mean, round(e.q5, 4) AS wait_median, round(e.q9, 4) AS wait_p90, round(e.t, 4) AS wait_total, coalesce(r.n, 0) AS nb, coalesce(p1.aba, 0) + coalesce(p2.aba, 0) AS k
        FROM e LEFT JOIN e r ON e.a = r.b AND e.b = r.a LEFT JOIN p p1 ON e.a = p1.a AND e.b = p1.b LEFT JOIN p p2 ON e.a = p2.b AND e.b = p2.a),
  h AS (SELECT * EXCLUDE (nb, k), nb, CASE WHEN a = b THEN n / (n + 1)::DOUBLE ELSE (n - nb) / (n + nb + 1)::DOUBLE END AS dep, CASE WHEN a = b THEN 0 ELSE k / (k + 1)::DOUBLE END AS lp FROM g),
  dfg AS (SELECT a, b, n, cases, wait_mean, wait_median, wait_p90, wait_total, round(dep, 4) AS dependency, round(lp, 4) AS loop2, n >= 2 AND (dep >= 0.02 OR (lp >= 0.02 AND nb > 0)) AS kept FROM h)"""
T = f"""t AS (SELECT "case", string_agg(activity, ' > ' ORDER BY "end", row_id) AS variant, list(activity ORDER BY "end", row_id) AS trace, {SEC('min(coalesce(start, "end"))', 'max("end")')} AS d FROM l GROUP BY 1)"""
REF = ["view", "click", "purchase"]


def lifecycle(events):
    """Each event as a start and, unless its id is a multiple of 7, a complete later on."""
    base = events.select(F.col("user_id").alias("case"), F.col("event_type").alias("activity"), "ts", "event_id")
    start = base.select("case", "activity", "ts", F.lit("start").alias("lifecycle"), F.lit("x").alias("resource"), (F.col("event_id") * 2).alias("row_id"))
    done = base.where("event_id % 7 > 0").select("case", "activity", F.expr("ts + interval 1 hour").alias("ts"), F.lit("complete").alias("lifecycle"), F.lit("x").alias("resource"), (F.col("event_id") * 2 + 1).alias("row_id"))
    return start.unionByName(done)


RAW = "SELECT user_id AS `case`, event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN concat(date_format(ts, 'yyyy-MM-dd'), 'T', date_format(ts, 'HH:mm:ss'), '+02:00') WHEN 2 THEN date_format(ts, 'dd/MM/yyyy HH:mm') WHEN 3 THEN 'soon' ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') END AS raw FROM {t}"


def raw(events):
    return events.sparkSession.sql(RAW, t=events)


#: View and (if at all) click in any order, then purchase.
SLOTS = [pm.slot("view", optional=("click",)), pm.slot("purchase")]


def register(r: Registry) -> None:
    add = r.add
    add("el_parse", "events", lambda e: raw(e).select("event_id", el.parse_timestamp(F.col("raw"), "Europe/Madrid").alias("p")).select("event_id", F.col("p.ts").cast("timestamp_ntz").alias("ts"), "p.problem"),
        """SELECT event_id, CASE event_id % 5 WHEN 1 THEN date_trunc('second', ts) - INTERVAL 2 HOUR WHEN 2 THEN timezone('UTC', timezone('Europe/Madrid', date_trunc('minute', ts))) WHEN 4 THEN timezone('UTC', timezone('Europe/Madrid', date_trunc('second', ts))) END AS ts,
           CASE event_id % 5 WHEN 0 THEN 'missing' WHEN 3 THEN 'unparseable' END AS problem FROM events""")
    add("el_exclude", "events", lambda e: el.exclusions(intervals(e).withColumn("case", F.expr("if(row_id % 50 = 0, null, `case`)")).withColumn("activity", F.expr("if(row_id % 51 = 1, ' ', activity)")).withColumn("end", F.expr("if(row_id % 53 = 2, null, `end`)"))).groupBy("reason").agg(F.count("*").alias("n")),
        "SELECT CASE WHEN event_id % 50 = 0 THEN 'missing_case' WHEN event_id % 51 = 1 THEN 'missing_activity' WHEN event_id % 53 = 2 THEN 'invalid_timestamp' END AS reason, count(*) AS n FROM events GROUP BY 1")
    add("el_dedupe", "events", lambda e: el.dedupe(log(e).withColumn("end", F.date_trunc("day", "end")), ["case", "activity", "end"]).select("row_id"),
        "SELECT min(event_id) AS row_id FROM events GROUP BY user_id, event_type, date_trunc('day', ts)")
    add("el_pair", "events", lambda e: el.pair(lifecycle(e)).select("case", "activity", "start", "end", "matched"),
        """WITH RECURSIVE x AS (SELECT user_id AS c, event_type AS a, ts, 1 AS d, event_id * 2 AS rid FROM events UNION ALL SELECT user_id, event_type, ts + INTERVAL 1 HOUR, -1, event_id * 2 + 1 FROM events WHERE event_id % 7 > 0),
           o AS (SELECT *, count(*) FILTER (d = 1) OVER w AS ns, count(*) FILTER (d = -1) OVER w AS nc, row_number() OVER w AS i FROM x WINDOW w AS (PARTITION BY c, a ORDER BY ts, rid)),
           k AS (SELECT c, a, ts, ns AS j FROM o WHERE d = 1),
           q AS (SELECT *, greatest(0, max(nc - ns) OVER (PARTITION BY c, a ORDER BY i)) AS lost FROM o),
           f AS (SELECT c, a, ts, CASE WHEN lost > coalesce(lag(lost) OVER (PARTITION BY c, a ORDER BY i), 0) THEN NULL ELSE nc - lost END AS j, d FROM q),
           done AS (SELECT c, a, ts, j FROM f WHERE d = -1)
           SELECT coalesce(k.c, done.c) AS "case", coalesce(k.a, done.a) AS activity, k.ts AS start, done.ts AS "end", k.ts IS NOT NULL AND done.ts IS NOT NULL AS matched FROM k FULL JOIN done ON k.c = done.c AND k.a = done.a AND k.j = done.j""")
    add("el_order", "events", lambda e: el.ordered(log(e).withColumn("end", F.date_trunc("hour", "end"))).select("row_id", "pos", "tied"),
        "SELECT event_id AS row_id, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('hour', ts), event_id) AS pos, count(*) OVER (PARTITION BY user_id, date_trunc('hour', ts)) > 1 AS tied FROM events")
    add("el_status", "events", lambda e: el.status(log(e), ["purchase"]), f"""WITH {L} SELECT "case", last(activity ORDER BY "end", row_id) AS last_activity, last(activity ORDER BY "end", row_id) = 'purchase' AS closed FROM l GROUP BY 1""")
    add("el_missing", "events", lambda e: el.missing(log(e), ["purchase"], REF),
        f"""WITH {L}, c AS (SELECT "case" FROM l GROUP BY 1 HAVING last(activity ORDER BY "end", row_id) = 'purchase') SELECT "case", activity FROM c, (SELECT unnest({REF}) AS activity) x WHERE NOT EXISTS (SELECT 1 FROM l WHERE l."case" = c."case" AND l.activity = x.activity)""")
    add("el_zones", "events", lambda e: el.zones(raw(e).withColumn("raw", F.when(F.col("event_id") % 5 == 4, F.concat("raw", F.lit("-03:00"))).otherwise(F.col("raw"))), "raw").select("case", F.size("offsets").alias("n")),
        "SELECT user_id AS \"case\", 2 AS n FROM events GROUP BY 1 HAVING count(DISTINCT CASE WHEN event_id % 5 IN (1, 4) THEN event_id % 5 END) = 2")
    add("pm_dfg", "events", lambda e: pm.dfg(intervals(e), 0.02, 2), f"WITH {I}, {S}, {DFG} SELECT * FROM dfg")
    add("pm_variants", "events", lambda e: pm.variants(intervals(e)),
        f"""WITH {I}, {T}, v AS (SELECT variant, count(*) AS n, avg(d) AS m, median(d) AS q, min("case") AS example FROM t GROUP BY 1), x AS (SELECT * FROM v ORDER BY n DESC, variant LIMIT 20)
            SELECT variant, n, round(n / (SELECT sum(n) FROM v), 6) AS share, round(sum(n) OVER (ORDER BY n DESC, variant) / (SELECT sum(n) FROM v), 6) AS cumulative, round(m, 4) AS mean_s, round(q, 4) AS median_s, example FROM x""")
    act = f"""w AS (SELECT *, greatest(0, {SEC(f'lag("end") {OVER}', 'coalesce(start, "end")')}) AS wt, {SEC('start', '"end"')} AS busy FROM l),
        a AS (SELECT activity, count(*) AS n, count(DISTINCT "case") AS cases, round(avg(busy), 4) AS busy_mean, round(sum(busy), 4) AS busy_total, round(coalesce(sum(CASE WHEN wt IS NOT NULL THEN wt END), 0), 4) AS wait_total, count(DISTINCT resource) AS resources, round(sum(cost), 4) AS cost FROM w GROUP BY 1)"""
    add("pm_activity", "events", lambda e: pm.activities(intervals(e)), f"WITH {I}, {act} SELECT *, round(wait_total / (SELECT sum(wait_total) FROM a), 6) AS wait_share, n - cases AS repeats FROM a")
    add("pm_bottleneck", "events", lambda e: pm.bottlenecks(intervals(e)),
        f"""WITH {I}, {act} SELECT activity, wait_total, round(wait_total / (SELECT sum(wait_total) FROM a), 6) AS wait_share, round(wait_total / (SELECT {SEC('min(start)', 'max("end")')} FROM l), 6) AS waiting, row_number() OVER (ORDER BY wait_total DESC, activity) AS rank FROM a""")
    add("pm_start_end", "events", lambda e: pm.starts_ends(log(e)),
        f"""WITH {L}, c AS (SELECT first(activity ORDER BY "end", row_id) AS s, last(activity ORDER BY "end", row_id) AS z FROM l GROUP BY "case"), k AS (SELECT 'start' AS kind, s AS activity FROM c UNION ALL SELECT 'end', z FROM c)
            SELECT kind, activity, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY kind), 6) AS share FROM k GROUP BY 1, 2""")
    add("pm_throughput", "events", lambda e: pm.throughput(intervals(e)),
        f"""WITH {I}, {T} SELECT count(*) AS cases, round(avg(d), 4) AS mean_s, round(median(d), 4) AS median_s, round(quantile_cont(d, 0.9), 4) AS p90_s, round(max(d), 4) AS max_s, round(count(*) / ((SELECT {SEC('min(start)', 'max("end")')} FROM l) / 3600), 6) AS cases_per_hour FROM t""")
    add("pm_rework", "events", lambda e: pm.rework(log(e)),
        f"""WITH {L}, {S} SELECT activity, count(*) FILTER (nxt = activity) AS self_loops, count(*) FILTER (nxt2 = activity AND nxt <> activity) AS back_and_forth, count(DISTINCT "case") FILTER (nxt = activity OR (nxt2 = activity AND nxt <> activity)) AS cases FROM s GROUP BY 1 HAVING self_loops + back_and_forth > 0""")
    add("pm_resource", "events", lambda e: pm.resources(intervals(e)),
        f"""WITH {I} SELECT resource, count(*) AS events, count(DISTINCT activity) AS activities, round(sum({SEC('start', '"end"')}) / 3600, 4) AS busy_hours, round(sum({SEC('start', '"end"')}) / (SELECT {SEC('min(start)', 'max("end")')} FROM l), 6) AS utilisation FROM l GROUP BY 1""")
    add("pm_waiting", "events", lambda e: pm.waiting(intervals(e)),
        f"""WITH {I}, x AS (SELECT e.activity, e.start, (SELECT max(o."end") FROM l o WHERE o."case" = e."case" AND o."end" <= e.start) AS last FROM l e) SELECT activity, count(*) AS n, round(sum({SEC('last', 'start')}), 4) AS wait_s, count(*) FILTER (last IS NULL) AS without_predecessor FROM x GROUP BY 1""")
    add("pm_overlap", "events", lambda e: pm.overlaps(intervals(e)),
        f"""WITH {I} SELECT a."case" AS "case", count(*) AS n FROM l a JOIN l b ON a."case" = b."case" AND a.row_id < b.row_id AND a.start < b."end" AND b.start < a."end" AND a.start < a."end" AND b.start < b."end" GROUP BY 1""")
    add("pm_peak_load", "events", lambda e: pm.peak_load(intervals(e), "activity"),
        f"""WITH {I}, m AS (SELECT activity, start AS t, 1 AS d FROM l UNION ALL SELECT activity, "end", -1 FROM l), k AS (SELECT activity, t, sum(d) AS d FROM m GROUP BY 1, 2), z AS (SELECT activity, sum(d) OVER (PARTITION BY activity ORDER BY t) AS load FROM k) SELECT activity, CAST(max(load) AS BIGINT) AS peak FROM z GROUP BY 1""")
    add("pm_coverage", "events", lambda e: pm.coverage(intervals(e), 0.02, 2),
        f"""WITH {I}, {S}, {DFG}, x AS (SELECT s."case", coalesce(dfg.kept, false) AS k FROM s LEFT JOIN dfg ON s.activity = a AND s.nxt = b WHERE nxt IS NOT NULL), c AS (SELECT "case", count(*) AS n, count(*) FILTER (k) AS c, bool_and(k) AS al FROM x GROUP BY 1)
            SELECT CAST(sum(n) AS BIGINT) AS transitions, CAST(sum(c) AS BIGINT) AS covered, count(*) AS cases, count(*) FILTER (al) AS covered_cases FROM c""")
    add("pm_conform_steps", "events", lambda e: pm.conform_steps(log(e), REF),
        f"""WITH {L}, {T}, v AS (SELECT trace, variant, count(*) AS n FROM t GROUP BY 1, 2), k AS (SELECT *, list_filter(trace, lambda x: x IN {tuple(REF)}) AS known FROM v),
            f AS (SELECT *, list_distinct(known) AS u, list_filter({REF}, lambda x: NOT list_contains(trace, x)) AS sk, list_transform(list_sort(list_transform(list_distinct(known), lambda x: list_position(known, x))), lambda p: list_position({REF}, known[p])) AS place FROM k)
            SELECT variant, n, len(trace) - len(known) AS inserted, len(known) - len(u) AS repeated, array_to_string(sk, ',') AS skipped, place <> list_sort(place) AS reordered FROM f""")
    add("pm_conform_steps__slots", "events", lambda e: pm.slot_summary(pm.slot_deviations(log(e), SLOTS)),
        f"""WITH {L}, {T}, v AS (SELECT trace, count(*) AS n FROM t GROUP BY 1), k AS (SELECT *, row_number() OVER () AS i, list_filter(trace, lambda x: x IN ('view', 'click', 'purchase')) AS known FROM v),
            u AS (SELECT i, n, x, min(p) AS p, count(*) AS c FROM (SELECT i, n, unnest(known) AS x, generate_subscripts(known, 1) AS p FROM k) GROUP BY 1, 2, 3),
            s AS (SELECT *, CASE x WHEN 'purchase' THEN 1 ELSE 0 END AS slot FROM u),
            d AS (SELECT i, n, 'inserted' AS kind, unnest(list_distinct(list_filter(trace, lambda x: x NOT IN ('view', 'click', 'purchase')))) AS detail FROM k
                UNION ALL SELECT i, n, 'repeated', x FROM u WHERE c > 1 UNION ALL SELECT i, n, 'skipped', m FROM k, (SELECT unnest(['view', 'purchase']) AS m) WHERE NOT list_contains(trace, m)
                UNION ALL SELECT a.i, a.n, 'reordered', a.x || ' before ' || b.x FROM s a JOIN s b USING (i) WHERE a.p < b.p AND b.slot < a.slot)
            SELECT kind, detail, CAST(sum(n) AS BIGINT) AS cases FROM d GROUP BY 1, 2 UNION ALL SELECT 'fits', '', CAST(sum(n) AS BIGINT) FROM k WHERE i NOT IN (SELECT i FROM d) HAVING count(*) > 0""")
    add("pm_conform_transitions", "events", lambda e: pm.conform_transitions(log(e), [("view", "click"), ("click", "purchase"), ("view", "view")], ["view"], ["purchase"]),
        f"""WITH {L}, {S}, k AS (SELECT *, CASE WHEN (activity, nxt) IN (('view', 'click'), ('click', 'purchase'), ('view', 'view')) THEN 'a' WHEN (activity, nxt) IN (('click', 'view'), ('purchase', 'click')) THEN 'r'
                WHEN (activity, nxt) = ('view', 'purchase') THEN 's' WHEN activity IN ('view', 'click', 'purchase') AND nxt IN ('view', 'click', 'purchase') THEN 'u' END AS kind FROM s),
                c AS (SELECT "case", first(activity ORDER BY "end", row_id) AS a, last(activity ORDER BY "end", row_id) AS z, count(*) FILTER (activity NOT IN ('view', 'click', 'purchase')) AS inserted,
                    count(*) FILTER (kind = 'r') AS reordered, count(*) FILTER (kind = 's') AS skipped, count(*) FILTER (kind = 'u') AS unexpected FROM k GROUP BY 1)
            SELECT "case", inserted, a IN ('click', 'purchase') AS wrong_start, z IN ('view', 'click') AS wrong_end, reordered, skipped, unexpected FROM c""")
    season_sql = f"""WITH {L}, c AS (SELECT min("end") AS t FROM l GROUP BY "case"), w AS (SELECT min(t) AS a, max(t) AS z FROM c), h AS (SELECT a, z, unnest(generate_series(date_trunc('hour', a), date_trunc('hour', z), INTERVAL 1 HOUR)) AS h FROM w),
            q AS (SELECT h, (epoch_us(least(z, h + INTERVAL 1 HOUR)) - epoch_us(greatest(a, h))) / 3.6e9 AS e FROM h), o AS (SELECT t, row_number() OVER (ORDER BY t) AS r FROM c),
            x AS (SELECT 'hour' AS part, hour(h)::INT AS slot, e FROM q UNION ALL SELECT 'weekday', (isodow(h) - 1)::INT, e FROM q), xs AS (SELECT part, slot, sum(e) AS exposure FROM x GROUP BY 1, 2 HAVING sum(e) > 1e-9),
            n AS (SELECT 'hour' AS part, hour(t)::INT AS slot FROM o WHERE r > 1 UNION ALL SELECT 'weekday', (isodow(t) - 1)::INT FROM o WHERE r > 1), ns AS (SELECT part, slot, count(*) AS arrivals FROM n GROUP BY 1, 2),
            b AS (SELECT part, slot, exposure, coalesce(arrivals, 0) AS arrivals FROM xs LEFT JOIN ns USING (part, slot)), g AS (SELECT *, sum(arrivals) OVER (PARTITION BY part) * exposure / sum(exposure) OVER (PARTITION BY part) AS ex FROM b)"""
    six = lambda d: d.withColumns({c: F.round(c, 6) for c, t in d.dtypes if t == "double"})
    add("pm_season", "events", lambda e: six(pm.season(log(e))),
        f"{season_sql} SELECT part, slot, round(exposure, 6) AS exposure, arrivals::BIGINT AS arrivals, round(arrivals / exposure, 6) AS rate, round(ex, 6) AS expected, round((arrivals - ex) ** 2 / ex, 6) AS chi2 FROM g")
    add("pm_season__tests", "events", lambda e: six(pm.season_tests(log(e)).drop("p")),
        f"{season_sql} SELECT part, round(sum((arrivals - ex) ** 2 / ex), 6) AS statistic, count(*) - 1 AS df, round(min(ex), 6) AS min_expected, min(ex) >= 5 AS reliable FROM g GROUP BY part")
    add("pm_params__routing", "events", lambda e: pm.routing(log(e)), f"WITH {L}, {S} SELECT activity, nxt AS next, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY activity), 6) AS share FROM s GROUP BY 1, 2")
    add("pm_params__service", "events", lambda e: pm.activity_parameters(intervals(e)),
        f"""WITH {I} SELECT activity, count(*) AS visits, 'service' AS basis, count(*) AS samples, round(avg(greatest(0, {SEC('start', '"end"')} / 3600)), 6) AS mean_hours, round(stddev_samp(greatest(0, {SEC('start', '"end"')} / 3600)), 6) AS sd_hours,
            count(DISTINCT resource) AS servers, 'resources' AS servers_basis FROM l GROUP BY 1""")
    add("pm_params__concurrency", "events", lambda e: pm.activity_parameters(intervals(e).withColumn("resource", F.lit(None).cast("string"))).select("activity", "servers", "servers_basis"),
        f"""WITH {I}, t AS (SELECT activity, tm, sum(d) AS d FROM (SELECT activity, start AS tm, 1 AS d FROM l UNION ALL SELECT activity, "end", -1 FROM l) GROUP BY 1, 2), r AS (SELECT activity, sum(d) OVER (PARTITION BY activity ORDER BY tm) AS level FROM t)
            SELECT activity, CAST(max(level) AS BIGINT) AS servers, 'concurrency' AS servers_basis FROM r GROUP BY 1""")
    add("pm_params__elapsed", "events", lambda e: pm.activity_parameters(log(e)),
        f"""WITH {L}, s AS (SELECT activity, greatest(0, {SEC(f'lag("end") {OVER}', '"end"')} / 3600) AS g, lag("end") {OVER} IS NOT NULL AS has FROM l)
            SELECT activity, count(*) AS visits, 'elapsed' AS basis, count(*) FILTER (has) AS samples, round(avg(g) FILTER (has), 6) AS mean_hours, round(stddev_samp(g) FILTER (has), 6) AS sd_hours, NULL::BIGINT AS servers, NULL::VARCHAR AS servers_basis FROM s GROUP BY 1""")
    add("pm_params__arrivals", "events", lambda e: pm.arrivals(log(e)),
        f"""WITH {L}, c AS (SELECT min("end") AS t FROM l GROUP BY "case"), g AS (SELECT {SEC('lag(t) OVER (ORDER BY t)', 't')} AS g FROM c) SELECT count(g) AS n, round(avg(g), 4) AS mean_gap, round(stddev_samp(g) / avg(g), 6) AS cv FROM g""")
    add("pm_split", "events", lambda e: el.split_cases(log(e)),
        f"""WITH {L}, c AS (SELECT "case", min("end") AS start FROM l GROUP BY 1) SELECT "case", start, CASE WHEN epoch_us(start) >= (SELECT quantile_cont(epoch_us(start)::DOUBLE, 0.7) FROM c) THEN 'holdout' ELSE 'train' END AS part FROM c""")
