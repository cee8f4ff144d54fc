"""Process mining over event logs: graphs, variants, times, conformance and arrival patterns.

Nothing but small result tables leaves the executors; per-case work is windows and arrays of one case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import quantiles

BY_CASE = ("end", "row_id")


def seconds(a: str | Column, b: str | Column) -> Column:
    """Seconds from a to b."""
    to = lambda x: F.unix_micros((F.col(x) if isinstance(x, str) else x).cast("timestamp"))
    return (to(b) - to(a)) / 1e6


def steps(log: DataFrame) -> DataFrame:
    """Each event with the next one of its case."""
    w = Window.partitionBy("case").orderBy(*BY_CASE)
    nxt = log.withColumn("next", F.lead("activity").over(w)).withColumn("next2", F.lead("activity", 2).over(w))
    begin = F.lead(F.coalesce("start", "end")).over(w)
    return nxt.withColumn("wait", F.greatest(F.lit(0.0), seconds(F.col("end"), begin)))


def dfg(log: DataFrame, threshold: float = 0.5, min_count: int = 1) -> DataFrame:
    """Directly-follows edges with counts, cases, waits, dependency, length-2 loop and whether they are kept."""
    s = steps(log).where("next is not null")
    q = F.percentile("wait", F.array(F.lit(0.5), F.lit(0.9)))
    edges = s.groupBy(F.col("activity").alias("a"), F.col("next").alias("b")).agg(
        F.count("*").alias("n"), F.countDistinct("case").alias("cases"), F.avg("wait").alias("wait_mean"), q.alias("q"), F.sum("wait").alias("wait_total")
    )
    back = edges.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("n").alias("nb"))
    loops = s.where("activity = next2 and activity <> next").groupBy(F.col("activity").alias("a"), F.col("next").alias("b")).agg(F.count("*").alias("aba"))
    bab = loops.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("aba").alias("bab"))
    out = edges.join(back, ["a", "b"], "left").join(loops, ["a", "b"], "left").join(bab, ["a", "b"], "left").fillna(0, ["nb", "aba", "bab"])
    same = F.col("a") == F.col("b")
    out = out.withColumn("dependency", F.when(same, F.col("n") / (F.col("n") + 1)).otherwise((F.col("n") - F.col("nb")) / (F.col("n") + F.col("nb") + 1)))
    out = out.withColumn("loop2", F.when(same, 0.0).otherwise((F.col("aba") + F.col("bab")) / (F.col("aba") + F.col("bab") + 1)))
    kept = (F.col("n") >= min_count) & ((F.col("dependency") >= threshold) | ((F.col("loop2") >= threshold) & (F.col("nb") > 0)))
    r = lambda c, name: F.round(c, 4).alias(name)
    return out.select("a", "b", "n", "cases", r(F.col("wait_mean"), "wait_mean"), r(F.col("q")[0], "wait_median"), r(F.col("q")[1], "wait_p90"), r(F.col("wait_total"), "wait_total"),
                      r(F.col("dependency"), "dependency"), r(F.col("loop2"), "loop2"), kept.alias("kept"))


def traces(log: DataFrame) -> DataFrame:
    """(case, trace, begin, finish, duration)."""
    item = F.struct(*BY_CASE, "activity")
    cases = log.groupBy("case").agg(F.array_sort(F.collect_list(item)).alias("ev"), F.min(F.coalesce("start", "end")).alias("begin"), F.max("end").alias("finish"))
    return cases.select("case", F.transform("ev", lambda e: e["activity"]).alias("trace"), "begin", "finish", seconds("begin", "finish").alias("duration"))


def variants(log: DataFrame, max_variants: int = 20) -> DataFrame:
    """Most frequent traces with share, cumulative share and throughput."""
    t = traces(log).withColumn("variant", F.array_join("trace", " > "))
    v = t.groupBy("variant").agg(F.count("*").alias("n"), F.avg("duration").alias("m"), F.median("duration").alias("d"), F.min("case").alias("example"))
    total = v.agg(F.sum("n").alias("_t"))
    top = v.orderBy(F.desc("n"), "variant").limit(max_variants)
    w = Window.orderBy(F.desc("n"), "variant")
    share = F.col("n") / F.col("_t")
    return top.crossJoin(F.broadcast(total)).select("variant", "n", F.round(share, 6).alias("share"), F.round(F.sum(share).over(w), 6).alias("cumulative"),
                                                    F.round("m", 4).alias("mean_s"), F.round("d", 4).alias("median_s"), "example")


def activities(log: DataFrame) -> DataFrame:
    """Per activity: events, cases, repeats, durations, waits before it and their share, resources, cost."""
    w = Window.partitionBy("case").orderBy(*BY_CASE)
    wait = F.greatest(F.lit(0.0), seconds(F.lag("end").over(w), F.coalesce("start", "end")))
    e = log.withColumn("wait", wait).withColumn("busy", seconds("start", "end"))
    a = e.groupBy("activity").agg(
        F.count("*").alias("n"), F.countDistinct("case").alias("cases"), F.round(F.avg("busy"), 4).alias("busy_mean"), F.round(F.sum("busy"), 4).alias("busy_total"),
        F.round(F.coalesce(F.sum("wait"), F.lit(0.0)), 4).alias("wait_total"), F.countDistinct("resource").alias("resources"), F.round(F.sum("cost"), 4).alias("cost"),
    )
    whole = a.agg(F.sum("wait_total").alias("_w"))
    out = a.crossJoin(F.broadcast(whole)).withColumn("wait_share", F.round(F.try_divide("wait_total", "_w"), 6)).drop("_w")
    return out.withColumn("repeats", F.col("n") - F.col("cases"))


def bottlenecks(log: DataFrame) -> DataFrame:
    """Activities ranked by the time that cases wait for them, with the average number of cases waiting."""
    span = log.agg(seconds(F.min(F.coalesce("start", "end")), F.max("end")).alias("_s"))
    a = activities(log).crossJoin(F.broadcast(span))
    rank = F.row_number().over(Window.orderBy(F.desc("wait_total"), "activity"))
    return a.select("activity", "wait_total", "wait_share", F.round(F.try_divide("wait_total", "_s"), 6).alias("waiting"), rank.alias("rank"))


def starts_ends(log: DataFrame) -> DataFrame:
    """(kind, activity, n, share) of the first and the last activities of cases."""
    key = F.struct(*BY_CASE)
    c = log.groupBy("case").agg(F.min_by("activity", key).alias("start"), F.max_by("activity", key).alias("end"))
    e = c.select(F.explode(F.array(F.struct(F.lit("start").alias("kind"), F.col("start").alias("activity")), F.struct(F.lit("end").alias("kind"), F.col("end").alias("activity")))).alias("e"))
    n = e.groupBy("e.kind", "e.activity").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("kind")), 6))


def throughput(log: DataFrame) -> DataFrame:
    c = log.groupBy("case").agg(F.min(F.coalesce("start", "end")).alias("b"), F.max("end").alias("f"))
    c = c.withColumn("d", seconds("b", "f"))
    q = F.array(*[F.lit(x).cast("double") for x in quantiles(c, {"d": "d"}, [0.5, 0.9])["d"]])
    out = c.agg(F.count("*").alias("cases"), F.avg("d").alias("m"), F.max("d").alias("x"), seconds(F.min("b"), F.max("f")).alias("s")).withColumn("q", q)
    return out.select("cases", F.round("m", 4).alias("mean_s"), F.round(F.col("q")[0], 4).alias("median_s"), F.round(F.col("q")[1], 4).alias("p90_s"), F.round("x", 4).alias("max_s"),
                      F.round(F.col("cases") / (F.col("s") / 3600), 6).alias("cases_per_hour"))


def rework(log: DataFrame) -> DataFrame:
    """(activity, self_loops, back_and_forth, cases): immediate repeats and a-b-a returns."""
    s = steps(log)
    self_loop, back = F.col("next") == F.col("activity"), (F.col("next2") == F.col("activity")) & (F.col("next") != F.col("activity"))
    again = F.coalesce(self_loop, F.lit(False)) | F.coalesce(back, F.lit(False))
    out = s.groupBy("activity").agg(F.count_if(self_loop).alias("self_loops"), F.count_if(back).alias("back_and_forth"), F.countDistinct(F.when(again, F.col("case"))).alias("cases"))
    return out.where("self_loops + back_and_forth > 0")


def resources(log: DataFrame) -> DataFrame:
    span = log.agg(seconds(F.min(F.coalesce("start", "end")), F.max("end")).alias("_s"))
    r = log.where("resource is not null").groupBy("resource").agg(F.count("*").alias("events"), F.sum(seconds("start", "end")).alias("b"), F.countDistinct("activity").alias("activities"))
    return r.crossJoin(F.broadcast(span)).select("resource", "events", "activities", F.round(F.col("b") / 3600, 4).alias("busy_hours"), F.round(F.try_divide("b", "_s"), 6).alias("utilisation"))


def waiting(log: DataFrame) -> DataFrame:
    """Per activity: time from the latest completion of the case that is not after the start.

    In order of time a running maximum of the completions seen gives it, with completions before starts at one instant."""
    marks = F.array(F.struct(F.col("end").alias("t"), F.lit(0).alias("kind"), F.col("end").alias("done")), F.struct(F.col("start").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("timestamp_ntz").alias("done")))
    m = log.where("start is not null").select("case", "activity", "row_id", F.explode(marks).alias("m"))
    w = Window.partitionBy("case").orderBy("m.t", "m.kind")
    own = m.withColumn("last", F.max("m.done").over(w)).where("m.kind = 1").withColumn("wait", seconds(F.col("last"), F.col("m.t")))
    return own.groupBy("activity").agg(F.count("*").alias("n"), F.round(F.sum("wait"), 4).alias("wait_s"), F.count_if(F.col("last").isNull()).alias("without_predecessor"))


def overlaps(log: DataFrame) -> DataFrame:
    """(case, n): pairs of instances of a case that overlap in time, without building the pairs: of all pairs those
    do not overlap in which one ends no later than the other starts."""
    src = log.where("start is not null and start < end")
    marks = F.array(F.struct(F.col("end").alias("t"), F.lit(0).alias("kind")), F.struct(F.col("start").alias("t"), F.lit(1).alias("kind")))
    m = src.select("case", F.explode(marks).alias("m"))
    w = Window.partitionBy("case").orderBy("m.t", "m.kind")
    before = m.withColumn("ended", F.count_if(F.col("m.kind") == 0).over(w)).where("m.kind = 1")
    apart = before.groupBy("case").agg(F.sum("ended").alias("apart"), F.count("*").alias("k"))
    return apart.select("case", (F.col("k") * (F.col("k") - 1) / 2 - F.col("apart")).cast("long").alias("n")).where("n > 0")


def peak_load(log: DataFrame, by: str) -> DataFrame:
    """(by, peak): most instances at once; a departure at an instant comes before an arrival."""
    marks = F.array(F.struct(F.col("end").alias("t"), F.lit(-1).alias("d")), F.struct(F.col("start").alias("t"), F.lit(1).alias("d")))
    m = log.where("start is not null").select(by, F.explode(marks).alias("m")).groupBy(by, "m.t").agg(F.sum(F.when(F.col("m.d") < 0, -1).otherwise(0)).alias("out"), F.sum(F.when(F.col("m.d") > 0, 1).otherwise(0)).alias("in"))
    w = Window.partitionBy(by).orderBy("t")
    return m.withColumn("load", F.sum(F.col("in") + F.col("out")).over(w)).groupBy(by).agg(F.max("load").alias("peak"))


def coverage(log: DataFrame, threshold: float = 0.5, min_count: int = 1) -> DataFrame:
    """Transitions and cases that the kept edges cover."""
    kept = dfg(log, threshold, min_count).where("kept").select(F.col("a").alias("activity"), F.col("b").alias("next"), F.lit(True).alias("k"))
    s = steps(log).where("next is not null").join(F.broadcast(kept), ["activity", "next"], "left").withColumn("k", F.coalesce("k", F.lit(False)))
    per_case = s.groupBy("case").agg(F.count("*").alias("n"), F.count_if("k").alias("c"), F.bool_and("k").alias("all"))
    return per_case.agg(F.sum("n").alias("transitions"), F.sum("c").alias("covered"), F.count("*").alias("cases"), F.count_if("all").alias("covered_cases"))


def conform_steps(log: DataFrame, reference: list[str]) -> DataFrame:
    """(variant, n, inserted, repeated, skipped, reordered) of each distinct trace against an expected sequence."""
    ref = F.array(*[F.lit(x) for x in reference])
    v = traces(log).groupBy("trace").agg(F.count("*").alias("n"))
    known = F.filter("trace", lambda x: F.array_contains(ref, x))
    first = F.array_distinct(known)
    place = F.transform(first, lambda x: F.array_position(ref, x))
    return v.select(
        F.array_join("trace", " > ").alias("variant"), "n", (F.size("trace") - F.size(known)).alias("inserted"), (F.size(known) - F.size(first)).alias("repeated"),
        F.array_join(F.array_except(ref, "trace"), ",").alias("skipped"), (place != F.array_sort(place)).alias("reordered"),
    )


def slot(*activities: str, optional: tuple[str, ...] = ()) -> list[tuple[str, bool]]:
    """A place in an expected process: one activity, or several that may come in any order; ``optional`` ones may be missing."""
    return [(a, False) for a in activities] + [(a, True) for a in optional]


def slot_deviations(log: DataFrame, slots: list[list[tuple[str, bool]]]) -> DataFrame:
    """(variant, n, inserted, repeated, skipped, reordered, fits) of each distinct trace against slots in order.

    ``inserted`` and ``repeated`` name activities, ``skipped`` those that must be there and are not, ``reordered`` pairs "x before y" of which y belongs
    to an earlier slot, by first occurrences.  The pairs come from one fold along the trace, whose state is what has been seen of each slot."""
    names = [a for members in slots for a, _ in members]
    if len(set(names)) < len(names) or not names:
        raise ValueError("an activity belongs to one slot, and there must be one")
    place = F.create_map(*[x for i, members in enumerate(slots) for a, _ in members for x in (F.lit(a), F.lit(i))])
    known = F.array(*[F.lit(a) for a in names])
    must = F.array(*[F.lit(a) for members in slots for a, free in members if not free]).cast("array<string>")
    v = traces(log).groupBy("trace").agg(F.count("*").alias("n"))
    v = v.withColumns({"_known": F.filter("trace", lambda x: F.array_contains(known, x)), "_other": F.filter("trace", lambda x: ~F.array_contains(known, x))})
    v = v.withColumn("_first", F.array_distinct("_known"))
    start = F.struct(F.array_repeat(F.array().cast("array<string>"), len(slots)).alias("seen"), F.array().cast("array<string>").alias("pairs"))

    def step(state, x):
        at = F.element_at(place, x)
        late = F.flatten(F.slice(state["seen"], at + 2, F.lit(len(slots))))
        pairs = F.concat(state["pairs"], F.transform(late, lambda y: F.concat(y, F.lit(" before "), x)))
        seen = F.transform(state["seen"], lambda s, i: F.when(i == at, F.concat(s, F.array(x))).otherwise(s))
        return F.struct(seen.alias("seen"), pairs.alias("pairs"))

    out = v.select(
        F.array_join("trace", " > ").alias("variant"), "n", F.array_distinct("_other").alias("inserted"),
        F.filter("_first", lambda a: F.size(F.filter("_known", lambda x: x == a)) > 1).alias("repeated"), F.array_except(must, "trace").alias("skipped"),
        F.aggregate("_first", start, step, lambda state: state["pairs"]).alias("reordered"),
    )
    kinds = ("inserted", "repeated", "skipped", "reordered")
    return out.withColumn("fits", sum((F.size(k) for k in kinds), F.lit(0)) == 0)


def slot_summary(deviations: DataFrame) -> DataFrame:
    """(kind, detail, cases) over all cases; kind ``fits`` counts those without any."""
    kinds = ("inserted", "repeated", "skipped", "reordered")

    def named(kind: str):
        return lambda d: F.struct(F.lit(kind).alias("kind"), d.alias("detail"))

    fits = F.filter(F.array(named("fits")(F.lit(""))), lambda _: F.col("fits"))
    each = F.concat(*[F.transform(k, named(k)) for k in kinds], fits)
    return deviations.select("n", F.explode(each).alias("d")).groupBy("d.kind", "d.detail").agg(F.sum("n").alias("cases"))


#: Most activities of a way through the model that a skip may stand for, ends included.
WAY = 8


def _transition_kinds(transitions: list[tuple[str, str]], known: set[str]) -> list[tuple[str, str, str]]:
    """(a, b, kind) of every ordered pair of known activities: allowed; reordered if only the other way round is;
    skipped if a way of up to WAY activities leads from a to b; else unexpected."""
    allowed, reach = set(transitions), {a: {a} for a in known}
    within: dict[str, set[str]] = {a: set() for a in known}
    for _ in range(WAY - 1):
        reach = {a: {y for x in now for p, y in transitions if p == x} for a, now in reach.items()}
        for a, now in reach.items():
            within[a] |= now
    out = []
    for a in sorted(known):
        for b in sorted(known):
            kind = "allowed" if (a, b) in allowed else "reordered" if (b, a) in allowed else "skipped" if b in within[a] and a != b else "unexpected"
            out.append((a, b, kind))
    return out


def conform_transitions(log: DataFrame, transitions: list[tuple[str, str]], start: list[str], end: list[str]) -> DataFrame:
    """(case, inserted, wrong_start, wrong_end, reordered, skipped, unexpected) against allowed transitions.  An activity that the model
    doesn't know is inserted, and its transitions and its place at an end count as nothing else."""
    known = {x for t in transitions for x in t} | {*start, *end}
    kinds = _transition_kinds(transitions, known)
    ref = F.broadcast(log.sparkSession.createDataFrame(kinds, "activity string, next string, kind string"))
    s = steps(log).join(ref, ["activity", "next"], "left")
    c = s.groupBy("case").agg(
        F.min_by("activity", F.struct(*BY_CASE)).alias("a"), F.max_by("activity", F.struct(*BY_CASE)).alias("z"), F.count_if(~F.col("activity").isin(*known)).alias("inserted"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("reordered", "skipped", "unexpected")],
    )
    wrong = lambda col, ends: (F.col(col).isin(*known) & ~F.col(col).isin(*ends)) if ends else F.lit(False)
    return c.select("case", "inserted", wrong("a", start).alias("wrong_start"), wrong("z", end).alias("wrong_end"), "reordered", "skipped", "unexpected")


#: Least expected count of a slot for its test to be relied on.
LEAST_EXPECTED = 5


def season(log: DataFrame) -> DataFrame:
    """(part, slot, exposure, arrivals, rate, expected, chi2): case arrivals by hour of the day and by weekday (0 is Monday), against the
    hours that were observed from the first arrival, which only opens the window, to the last."""
    c = log.groupBy("case").agg(F.min(F.coalesce("start", "end")).cast("timestamp").alias("t"))
    ends = c.agg(F.min("t").alias("a"), F.max("t").alias("z"), F.count("*").alias("n"))
    hours = ends.select("a", "z", F.explode(F.sequence(F.date_trunc("hour", "a"), F.date_trunc("hour", "z"), F.expr("interval 1 hour"))).alias("h"))
    clipped = (F.unix_micros(F.least("z", F.col("h") + F.expr("interval 1 hour"))) - F.unix_micros(F.greatest("a", "h"))) / 3.6e9
    both = lambda t: F.explode(F.array(F.struct(F.lit("hour").alias("part"), F.hour(t).alias("slot")), F.struct(F.lit("weekday").alias("part"), F.weekday(t).alias("slot")))).alias("s")
    exposure = hours.select(both("h"), clipped.alias("e")).groupBy("s.part", "s.slot").agg(F.sum("e").alias("exposure")).where("exposure > 1e-9")
    later = c.join(F.broadcast(ends.select("a")), F.col("t") > F.col("a"))
    same = c.join(F.broadcast(ends.select("a")), F.col("t") == F.col("a")).agg((F.count("*") - 1).alias("k"), F.max("t").alias("t")).where("k > 0")
    n = later.select(both("t"), F.lit(1).alias("k")).unionByName(same.select(both("t"), "k")).groupBy("s.part", "s.slot").agg(F.sum("k").alias("arrivals"))
    table = exposure.join(n, ["part", "slot"], "left").fillna(0, ["arrivals"])
    w = Window.partitionBy("part")  # 31 rows
    e = F.sum("arrivals").over(w) * F.col("exposure") / F.sum("exposure").over(w)
    table = table.withColumn("expected", e)
    return table.select("part", "slot", "exposure", "arrivals", (F.col("arrivals") / F.col("exposure")).alias("rate"), "expected", ((F.col("arrivals") - F.col("expected")) ** 2 / F.col("expected")).alias("chi2"))


def season_tests(log: DataFrame) -> DataFrame:
    """(part, statistic, df, p, min_expected, reliable) of even arrivals over the hours of the day and over the weekdays."""
    from ..functions import tails

    one = season(log).groupBy("part").agg(F.sum("chi2").alias("statistic"), (F.count("*") - 1).alias("df"), F.min("expected").alias("m")).collect()  # two rows
    rows = [(r.part, r.statistic, r.df, tails.chi2_tail(r.statistic, r.df) if r.df else None, r.m, r.m >= LEAST_EXPECTED) for r in one]
    return log.sparkSession.createDataFrame(rows, "part string, statistic double, df long, p double, min_expected double, reliable boolean")


def routing(log: DataFrame) -> DataFrame:
    """(activity, next, n, share): where cases go next; null is the end."""
    s = steps(log).groupBy("activity", "next").agg(F.count("*").alias("n"))
    return s.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("activity")), 6))


def arrivals(log: DataFrame) -> DataFrame:
    """(n, mean_gap, cv) of the gaps between case arrivals: the mean is the span over the gaps, the
    variation comes from per-day chains so that no window spans the whole log."""
    c = log.groupBy("case").agg(F.min(F.coalesce("start", "end")).alias("t")).withColumn("day", F.to_date("t"))
    w = Window.partitionBy("day").orderBy("t", "case")
    gaps = c.withColumn("g", seconds(F.lag("t").over(w), F.col("t")))
    edge = c.groupBy("day").agg(F.min("t").alias("a"), F.max("t").alias("z"))
    over = edge.withColumn("g", seconds(F.lag("z").over(Window.orderBy("day")), F.col("a"))).select("g")
    g = gaps.select("g").union(over).where("g is not null")
    return g.agg(F.count("*").alias("n"), F.round(F.avg("g"), 4).alias("mean_gap"), F.round(F.stddev_samp("g") / F.avg("g"), 6).alias("cv"))


def activity_parameters(log: DataFrame) -> DataFrame:
    """(activity, visits, basis, samples, mean_hours, sd_hours, servers, servers_basis) of each activity, for a queue model.

    Where every instance has a start, durations are service times and there are as many servers as resources, or, without resources, as instances at the
    same time at most; else the time since the case's event before stands in, waiting included, and servers are not told."""
    w = Window.partitionBy("case").orderBy(*BY_CASE)
    hours = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(0.0), c / 3600))
    rows = log.withColumns({"_busy": hours(seconds("start", "end")), "_since": hours(seconds(F.lag("end").over(w), F.col("end")))})
    per = rows.groupBy("activity").agg(
        F.count("*").alias("visits"), (F.count("start") == F.count("*")).alias("_all"), F.countDistinct("resource").alias("_res"),
        *[f(c).alias(n + c) for c in ("_busy", "_since") for n, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_samp))],
    )
    pick = lambda n: F.when(F.col("_all"), F.col(n + "_busy")).otherwise(F.col(n + "_since"))
    # instances under way: starts count up, ends down; the sweep runs per activity and day, with what the days before leave open
    turns = log.where("start is not null").select("activity", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("x"))
    turns = turns.select("activity", F.to_date("x.at").alias("day"), "x.at", "x.d").groupBy("activity", "day", "at").agg(F.sum("d").alias("d"))
    days = turns.groupBy("activity", "day").agg(F.sum("d").alias("net"))
    before = Window.partitionBy("activity").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("activity", "day", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("open"))
    sweep = turns.withColumn("level", F.sum("d").over(Window.partitionBy("activity", "day").orderBy("at")))
    peak = sweep.join(days, ["activity", "day"]).groupBy("activity").agg(F.max(F.col("level") + F.col("open")).alias("_peak"))
    out = per.join(peak, "activity", "left")
    servers = F.when(F.col("_all"), F.when(F.col("_res") > 0, F.col("_res")).otherwise(F.greatest(F.lit(1), F.coalesce("_peak", F.lit(1)))))
    basis = F.when(F.col("_all"), F.when(F.col("_res") > 0, "resources").otherwise("concurrency"))
    return out.select(
        "activity", "visits", F.when(F.col("_all"), "service").otherwise("elapsed").alias("basis"), pick("n").alias("samples"), F.round(pick("m"), 6).alias("mean_hours"),
        F.round(pick("s"), 6).alias("sd_hours"), servers.cast("long").alias("servers"), basis.alias("servers_basis"),
    )
