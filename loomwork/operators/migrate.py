"""Migration rehearsal: strict casts, one reason per rejected row, and checks of what was loaded."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cast_strict(c: Column, to: str) -> Column:
    """TEXT, REAL, DATE, BOOLEAN or INTEGER (signed digits, or a double without a fraction); else null."""
    s = F.trim(c.cast("string"))
    if to == "INTEGER":
        d = s.try_cast("double")
        return F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("bigint")).when(d == F.floor(d), d.try_cast("bigint"))
    return {"TEXT": c.cast("string"), "REAL": s.try_cast("double"), "DATE": F.substring(s, 1, 10).try_cast("date"), "BOOLEAN": s.try_cast("boolean")}[to]


def load(df: DataFrame, plan: dict[str, tuple[str, str]], row_id: str, required: list[str] = (), primary: list[str] = (), unique: list[list[str]] = (), foreign: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """Target columns, ``row_id`` and ``reason`` (null: accepted).

    Reasons, the first that holds: cast_failure, missing_required, duplicate_primary_key, duplicate_unique_key,
    foreign_key_not_found.  Only accepted rows claim keys, in the order of ``row_id``."""
    cols = {t: cast_strict(F.col(src), kind) for t, (src, kind) in plan.items()}
    bad = [F.col(src).isNotNull() & (F.trim(F.col(src).cast("string")) != "") & cols[t].isNull() for t, (src, _) in plan.items()]
    out = df.select(F.col(row_id), *[c.alias(t) for t, c in cols.items()], F.array_contains(F.array(*bad), True).alias("_cast"))
    lost = F.lit(False)
    for i, (column, (parent, parent_column)) in enumerate((foreign or {}).items()):
        ref = parent.select(F.col(parent_column).alias(f"_p{i}"), F.lit(True).alias(f"_m{i}")).distinct()
        out = out.join(ref, F.col(column) == F.col(f"_p{i}"), "left")
        lost = lost | (F.col(column).isNotNull() & F.col(f"_m{i}").isNull())
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    keep = [row_id, *plan]
    out = out.select(*keep, F.when(F.col("_cast"), "cast_failure").when(missing, "missing_required").alias("_early"), lost.alias("_lost"))
    keys = ([list(primary)] if primary else []) + [list(u) for u in unique]
    free = F.col("_early").isNull() & ~F.col("_lost")
    if len(keys) <= 1:
        if not keys:
            return out.select(*keep, F.coalesce("_early", F.when(F.col("_lost"), "foreign_key_not_found")).alias("reason"))
        label = "duplicate_primary_key" if primary else "duplicate_unique_key"
        first = F.min(F.when(free, F.col(row_id))).over(Window.partitionBy(*keys[0]))
        whole = F.lit(True)
        for k in keys[0]:
            whole = whole & F.col(k).isNotNull()
        taken = whole & (first < F.col(row_id))
        return out.select(*keep, F.coalesce("_early", F.when(taken, label).when(F.col("_lost"), "foreign_key_not_found")).alias("reason"))
    return _rounds(out, keep, row_id, keys, bool(primary))


def _rounds(out: DataFrame, keep: list[str], row_id: str, keys: list[list[str]], has_primary: bool) -> DataFrame:
    """Claims over several keys: accept the rows that are first among the undecided on all their keys, settle those
    that clash with an accepted row, repeat.  Every round is written to the shared folder."""
    spark = out.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    state = out.withColumn("_s", F.when(F.col("_early").isNotNull() | F.col("_lost"), F.lit("out")).otherwise(F.lit("open")))
    while True:
        path = f"{base.rstrip('/')}/claims-{uuid.uuid4().hex}"
        state.write.parquet(path)
        state = spark.read.parquet(path)
        if state.where("_s = 'open'").isEmpty():
            break
        wins, clash = F.lit(True), F.lit(False)
        for k in keys:
            w = Window.partitionBy(*k)
            whole = ~F.array_contains(F.array(*[F.col(c).isNull() for c in k]), True)
            wins = wins & (~whole | (F.min(F.when(F.col("_s") == "open", F.col(row_id))).over(w) == F.col(row_id)))
            held = F.min(F.when(F.col("_s") == "in", F.col(row_id))).over(w)
            clash = clash | (whole & held.isNotNull() & (held < F.col(row_id)))
        step = F.when(F.col("_s") != "open", F.col("_s")).when(clash, "dup").when(wins, "in").otherwise("open")
        state = state.withColumn("_s2", step).drop("_s").withColumnRenamed("_s2", "_s")
    reason = F.lit(None).cast("string")
    for i, k in reversed(list(enumerate(keys))):
        w = Window.partitionBy(*k)
        whole = ~F.array_contains(F.array(*[F.col(c).isNull() for c in k]), True)
        held = F.min(F.when(F.col("_s") == "in", F.col(row_id))).over(w)
        label = "duplicate_primary_key" if i == 0 and has_primary else "duplicate_unique_key"
        reason = F.when(whole & (held < F.col(row_id)), label).otherwise(reason)
    return state.select(*keep, F.coalesce("_early", reason, F.when(F.col("_lost"), "foreign_key_not_found")).alias("reason"))


def load_order(tables: dict[str, list[str]]) -> list[str]:
    """Parents before children; a cycle is refused.  ``tables``: name -> names of its parents."""
    done: list[str] = []
    left = {t: set(p) - {t} for t, p in tables.items()}
    while left:
        ready = sorted(t for t, p in left.items() if p <= set(done))
        if not ready:
            raise ValueError(f"a cycle among {sorted(left)}")
        done += ready
        for t in ready:
            del left[t]
    return done


def column_semantics(df: DataFrame, plan: dict[str, tuple[str, str]]) -> DataFrame:
    """(column, considered, changed, format_only, exact) in one scan."""
    made = []
    for t, (src, kind) in plan.items():
        raw, new = F.col(src).cast("string"), cast_strict(F.col(src), kind).cast("string")
        same, alike = raw == new, (F.trim(raw) == new) | (F.trim(raw).try_cast("double") == new.try_cast("double"))
        made.append(F.struct(F.lit(t).alias("column"), F.count(src).alias("considered"), F.count_if(raw.isNotNull() & ~F.coalesce(same | alike, F.lit(False))).alias("changed"),
                             F.count_if(alike & ~same).alias("format_only"), F.count_if(same).alias("exact")))
    return df.agg(F.array(*made).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def totals(source: DataFrame, target: DataFrame, checks: dict[str, tuple[str, str]], tolerance: float = 0.0) -> DataFrame:
    """(check, source, target, ok): an aggregate expression on both sides."""
    a = source.agg(*[F.expr(x).cast("double").alias(f"s_{n}") for n, (x, _) in checks.items()])
    b = target.agg(*[F.expr(y).cast("double").alias(f"t_{n}") for n, (_, y) in checks.items()])
    rows = [F.struct(F.lit(n).alias("check"), F.round(f"s_{n}", 4).alias("source"), F.round(f"t_{n}", 4).alias("target"), (F.abs(F.col(f"s_{n}") - F.col(f"t_{n}")) <= tolerance).alias("ok")) for n in checks]
    return a.crossJoin(b).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def upsert(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``rows`` replace those of the target with the same key; keys of ``rows`` are unique."""
    return target.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def query_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows and how often each side has them, where that differs (multiset, nulls equal)."""
    cols = source.columns
    a = source.groupBy(*cols).agg(F.count("*").alias("n_source"))
    b = target.toDF(*cols).groupBy(*cols).agg(F.count("*").alias("n_target"))
    both = a.withColumn("n_target", F.lit(0).cast("long")).unionByName(b.withColumn("n_source", F.lit(0).cast("long")))
    return both.groupBy(*cols).agg(F.sum("n_source").alias("n_source"), F.sum("n_target").alias("n_target")).where("n_source <> n_target")


def suggest_table(df: DataFrame) -> DataFrame:
    """(column, kind, required, is_key): the narrowest type that every value fits, in one scan."""
    made = []
    for c in df.columns:
        s = F.col(c).cast("string")
        fits = {k: F.count_if(F.col(c).isNotNull() & cast_strict(F.col(c), k).isNull()) == 0 for k in ("INTEGER", "REAL", "BOOLEAN")}
        date = F.count_if(F.col(c).isNotNull() & ~F.coalesce(s.rlike(r"^\d{4}-\d\d-\d\d"), F.lit(False))) == 0
        kind = F.when(fits["INTEGER"], "INTEGER").when(fits["REAL"], "REAL").when(date, "DATE").when(fits["BOOLEAN"], "BOOLEAN").otherwise("TEXT")
        made.append(F.struct(F.lit(c).alias("column"), kind.alias("kind"), (F.count(c) == F.count("*")).alias("required"),
                             ((F.count(c) == F.count("*")) & (F.countDistinct(c) == F.count("*"))).alias("is_key")))
    return df.agg(F.array(*made).alias("a")).select(F.explode("a").alias("r")).select("r.*")
