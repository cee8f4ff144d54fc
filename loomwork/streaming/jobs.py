"""Streams: ingest with a recipe, quality gates, rollups, duplicates, lifecycle pairing and page changes."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.quality import fails
from ..plans.versions import replay


def file_stream(spark: SparkSession, folder: str, schema, fmt: str = "parquet", glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)


def ingest(stream: DataFrame, recipe: list[dict], table: str, checkpoint: str) -> StreamingQuery:
    """New files through a recipe of row-local steps into a table; stops when all there is has been read.

    A batch that is run again writes the same folder, so each is stored once."""

    def write(batch: DataFrame, number: int) -> None:
        replay(batch, recipe).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def quality_gate(stream: DataFrame, rules: dict[str, dict], good: str, quarantine: str, results: str, checkpoint: str) -> StreamingQuery:
    """Rows that fail a row-local rule go to quarantine with the rules' names; counts per batch are appended."""

    def write(batch: DataFrame, number: int) -> None:
        names = F.filter(F.array(*[F.when(fails(r), F.lit(n)) for n, r in rules.items()]), lambda x: x.isNotNull())
        marked = batch.withColumn("failed_rules", names).persist()
        marked.where(F.size("failed_rules") == 0).drop("failed_rules").write.mode("overwrite").parquet(f"{good}/batch={number}")
        marked.where(F.size("failed_rules") > 0).write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        counts = marked.agg(F.count("*").alias("checked"), F.count_if(F.size("failed_rules") > 0).alias("failed"))
        counts.write.mode("overwrite").parquet(f"{results}/batch={number}")
        marked.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rollup(stream: DataFrame, time: str, watermark: str, metrics: dict[str, str], dimensions: list[str] = (), size: str = "1 hour", slide: str | None = None, session_gap: str | None = None) -> DataFrame:
    """Metrics per tumbling, sliding or session window; rows later than the watermark are dropped."""
    w = F.session_window(time, session_gap) if session_gap else F.window(time, size, slide) if slide else F.window(time, size)
    out = stream.withWatermark(time, watermark).groupBy(w.alias("w"), *dimensions).agg(*[F.expr(x).alias(n) for n, x in metrics.items()])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *dimensions, *metrics)


def dedupe(stream: DataFrame, time: str, keys: list[str], watermark: str) -> DataFrame:
    """One row per key within the watermark."""
    return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark(keys)


#: What an event held in state is: a start, a complete, or a start that has been passed and is open.
START, COMPLETE, OPEN = 0, 1, 2
_HELD = pa.schema([("case", pa.string()), ("activity", pa.string()), ("ms", pa.int64()), ("kind", pa.int8())])


def packed(columns: list) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _HELD) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, _HELD)], schema=_HELD))
    return sink.getvalue().to_pybytes()


def unpacked(blob: bytes) -> Iterator[tuple]:
    return zip(*[c.to_pylist() for c in pa.ipc.open_stream(blob).read_all().columns])


class Pairing(StatefulProcessor):
    """First in, first out pairing of starts and completes of a (case, activity) in event time, whatever order files and micro-batches bring them in.

    Events are held until the watermark has passed them and are then paired by time, starts before completes of the same time.  A start
    that is open for longer than the timeout comes out unmatched.  State is kept by buckets of many pairs of case and activity, each batch's events of a
    bucket as one packed value, so calls to the state don't grow with the keys.  A bucket's timer is its first event held or, if earlier, the
    timeout of its oldest open start.  What a bucket holds is bounded by the watermark's delay and the timeout."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "events binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, blobs = None, []
        for pdf in rows:
            times = pdf["ms"].astype("int64")
            blobs.append((packed([pdf["case"], pdf["activity"], times, (pdf["lifecycle"] != "start").astype("int8")]),))
            first = int(times.min()) if first is None else min(first, int(times.min()))
        if blobs:
            self.held.appendList(blobs)
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        pairs: dict[tuple, list] = {}
        for (blob,) in self.held.get():
            for case, activity, ms, kind in unpacked(bytes(blob)):
                pairs.setdefault((case, activity), []).append((ms, kind))
        out, kept, wakes, changed = [], [], [], False

        def give_up(pair: tuple, waiting: deque, before: int) -> None:
            """Starts whose timeout lies before this time."""
            while waiting and waiting[0] + self.timeout_ms < before:
                out.append((*pair, waiting.popleft(), None, "start without complete"))

        for pair, events in pairs.items():
            waiting = deque(sorted(ms for ms, kind in events if kind == OPEN))
            due = sorted(x for x in events if x[1] != OPEN and x[0] <= now)
            known = len(out)
            for ms, kind in due:
                give_up(pair, waiting, ms)
                if kind == START:
                    waiting.append(ms)
                elif waiting:
                    out.append((*pair, waiting.popleft(), ms, "paired"))
                else:
                    out.append((*pair, None, ms, "complete without start"))
            give_up(pair, waiting, now + 1)
            changed |= bool(due) or len(out) > known
            later = [x for x in events if x[1] != OPEN and x[0] > now]
            kept += [(*pair, *x) for x in later] + [(*pair, ms, OPEN) for ms in waiting]
            wakes += [ms for ms, _ in later] + [ms + self.timeout_ms for ms in list(waiting)[:1]]
        if changed and kept:
            self.held.put([(packed(list(zip(*kept))),)])
        elif changed:
            self.held.clear()
        if wakes:
            self.handle.registerTimer(min(wakes))
        if out:
            yield pd.DataFrame(out, columns=["case", "activity", "start_ms", "end_ms", "status"]).astype({"start_ms": "Int64", "end_ms": "Int64"})

    def close(self) -> None:
        pass


PAIRED = "case string, activity string, start_ms long, end_ms long, status string"


def pair(stream: DataFrame, timeout_ms: int, watermark: str, buckets: int = 1024) -> DataFrame:
    """``stream`` (case, activity, ts, lifecycle) paired by event time once the watermark has passed; rows without a time are left out.
    ``buckets`` is the number of state keys: what one of them holds must fit in a task."""
    rows = stream.where("ts is not null").withWatermark("ts", watermark).withColumn("ms", F.unix_millis("ts"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("case", "activity"), F.lit(buckets))).withColumn("case", F.col("case").cast("string"))
    found = rows.groupBy("bucket").transformWithStateInPandas(Pairing(timeout_ms), PAIRED, "Append", "EventTime")
    return found.withColumn("case", F.col("case").cast("long"))


class Changes(StatefulProcessor):
    """Lines that are new since the last good answer of a key: the first is the baseline, a blocked one changes nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "lines string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        known = json.loads(self.seen.get()[0]) if self.seen.exists() else None
        # the chunks of a key's micro-batch have no order among them; a key is one page, whose fetches are few
        fetched = pd.concat(list(rows))
        for _, r in fetched[~fetched["blocked"].astype(bool)].sort_values(["ms", "text"]).iterrows():
            lines = list(dict.fromkeys(" ".join(x.lower().split()) for x in (r["text"] or "").split("\n") if x.strip()))
            if known is not None:
                before = set(known)
                out += [(key[0], int(r["ms"]), x) for x in lines if x not in before]
            known = lines
        if known is not None:
            self.seen.update((json.dumps(known),))
        yield pd.DataFrame(out, columns=["url", "ms", "line"])

    def close(self) -> None:
        pass


def changes(stream: DataFrame) -> DataFrame:
    """``stream`` (url, ms, text, blocked): (url, ms, line) of the lines that came."""
    return stream.groupBy("url").transformWithStateInPandas(Changes(), "url string, ms long, line string", "Append", "None")
