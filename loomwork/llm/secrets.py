"""Secret scans: fixed patterns, and a character convolutional network over every candidate.

``base_spans`` finds the three fixed kinds.  The candidates are the values of the fixed findings and every other run of 16 or more
key characters; the network reads each of them with CONTEXT characters on either side, in windows
of WINDOW characters so that long candidates are read whole, and the best window counts.  Windows are scored BLOCK at a time.

Network (numpy): one-hot characters, one convolution of WIDTH characters with FILTERS filters, ReLU,
maximum over places, logistic output.  Training (on Spark, all candidates of all rows): values of findings are the positives, all
other candidates the negatives; a third of the candidates, by a hash of the candidate and its context, is kept aside.  Equal windows of the other two
thirds are one with their number as weight.  They are dealt into shards of about SHARD_ROWS windows by a hash; every epoch each
shard goes on from the common network and the networks of all shards are averaged, weighted by their windows (in whole numbers, so the order
in which tasks end changes nothing).  The third kept aside calibrates the output (Platt) and sets the threshold: at most the one that
finds RECALL of the findings kept aside, and lower, down to 0.5, as long as no more than one in a thousand of the other candidates kept aside passes.
Candidates at or above it are added as kind ``net``; fixed findings always stay, and whether the network would have
found them is counted.

Edge cases: null and empty texts have no spans; texts and candidates of any length are read whole; a corpus with fewer than LEAST_EXAMPLES
windows of findings (or of other candidates) trains no network and adds nothing, which a warning and the query's column ``network`` tell;
repeated rows have equal spans; a null doc_id passes through; an empty table gives an empty result; extra columns are ignored.
Offsets are code points, the end exclusive; the span of ``assign`` is the whole match.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import quantiles
from .common import mix64, read_table, written

# The patterns and least lengths of the three kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "net")

#: A maximal run of hex digits that is long enough; shorter runs are dropped findings.
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

CONTEXT = 16
WINDOW = 32
WIDTH = 5
FILTERS = 24
EPOCHS = 8
RECALL = 0.98
#: ASCII by itself, everything else as one sign, and a sign for beyond the text.
ALPHABET = 130
OUTSIDE, OTHER = 129, 128
#: Windows that are scored at once.
BLOCK = 512
LEAST_EXAMPLES = 20
#: Different windows of a shard, about; bits behind the point of averaged numbers.
SHARD_ROWS, FIXED_BITS = 8192, 44


def findings(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind number, end, start and end of the value) of the fixed kinds, sorted."""
    out = [(m.start(), 0, m.end(), *m.span(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(m.start(), 2, m.end(), *m.span()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed kinds, sorted."""
    return [f[:3] for f in findings(text)]


def candidates(text: str, found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int]]:
    """Runs of key characters that no finding touches; both are in the order of their starts."""
    out, i, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        while i < len(found) and found[i][0] < m.end():
            reach = max(reach, found[i][2])
            i += 1
        if reach <= m.start():
            out.append(m.span())
    return out


def windows(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(character numbers of shape (n, CONTEXT + WINDOW + CONTEXT), number of the span) of the spans cut WINDOW
    characters at a time, up to BLOCK windows at once."""
    if text.isascii():
        codes = np.frombuffer(text.encode(), dtype=np.uint8)
    else:
        codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"), OTHER).astype(np.uint8)
    edge = np.full(CONTEXT, OUTSIDE, np.uint8)
    padded = np.concatenate([edge, codes, edge, np.full(WINDOW, OUTSIDE, np.uint8)])
    starts, ends = np.array(spans, dtype=np.int64).T
    many = -(-(ends - starts) // WINDOW)
    until = np.cumsum(many)
    place = np.arange(2 * CONTEXT + WINDOW)
    for at in range(0, int(until[-1]), BLOCK):
        no = np.arange(at, min(at + BLOCK, int(until[-1])))
        owner = np.searchsorted(until, no, side="right")
        first = starts[owner] + WINDOW * (no - (until - many)[owner])
        rows = padded[first[:, None] + place]
        rows[place >= (np.minimum(ends[owner], first + WINDOW) - first + 2 * CONTEXT)[:, None]] = OUTSIDE
        yield rows.astype(np.int64), owner


@dataclass
class Net:
    kernel: np.ndarray  # (WIDTH, ALPHABET, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    shift: float
    #: Platt scale and offset, and the threshold on the calibrated score.
    scale: float = 1.0
    offset: float = 0.0
    threshold: float = 1.1

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logit, pooled, place of the maximum) of each window."""
        n = x.shape[1] - WIDTH + 1
        z = self.bias + sum(self.kernel[i][x[:, i : i + n]] for i in range(WIDTH))
        place = z.argmax(axis=1)
        pooled = np.maximum(0, np.take_along_axis(z, place[:, None, :], axis=1)[:, 0, :])
        return pooled @ self.out + self.shift, pooled, place

    def score(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * logit + self.offset)))


def new_net(seed: int = 7) -> Net:
    r = np.random.default_rng(seed)
    return Net(r.normal(0, 0.2, (WIDTH, ALPHABET, FILTERS)), np.zeros(FILTERS), r.normal(0, 0.3, FILTERS), 0.0)


@dataclass
class Adam:
    m: list
    v: list
    step: int = 0


def new_adam(net: Net) -> Adam:
    zeros = lambda: [np.zeros_like(p) for p in (net.kernel, net.bias, net.out)] + [0.0]
    return Adam(zeros(), zeros())


def train_epoch(net: Net, adam: Adam, x: np.ndarray, y: np.ndarray, weight: np.ndarray, order: np.ndarray) -> None:
    """Adam on the weighted logistic loss, once over all windows in this order."""
    for at in np.array_split(order, max(1, len(x) // 64)):
        logit, pooled, place = net.forward(x[at])
        g = (1 / (1 + np.exp(-logit)) - y[at]) * weight[at] / len(at)
        back = g[:, None] * net.out * (pooled > 0)
        kernel = np.zeros_like(net.kernel)
        f = np.broadcast_to(np.arange(FILTERS), back.shape)
        for i in range(WIDTH):
            np.add.at(kernel, (i, np.take_along_axis(x[at], place + i, axis=1), f), back)
        adam.step += 1
        for k, (p, d) in enumerate(zip([net.kernel, net.bias, net.out, net.shift], [kernel, back.sum(axis=0), pooled.T @ g, g.sum()])):
            adam.m[k] = 0.9 * adam.m[k] + 0.1 * d
            adam.v[k] = 0.999 * adam.v[k] + 0.001 * d * d
            move = 0.01 * (adam.m[k] / (1 - 0.9**adam.step)) / (np.sqrt(adam.v[k] / (1 - 0.999**adam.step)) + 1e-8)
            if k == 3:
                net.shift -= float(move)
            else:
                p -= move


def train_net(x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS) -> Net:
    """EPOCHS of ``train_epoch`` on one machine, in a fixed order."""
    net, order = new_net(), np.random.default_rng(11)
    adam = new_adam(net)
    for _ in range(epochs):
        train_epoch(net, adam, x, y, weight, order.permutation(len(x)))
    return net


def to_vector(net: Net, adam: Adam) -> np.ndarray:
    return np.concatenate([np.ravel(p) for p in (net.kernel, net.bias, net.out, net.shift, *adam.m, *adam.v)])


def from_vector(flat: np.ndarray, step: int) -> tuple[Net, Adam]:
    shapes, at, parts = [(WIDTH, ALPHABET, FILTERS), (FILTERS,), (FILTERS,), ()], 0, []
    for shape in 3 * shapes:
        n = int(np.prod(shape, dtype=int))
        parts.append(flat[at : at + n].reshape(shape).copy() if shape else float(flat[at]))
        at += n
    return Net(*parts[:4]), Adam(parts[4:8], [np.maximum(v, 0) for v in parts[8:]], step)


def platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and offset of a logistic fit of y on the logit (Newton steps, slightly damped)."""
    w = np.array([1.0, 0.0])
    a = np.stack([logit, np.ones_like(logit)], axis=1)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(h, a.T @ (p - target))
    return float(max(w[0], 1e-3)), float(w[1])


def fit(texts: list[str]) -> Net | None:
    """``train`` for a list of whole texts on one machine; None without enough findings."""
    x, y, owner, n = [], [], [], 0
    for text in texts:
        found = findings(text)
        spans = [(f[3], f[4], 1) for f in found] + [(s, e, 0) for s, e in candidates(text, found)]
        if not spans:
            continue
        label = np.array([k for _, _, k in spans])
        for rows, no in windows(text, [(s, e) for s, e, _ in spans]):
            x.append(rows)
            y.append(label[no])
            owner.append(no + n)
        n += len(spans)
    x, y, owner = (np.concatenate(part) if part else np.zeros(0, np.int64) for part in (x, y, owner))
    aside = mix64(owner.astype(np.uint64) + np.uint64(1)) % np.uint64(3) == 0
    rest = ~aside
    if min(y.sum(), (1 - y).sum()) < LEAST_EXAMPLES or not 0 < y[rest].sum() < rest.sum() or not 0 < y[aside].sum() < aside.sum():
        warnings.warn("too few findings of the fixed patterns (or too few other candidates): no network is trained, only fixed findings are given", stacklevel=2)
        return None
    balance = np.where(y == 1, 0.5 / y[rest].mean(), 0.5 / (1 - y[rest].mean()))
    net = train_net(x[rest], y[rest].astype(float), balance[rest])
    logit = np.concatenate([net.forward(x[aside][at : at + BLOCK])[0] for at in range(0, int(aside.sum()), BLOCK)])
    who, no = np.unique(owner[aside], return_inverse=True)
    z, label = np.full(len(who), -np.inf), np.zeros(len(who), np.int64)
    np.maximum.at(z, no, logit)
    label[no] = y[aside]
    net.scale, net.offset = platt(z, label)
    scores = np.sort(net.score(z[label == 1]))
    clean = float(np.quantile(net.score(z[label == 0]), 0.999))
    net.threshold = min(float(scores[int(np.floor((1 - RECALL) * len(scores)))]), max(0.5, clean))
    return net


def scores(text: str, spans: list[tuple[int, int]], net: Net) -> np.ndarray:
    """Calibrated score of each span: that of its best window."""
    best = np.full(len(spans), -np.inf)
    if spans:
        for rows, no in windows(text, spans):
            np.maximum.at(best, no, net.forward(rows)[0])
    return net.score(best)


def all_spans(text: str, net: Net | None) -> tuple[list[tuple[int, int, int]], int]:
    """Fixed findings and those that the network adds; number of fixed findings that the network confirms."""
    found = findings(text)
    base = [f[:3] for f in found]
    if net is None:
        return base, 0
    free = candidates(text, found)
    passed = scores(text, [(f[3], f[4]) for f in found] + free, net) >= net.threshold
    added = [(s, 3, e) for (s, e), ok in zip(free, passed[len(found) :]) if ok]
    return sorted(base + added), int(passed[: len(found)].sum())


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def examples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Written (occ, cand, y, w): every window of every candidate of all rows.  ``occ`` is the candidate's own number, ``cand`` a hash of it and
    its context, ``w`` a byte per character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occ = TaskContext.get().partitionId() << 33
        out: list[list] = [[], [], [], []]
        for b in batches:
            for text in b.column(0).to_pylist():
                found = findings(text or "")
                spans = [(f[3], f[4], 1) for f in found] + [(s, e, 0) for s, e in candidates(text or "", found)]
                if not spans:
                    continue
                near = [f"{min(s, CONTEXT)} {e - s} {y} {text[max(0, s - CONTEXT) : e + CONTEXT]}" for s, e, y in spans]
                cand = np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in near], np.uint64).view(np.int64)
                label = np.array([y for _, _, y in spans], np.int32)
                for rows, no in windows(text, [(s, e) for s, e, _ in spans]):
                    for column, values in zip(out, (no + occ, cand[no], label[no], [r.tobytes() for r in rows.astype(np.uint8)])):
                        column.extend(values)
                    if len(out[0]) >= 8 * BLOCK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
                        out = [[], [], [], []]
                occ += len(spans)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    names, types = ["occ", "cand", "y", "w"], [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return written(docs.select(F.col(text_col).cast("string")).mapInArrow(run, "occ long, cand long, y int, w binary"), "secrets-examples")


def codes(column: pa.Array) -> np.ndarray:
    """Character numbers of windows, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 2 * CONTEXT + WINDOW).astype(np.int64)


def train_shards(windows: DataFrame, balance: tuple[float, float], max_rows: int) -> Net:
    """Network from (y, w, k), different windows with their number: EPOCHS rounds of an epoch in every shard and an average."""
    many, total = windows.agg(F.count("*"), F.sum("k")).first()
    shards = -(-many // max_rows)

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("w", "ascending"), ("y", "ascending")])
        cells = [b"".join(t["w"].to_pylist()), t["y"].to_numpy().astype(np.int64).tobytes(), t["k"].to_numpy().astype(np.int64).tobytes()]
        return pa.table({"shard": pa.array([t["shard"][0].as_py()], pa.int64()), **{n: pa.array([c], pa.binary()) for n, c in zip("wyk", cells)}})

    dealt = windows.withColumn("shard", F.pmod(F.xxhash64("w", "y"), F.lit(shards)))
    packed = written(dealt.groupBy("shard").applyInArrow(pack, "shard long, w binary, y binary, k binary"), "secrets-shards")
    net = new_net()
    flat, step = to_vector(net, new_adam(net)), 0
    for epoch in range(EPOCHS):
        shared = windows.sparkSession.sparkContext.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, step=step, epoch=epoch) -> Iterator[pa.RecordBatch]:
            mean, most = None, 0
            for b in batches:
                for shard, w, y, k in zip(*[b.column(c).to_pylist() for c in ("shard", "w", "y", "k")]):
                    x, y, k = codes(pa.array([w])), np.frombuffer(y, np.int64), np.frombuffer(k, np.int64)
                    net, adam = from_vector(shared.value, step)
                    order = np.random.default_rng([11, epoch, shard]).permutation(len(x))
                    train_epoch(net, adam, x, y.astype(float), np.where(y == 1, balance[1], balance[0]) * k * (many / total), order)
                    own = np.rint(to_vector(net, adam) * (len(x) / many * 2.0**FIXED_BITS)).astype(np.int64)
                    mean, most = own if mean is None else mean + own, max(most, adam.step)
            if mean is not None:
                yield pa.RecordBatch.from_arrays([pa.array([mean.tobytes()], pa.binary()), pa.array([most], pa.int64())], ["sums", "step"])

        got = packed.mapInArrow(run, "sums binary, step long").collect()
        flat, step = sum(np.frombuffer(r.sums, np.int64) for r in got) / 2.0**FIXED_BITS, max(r.step for r in got)
        shared.unpersist()
    return from_vector(flat, step)[0]


def logits(examples: DataFrame, net: Net) -> DataFrame:
    """Written (y, z) of every candidate: the logit of its best window."""
    shared = examples.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(shared.value.forward(codes(part.column(2)))[0])], ["occ", "y", "z"])

    best = examples.select("occ", "y", "w").mapInArrow(run, "occ long, y int, z double").groupBy("occ").agg(F.max("y").alias("y"), F.max("z").alias("z"))
    return written(best.select("y", "z"), "secrets-logits")


def platt_rows(rows: DataFrame) -> tuple[float, float]:
    """``platt`` over rows (y, z): a Newton step is one aggregation."""
    n1, n0 = rows.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    w = np.array([1.0, 0.0])
    target = F.when(F.col("y") == 1, (n1 + 1) / (n1 + 2)).otherwise(1 / (n0 + 2))
    for _ in range(25):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("z") * float(w[0]) + float(w[1])))))
        at = rows.select("z", (p * (1 - p)).alias("h"), (p - target).alias("d"))
        zz, z, one, gz, g = at.agg(*[F.sum(c) for c in (F.expr("h * z * z"), F.expr("h * z"), F.col("h"), F.expr("d * z"), F.col("d"))]).first()
        move = np.linalg.solve(np.array([[zz, z], [z, one]]) + 1e-3 * np.eye(2), np.array([gz, g]))
        w = np.round(w - move, 10)
        if abs(move).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def train(docs: DataFrame, text_col: str = "text", max_rows: int = SHARD_ROWS) -> Net | None:
    """Network, calibration and threshold from all candidates of all rows; ``max_rows`` is the number of different windows of a shard.  None without
    enough findings."""
    rows = examples(docs, text_col)
    aside = F.pmod(F.xxhash64("cand"), F.lit(3)) == 0
    n = {(r.aside, r.y): r["count"] for r in rows.groupBy(aside.alias("aside"), "y").count().collect()}
    windows_of = lambda y: n.get((True, y), 0) + n.get((False, y), 0)
    if min(windows_of(0), windows_of(1)) < LEAST_EXAMPLES or len(n) < 4:
        warnings.warn("too few findings of the fixed patterns (or too few other candidates): no network is trained, only fixed findings are given", stacklevel=2)
        return None
    rest = n[False, 0] + n[False, 1]
    balance = (0.5 * rest / n[False, 0], 0.5 * rest / n[False, 1])
    distinct = written(rows.where(~aside).groupBy("y", "w").agg(F.count("*").alias("k")), "secrets-windows")
    net = train_shards(distinct, balance, max_rows)
    z = logits(rows.where(aside), net)
    net.scale, net.offset = platt_rows(z)
    found = z.where("y = 1").count()
    # just below that finding's place, so that it passes itself
    share = max(0.0, int(np.floor((1 - RECALL) * found)) - 1e-6) / max(1, found - 1)
    (low,) = quantiles(z.where("y = 1"), {"z": "z"}, [share])["z"]
    (high,) = quantiles(z.where("y = 0"), {"z": "z"}, [0.999])["z"]
    recall, clean = net.score(np.array([low, high])).tolist()
    net.threshold = min(recall, max(0.5, clean))
    return net


def scan(docs: DataFrame, net: Net | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end>>, confirmed) per row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, sure = [], []
            for t in b.column(1).to_pylist():
                row, confirmed = all_spans(t or "", shared.value)
                spans.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in row])
                sure.append(confirmed)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(span)), pa.array(sure, pa.int64())], ["id", "spans", "confirmed"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, spans array<struct<kind: string, start: bigint, end: bigint>>, confirmed long")


def op9_secret_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    net = train(docs)
    found = scan(docs, net)

    def listed(column) -> object:
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> object:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "net")
    return found.select(
        F.col("id").alias("doc_id"), *[count(k) for k in KINDS[:3]],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        count("net"), F.col("confirmed").alias("n_confirmed"), F.lit(net is not None).alias("network"),
    )


QUERIES = {"op9_secret_network": op9_secret_network}
