"""The k nearest rows of every query row, exactly, without a join of all pairs in the plan.

Cosines, and distances in many coordinates, compare blocks of queries with all rows.  Distances in up to CELL_DIMS coordinates go by cells: halves of
halves along the widest coordinate, until a cell has about CELL_ROWS rows.  A query searches its own cell, and then the cells whose box is
no farther than the last of what it has found.  The cuts come from a sample, which moves the cells' sizes and never the result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import broadcast_if_small, stored

#: Bytes of query vectors that go to every task at once; more queries go in several passes.
BLOCK_BYTES = 16_000_000
#: Rows and queries of one matrix of distances.
ROWS, QUERIES = 4096, 512
#: Coordinates up to which distances go by cells; boxes in more of them rule little out.
CELL_DIMS = 6
#: Rows of a cell and of the sample that places the cuts, about.
CELL_ROWS, SAMPLE_ROWS = 2048, 200_000
#: The cell of rows with a coordinate that is no finite number; every query looks into it.
ODD = -1


def _distances(q: np.ndarray, x: np.ndarray, cosine: bool) -> np.ndarray:
    """(queries, rows): squared Euclidean distances, or negated cosines with inf where there is none."""
    if not cosine:
        out = np.zeros((len(q), len(x)))
        for d in range(x.shape[1]):
            out += (x[None, :, d] - q[:, None, d]) ** 2
        return np.where(np.isnan(out), np.inf, out)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = -(q @ x.T) / (np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1))[None, :])
    return np.where(np.isfinite(out), out, np.inf)


def _best(no: np.ndarray, value: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k least (value, id) of each query number."""
    order = np.lexsort((ids, value, no))
    no, value, ids = no[order], value[order], ids[order]
    first = np.searchsorted(no, no)
    keep = np.arange(len(no)) - first < k
    return no[keep], value[keep], ids[keep]


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def _split(points: np.ndarray, size: float) -> tuple | None:
    """Tree of (coordinate, cut, below, not below) with None for a cell; cells of the sample have ``size`` points at most, if they differ."""
    if len(points) <= max(1, size):
        return None
    d = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
    x = points[:, d]
    cut = float(np.median(x))
    if not (x < cut).any():
        more = x[x > x.min()]
        if not len(more):
            return None
        cut = float(more.min())
    return d, cut, _split(points[x < cut], size), _split(points[x >= cut], size)


def _home(tree: tuple | None, x: np.ndarray) -> np.ndarray:
    """Number of the cell of each vector, from the left."""
    out, count = np.zeros(len(x), np.int64), 0

    def walk(node: tuple | None, rows: np.ndarray) -> None:
        nonlocal count
        if node is None:
            out[rows] = count
            count += 1
            return
        below = x[rows, node[0]] < node[1]
        walk(node[2], rows[below])
        walk(node[3], rows[~below])

    walk(tree, np.arange(len(x)))
    return out


def _reach(tree: tuple | None, q: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of a query, cell) of all cells whose box is within the bound of the query."""
    who, cells, count = [], [], 0

    def walk(node: tuple | None, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        nonlocal count
        far = np.zeros(len(rows))
        for d in range(q.shape[1]):
            with np.errstate(invalid="ignore"):
                far += np.maximum(np.maximum(low[d] - q[rows, d], q[rows, d] - high[d]), 0) ** 2
        rows = rows[~(far > bound[rows])]
        if node is None:
            who.append(rows)
            cells.append(np.full(len(rows), count))
            count += 1
            return
        d, cut = node[:2]
        below, above = high.copy(), low.copy()
        below[d] = above[d] = cut
        walk(node[2], rows, low, below)
        walk(node[3], rows, above, high)

    walk(tree, np.arange(len(q)), np.full(q.shape[1], -np.inf), np.full(q.shape[1], np.inf))
    return np.concatenate(who), np.concatenate(cells)


def _by_cells(src: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query, id, value, rank) by squared distance."""
    spark = src.sparkSession
    # of equal vectors only the least ids can be among the nearest; a query's own id goes at the end, as often as it stands there
    own = src.groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    keep = k + own
    points = src.withColumn("_c", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_c") <= keep).drop("_c")
    points = stored(points, "nearest-points")
    total = points.count()
    finite = F.forall("v", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    part = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < int(min(1.0, SAMPLE_ROWS / max(1, total)) * (1 << 30))
    sample = _vectors(points.where(part & finite).select("v").toArrow()["v"])
    shared = spark.sparkContext.broadcast(_split(sample, CELL_ROWS * len(sample) / max(1, total)) if len(sample) else None)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b.column(1))
            cell = np.where(np.isfinite(x).all(axis=1), _home(shared.value, x), ODD)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell)], ["id", "v", "cell"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                t = b.slice(at, ROWS)
                who, cell = _reach(shared.value, _vectors(t.column(1)), t.column(3).to_numpy(zero_copy_only=False))
                who, cell = np.concatenate([who, np.arange(t.num_rows)]), np.concatenate([cell, np.full(t.num_rows, ODD)])
                new = cell != t.column(2).to_numpy(zero_copy_only=False)[who]
                out = t.take(pa.array(who[new]))
                yield pa.RecordBatch.from_arrays([out.column(0), out.column(1), pa.array(cell[new])], ["id", "v", "cell"])

    def search(asks: pa.Table, rows: pa.Table) -> pa.Table:
        names, q, ids, x = asks["id"].to_numpy(), _vectors(asks["v"]), rows["id"].to_numpy(), _vectors(rows["v"])
        found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        for f in range(0, len(q) if len(x) else 0, QUERIES):
            best = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
            for at in range(0, len(x), ROWS):
                d = _distances(q[f : f + QUERIES], x[at : at + ROWS], False)
                limit = np.partition(d, keep - 1, axis=1)[:, keep - 1] if d.shape[1] > keep else np.full(len(d), np.inf)
                r, c = np.nonzero(d <= limit[:, None])
                best = _best(*map(np.concatenate, zip(best, (r, d[r, c], ids[at : at + ROWS][c]))), keep)
            found.append((best[0] + f, best[1], best[2]))
        no, value, near = map(np.concatenate, zip(*found))
        return pa.table({"no": pa.array(names[no], pa.int64()), "id": pa.array(near, pa.int64()), "value": pa.array(value, pa.float64())})

    def searched(asks: DataFrame) -> DataFrame:
        return asks.groupBy("cell").cogroup(placed.groupBy("cell")).applyInArrow(lambda a, b: search(a, b), "no long, id long, value double")

    kinds = "id long, v array<double>, cell long"
    placed = stored(points.mapInArrow(place, kinds), "nearest-placed")
    # equal queries are asked once, under the least id of them
    asks = stored(asked.groupBy("v").agg(F.min("id").alias("id")).select("id", "v").mapInArrow(place, kinds), "nearest-asked")
    first = stored(searched(asks), "nearest-first")
    full = first.groupBy("no").agg(F.when(F.count("*") >= keep, F.max("value")).alias("b"))
    bounded = asks.join(full, asks["id"] == full["no"], "left").select("id", "v", "cell", F.coalesce("b", F.lit(float("inf"))).alias("b"))
    found = first.unionByName(searched(bounded.mapInArrow(visits, kinds)))
    found = stored(found.withColumn("_r", F.row_number().over(Window.partitionBy("no").orderBy("value", "id"))).where(F.col("_r") <= keep).drop("_r"), "nearest-found")
    named = asked.select(F.col("id").alias("query"), "v").join(broadcast_if_small(asks.select(F.col("id").alias("no"), "v")), "v").select("query", "no")
    near = named.join(found, "no").where("query <> id")
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("value", "id"))).where(F.col("rank") <= k)
    return best.select("query", "id", "value", "rank")


def nearest(rows: DataFrame, queries: DataFrame, id_col: str, vector: Column, k: int, cosine: bool = False) -> DataFrame:
    """(query, id, value, rank) of the k rows nearest to each query row but itself, ties by id; value is the squared distance, or the cosine
    (null for a zero vector).  ``vector`` is an array of doubles of one length; the ids are whole numbers.

    By blocks, queries go to the tasks; each task keeps its own k best per query over all its rows, and only those are shuffled."""
    pair = [F.col(id_col).cast("long").alias("id"), vector.cast("array<double>").alias("v")]
    asked = stored(queries.select(*pair).where("id is not null and v is not null"), "nearest-queries")
    size = asked.agg(F.sum(8 * F.size("v") + 16)).first()[0] or 0
    src = rows.select(*pair).where("id is not null and v is not null")
    one = asked.select(F.size("v").alias("d")).first()
    if not cosine and one and 0 < one.d <= CELL_DIMS:
        return _by_cells(src, asked, k)
    passes = max(1, -(-size // BLOCK_BYTES))
    found = None
    for turn in range(passes):
        table = asked.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == turn).orderBy("id").toArrow()
        names = table["id"].to_numpy()
        flat = table["v"].combine_chunks().flatten().to_numpy() if len(names) else np.zeros(0)
        shared = rows.sparkSession.sparkContext.broadcast((names, flat.reshape(len(names), -1) if len(names) else np.zeros((0, 1))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked, q = shared.value
            no, value, ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
            worst = np.full(len(asked), np.inf)
            for b in batches:
                for at in range(0, b.num_rows if len(asked) else 0, ROWS):
                    part = b.slice(at, ROWS)
                    own = part.column(0).to_numpy(zero_copy_only=False)
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                    more = [(no, value, ids)]
                    for f in range(0, len(asked), QUERIES):
                        d = _distances(q[f : f + QUERIES], x, cosine)
                        self_at = asked[f : f + QUERIES, None] == own[None, :]
                        d[self_at] = np.nan
                        limit = worst[f : f + QUERIES]
                        if len(own) > k:
                            limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
                        r, c = np.nonzero(d <= limit[:, None])
                        more.append((r + f, d[r, c], own[c]))
                    no, value, ids = _best(*map(np.concatenate, zip(*more)), k)
                    full = np.bincount(no, minlength=len(asked)) >= k
                    top = np.full(len(asked), -np.inf)
                    np.maximum.at(top, no, value)
                    worst = np.where(full, top, np.inf)
            if len(no):
                yield pa.RecordBatch.from_arrays([pa.array(asked[no]), pa.array(ids), pa.array(value)], ["query", "id", "value"])

        one = src.mapInArrow(run, "query long, id long, value double")
        found = one if found is None else found.unionByName(one)
    w = Window.partitionBy("query").orderBy("value", "id")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    shown = F.when(F.col("value") != float("inf"), -F.col("value")) if cosine else F.col("value")
    return best.select("query", "id", shown.alias("value"), "rank")
