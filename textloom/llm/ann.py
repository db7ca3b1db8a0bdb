"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions and ordered along a Hilbert curve,
several times with other projections and shifts. Each ordering is cut into
windows of about equal numbers of vectors, and Spark partitions it by range: a
task holds some neighbouring windows. A query goes to the tasks that hold
windows around its own place and is compared with these windows; what windows and
orderings find is merged and ranked by the exact distance of the original vectors.

How many windows a query looks at is calibrated: for a bounded sample of queries
(``CALIBRATION``) the true neighbours are found by brute force, and the reach is
the smallest number of windows that holds ``RECALL`` of them. Vectors with
structure need few windows; vectors without any, whose neighbours lie on no
curve, need many, and the search then nears brute force in blocks, which is the
price of the recall on such data.

Equal vectors are indexed by their ``k + 1`` smallest ids, as no query can
return more of them; so one vector held by most rows is a few rows. Different
vectors with one key are spread over the windows that the key fills.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import cut, table

#: Orderings, projected dimensions and bits of each, vectors of a window, and windows of a task's range.
CURVES, DIMS, BITS, WINDOW_ROWS, RANGE = 4, 6, 10, 512, 16
#: Rows whose keys tell where windows end, and windows of an ordering at most; beyond WINDOW_ROWS times that, windows grow.
EDGE_ROWS, MAX_WINDOWS = 1 << 20, 1 << 16
#: Rows from which means and spreads are taken, sampled queries, and the share of their neighbours to be within reach.
FIT_ROWS, CALIBRATION, RECALL = 4096, 96, 0.96
SEED = 20240501
#: Distances that are computed at once.
CELLS = 4_000_000


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """The place of each point (a row of integers below 2**bits) along the Hilbert curve, after Skilling (2004)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t ^= np.where((x[n - 1] & (1 << b)) != 0, (1 << b) - 1, 0)
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curves:
    """Projections, spreads and shifts of each ordering, fitted on a sample."""

    def __init__(self, sample: np.ndarray):
        rng = np.random.default_rng(SEED)
        d = sample.shape[1]
        self.maps = [rng.standard_normal((d, DIMS)) for _ in range(CURVES)]
        self.mean = sample.mean(0)
        self.spread = [np.maximum(((sample - self.mean) @ m).std(0), 1e-12) for m in self.maps]
        self.shift = [rng.uniform(-0.5, 0.5, DIMS) for _ in range(CURVES)]

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """A column of keys for each ordering."""
        out = []
        for m, s, shift in zip(self.maps, self.spread, self.shift):
            unit = ((vectors - self.mean) @ m / s + shift + 4) / 8
            out.append(hilbert(np.clip(unit * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS))
        return np.stack(out, 1)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def nearest(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[list, list, list]:
    """For each query its k nearest of ``ids``, its own id left out: (query ids, ids, exact distances)."""
    out_q, out_i, out_d = [], [], []
    if not len(ids) or not len(query_ids):
        return out_q, out_i, out_d
    squares = (vectors**2).sum(1)
    step = max(1, CELLS // len(ids))
    for start in range(0, len(query_ids), step):
        some, own = queries[start : start + step], query_ids[start : start + step]
        rough = squares[None, :] - 2 * (some @ vectors.T) + (some**2).sum(1)[:, None]
        rough[own[:, None] == ids[None, :]] = np.inf
        kth = np.partition(rough, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
        near = rough <= (kth + 1e-9 * (1 + np.abs(kth)))[:, None]
        for row in range(len(own)):
            at = np.nonzero(near[row] & np.isfinite(rough[row]))[0]
            exact = np.sqrt(((vectors[at] - some[row]) ** 2).sum(1))
            best = np.lexsort((ids[at], exact))[:k]
            out_q += [int(own[row])] * len(best)
            out_i += ids[at][best].tolist()
            out_d += exact[best].tolist()
    return out_q, out_i, out_d


FOUND = "query_id long, vec_id long, score double"


def _batch(found: tuple[list, list, list]) -> pa.RecordBatch:
    q, i, d = found
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(d, pa.float64())], names=["query_id", "vec_id", "score"])


def top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def brute_force(index: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """The true neighbours of a few queries; ``index`` has ``id`` and ``v``."""
    dims = queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch(nearest(b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(1), dims), query_ids, queries, k))

    return top(index.select("id", "v").mapInArrow(run, FOUND), k)


def _valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where(F.col("id").isNotNull() & v.isNotNull())
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.coalesce(fine, F.lit(False)))


def _sample(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    got = rows.orderBy("h1", "id").limit(n).select("id", "v").toArrow()
    if not got.num_rows:
        return np.empty(0, np.int64), np.empty((0, 0))
    return got["id"].to_numpy(), np.array(got["v"].to_pylist(), np.float64)


@dataclass
class Layout:
    """Where vectors lie: the orderings, the upper ends of their windows, and how many windows a query looks at on each side."""

    curves: Curves
    edges: list[np.ndarray]
    windows: int
    reach: int = 0

    def places(self, ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """A column of window numbers for each ordering; a key that fills several windows is spread over them by the ids."""
        keys = self.curves.keys(vectors)
        out = []
        for c, edges in enumerate(self.edges):
            low, high = (np.searchsorted(edges, keys[:, c], side=x) for x in ("left", "right"))
            out.append(low + ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) // np.uint64(1 << 32) % (high - low + 1).astype(np.uint64))
        return np.stack(out, 1).astype(np.int64)

    def share(self) -> float:
        """Vectors that a query is compared with, as a part of all; above 1 where orderings repeat them."""
        return min(1.0, (2 * self.reach + 1) / self.windows) * len(self.edges)


def lay_out(index: DataFrame, queries: DataFrame, dims: int, k: int) -> Layout:
    """The layout of ``index(id, v, h1)``, its reach calibrated on a sample of ``queries``."""
    n = index.count()
    curves = Curves(_sample(index, FIT_ROWS)[1])
    windows = max(1, min(MAX_WINDOWS, n // WINDOW_ROWS))
    found = Layout(curves, [np.empty(0, np.int64)] * CURVES, windows)
    if windows == 1:
        return found

    def add_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = curves.keys(matrix(b.column(0), dims))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(keys[:, c])) for c in range(CURVES)], names=[f"k{c}" for c in range(CURVES)])

    some = index.sample(False, EDGE_ROWS / n, SEED) if n > EDGE_ROWS else index
    keys = some.select("v").mapInArrow(add_keys, ", ".join(f"k{c} long" for c in range(CURVES))).toArrow()
    at = np.arange(1, windows) * keys.num_rows // windows
    found.edges = [np.sort(keys.column(c).to_numpy())[at] for c in range(CURVES)]
    sample_ids, sample = _sample(queries, CALIBRATION)
    if len(sample_ids):
        true = cut(brute_force(index, sample_ids, sample, k)).join(index.select(F.col("id").alias("vec_id"), "v"), "vec_id").select("query_id", "vec_id", "v").toArrow()
        if true.num_rows:
            where = dict(zip(sample_ids.tolist(), found.places(sample_ids, sample)))
            own = np.stack([where[q] for q in true["query_id"].to_pylist()])
            apart = np.sort(np.abs(own - found.places(true["vec_id"].to_numpy(), np.array(true["v"].to_pylist(), np.float64))).min(1))
            found.reach = int(apart[min(len(apart) - 1, int(np.ceil(RECALL * len(apart))))])
    return found


def dealt(rows: DataFrame, layout: Layout, dims: int, is_query: bool) -> DataFrame:
    """``(curve, range, window, asks, id, v)``: vectors of ``rows(id, v)`` in their windows' ranges, queries in all ranges within reach."""
    kind = rows.schema["v"].dataType.simpleString()
    names = ["curve", "range", "window", "asks", "id", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at = layout.places(b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(1), dims))
            for c in range(CURVES):
                own = at[:, c]
                first = np.maximum(own - layout.reach, 0) // RANGE if is_query else own // RANGE
                last = np.minimum(own + layout.reach, layout.windows - 1) // RANGE if is_query else first
                for step in range(int((last - first).max()) + 1):
                    rows_in = np.nonzero(first + step <= last)[0]
                    take = pa.array(rows_in)
                    arrays = [pa.array(np.full(len(rows_in), c, np.int32)), pa.array((first[rows_in] + step).astype(np.int32)), pa.array(own[rows_in].astype(np.int32)), pa.array(np.full(len(rows_in), is_query))]
                    yield pa.RecordBatch.from_arrays([*arrays, b.column(0).take(take), b.column(1).take(take)], names=names)

    return rows.select("id", "v").mapInArrow(run, f"curve int, range int, window int, asks boolean, id long, v {kind}")


def nearest_neighbours(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for each query, ties to smaller ids.

    ``is_query`` is a condition on the column ``id``. Vectors that are null,
    empty, zero, hold null or non-finite components, have no id, or whose
    length isn't the table's most common one take no part. Rows that share an
    id are one row, with the vector of the smallest hash. An empty table, or
    one without queries, gives an empty result; with fewer than ``k``
    candidates all are returned. Other columns of ``df`` don't matter, whatever
    their names.
    """
    spark = df.sparkSession
    rows = _valid(df, id_col, vec_col)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = length["n"]
    rows = rows.where(F.size("v") == dims).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    rows = cut(rows.groupBy("id").agg(F.min(F.struct("h1", "h2", "v")).alias("r")).select("id", "r.*"))
    same = Window.partitionBy("h1", "h2").orderBy("id")
    index = cut(rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).drop("n"))
    queries = rows.where(is_query)
    layout = lay_out(index, queries, dims, k)
    reach = layout.reach

    def match(part: pa.Table) -> pa.Table:
        asks, window = part["asks"].to_numpy(), part["window"].to_numpy()
        ids, vectors = part["id"].to_numpy(), matrix(part["v"].combine_chunks(), dims)
        here, asked = np.nonzero(~asks)[0], np.nonzero(asks)[0]
        found: list[pa.RecordBatch] = []
        for w in np.unique(window[here]) if len(asked) else []:
            near, mine = here[window[here] == w], asked[np.abs(window[asked] - w) <= reach]
            found.append(_batch(nearest(ids[near], vectors[near], ids[mine], vectors[mine], k)))
        if not found:
            return pa.Table.from_batches([_batch(([], [], []))])
        met = pa.Table.from_batches(found).sort_by([("query_id", "ascending"), ("score", "ascending"), ("vec_id", "ascending")])
        own = met["query_id"].to_numpy()
        first = np.concatenate(([True], own[1:] != own[:-1])) if len(own) else np.empty(0, bool)
        place = np.arange(len(own)) - np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))
        return met.filter(pa.array(place < k))

    ranges = dealt(index, layout, dims, False).union(dealt(queries, layout, dims, True))
    found = ranges.repartitionByRange("curve", "range").groupBy("curve", "range").applyInArrow(match, FOUND)
    return top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
