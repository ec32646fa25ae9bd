"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees.

Vectors are projected to ``M`` dimensions with Gaussian (2-stable) weights; for
two vectors at distance d, the squared projected distance over d^2 follows a
chi-square law with M degrees of freedom. Projected neighbours are taken from a
kd-tree nearest leaf first and verified on the original vectors, until the
chi-square test says that a vector nearer than the k-th best found would, with
probability ``STOP``, have shown up before the present projected distance.

Distributed: a kd-tree over a bounded sample of projected rows (``FIT_ROWS``)
cuts the projected space into cells of about ``CELL_ROWS`` rows; every row is
indexed in its cell. A query first searches its own cell; the distance found
there, put into the stopping test, says which other cells' boxes it still has
to visit. A cell of more than ``PART_ROWS`` rows is dealt over several trees, and
only a cell that more than ``QUERY_ROWS`` queries visit is copied, once for each
so many of them. Of equal vectors only the ``k + 1`` smallest ids can be among
any k nearest, which an exact, pre-shuffle group limit uses.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do rows without id. A vector's neighbours have its
length: those of the commonest length share the cells, each other length is a
space of its own. Rows equal in id and vector count once; of several vectors of
an id the nearest counts, so an id takes one place in an answer and none in its
own. Ties go to the smaller id. Fewer candidates than k give fewer rows; an
empty table gives none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import cut, sized, small, stage

M, STOP, LEAF = 8, 0.99, 64
CELL_ROWS, PART_ROWS, QUERY_ROWS, MAX_DEPTH = 8192, 1 << 15, 20_000, 16
#: The cells are fitted on a 256th of the rows, within these bounds (``M`` numbers a row).
LEAST_FIT_ROWS, FIT_ROWS = 20_000, 1 << 20


def chi_square_quantile(p: float, m: int = M) -> float:
    """For even ``m``, where the distribution has a closed form."""

    def above(x: float) -> float:
        term = total = 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if above(mid) > 1 - p else (low, mid)
    return high


@lru_cache(maxsize=64)
def projection(dimensions: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimensions, M))


def split_planes(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and threshold of each inner node of a complete kd-tree, in heap order."""
    axes, cuts = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    held = {0: points}
    for node in range(len(axes)):
        p = held.pop(node)
        if len(p):
            axes[node] = int(np.argmax(np.ptp(p, axis=0)))
            cuts[node] = np.median(p[:, axes[node]])
        right = p[:, axes[node]] > cuts[node]
        held[2 * node + 1], held[2 * node + 2] = p[~right], p[right]
    return axes, cuts


def cell_of(points: np.ndarray, axes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    rows = np.arange(len(points))
    for _ in range((len(axes) + 1).bit_length() - 1):
        node = 2 * node + 1 + (points[rows, axes[node]] > cuts[node])
    return node - len(axes)


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of a point to each box."""
    return (np.maximum(np.maximum(low - q, q - high), 0) ** 2).sum(axis=1)


class KdTree:
    """Leaves of about ``LEAF`` projected points with their boxes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, weights: np.ndarray):
        points, order, todo, leaves = vectors @ weights, [], [np.arange(len(ids))], []
        while todo:
            at = todo.pop()
            if len(at) > LEAF and (spread := np.ptp(points[at], axis=0)).max() > 0:
                axis = int(np.argmax(spread))
                half = np.argpartition(points[at, axis], len(at) // 2)
                todo += [at[half[: len(at) // 2]], at[half[len(at) // 2 :]]]
            elif len(at):
                leaves.append((sum(map(len, order)), len(at)))
                order.append(at)
        at = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.ids, self.vectors, self.points, self.weights = ids[at], vectors[at], points[at], weights
        self.again = len(np.unique(ids)) < len(ids)
        self.starts = np.array([a for a, _ in leaves], np.int64)
        self.ends = np.array([a + n for a, n in leaves], np.int64)
        boxed = [self.points[a : a + n] for a, n in leaves]
        self.low = np.array([b.min(axis=0) for b in boxed]).reshape(-1, M)
        self.high = np.array([b.max(axis=0) for b in boxed]).reshape(-1, M)

    def search(self, query_id: int, query: np.ndarray, k: int, quantile: float, bound: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the nearest found, nearest first; ``bound``: a k-th distance known already."""
        best_ids, best = np.zeros(0, self.ids.dtype), np.zeros(0)
        q = query @ self.weights
        near = box_distance(q, self.low, self.high)
        order, at, step = np.argsort(near), 0, 1
        while at < len(order):
            limit = quantile * bound * bound
            leaves = order[at : at + step]
            leaves = leaves[near[leaves] <= limit]
            if not len(leaves):
                break  # all that follows is farther still: the stopping test holds
            rows = np.concatenate([np.arange(self.starts[x], self.ends[x]) for x in leaves])
            if limit < np.inf:
                rows = rows[((self.points[rows] - q) ** 2).sum(axis=1) <= limit]
            rows = rows[self.ids[rows] != query_id]
            d = np.sqrt(((self.vectors[rows] - query) ** 2).sum(axis=1))
            best_ids, best = np.concatenate([best_ids, self.ids[rows]]), np.concatenate([best, d])
            keep = np.lexsort((best_ids, best))
            if self.again:  # an id's nearest vector takes its place
                keep = keep[np.sort(np.unique(best_ids[keep], return_index=True)[1])]
            best_ids, best = best_ids[keep[:k]], best[keep[:k]]
            if len(best) == k:
                bound = min(bound, float(best[-1]))
            at, step = at + step, min(2 * step, 64)
        return best_ids, best


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vec`` of the rows that take part."""
    v = F.col("vec")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec")).where(F.col("vec_id").isNotNull() & v.isNotNull())
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return rows.where(fine)


def _projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            vectors, points = part.column(1).to_pylist(), [None] * part.num_rows
            size = np.fromiter(map(len, vectors), np.int32, len(vectors))
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                for i, p in zip(rows, np.array([vectors[i] for i in rows], np.float64) @ projection(int(n))):
                    points[i] = p
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(size), pa.array(points, pa.list_(pa.float64()))], ["vec_id", "vec", "size", "point"])


def nearest(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows that satisfy ``queries`` (a condition on vec_id), against all rows."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col).dropDuplicates(["vec_id", "vec"])
    kind = dict(rows.dtypes)["vec"]
    projected = stage(rows.mapInArrow(_projected, f"vec_id long, vec {kind}, size int, point array<double>"), "ann-projected")
    most = projected.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, n = most["size"], most["count"]
    fit = min(FIT_ROWS, max(LEAST_FIT_ROWS, n >> 8))
    sample = projected.where(F.col("size") == size).where(F.pmod(F.xxhash64("vec_id", "vec"), F.lit(sized(n, fit))) == 0).select("point").toArrow()  # about ``fit`` rows
    axes, cuts = split_planes(np.array(sample.column("point").to_pylist(), np.float64).reshape(-1, M), min(MAX_DEPTH, max(0, (sized(n, CELL_ROWS) - 1).bit_length())))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lengths = batch.column(2).to_numpy()
                cell = np.where(lengths == size, cell_of(np.array(batch.column(3).to_pylist(), np.float64), axes, cuts), -lengths)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *(batch.column(i) for i in (0, 1, 3))], ["cell", "vec_id", "vec", "point"])

    def placed(df: DataFrame) -> DataFrame:
        return df.mapInArrow(place, f"cell int, vec_id long, vec {kind}, point array<double>")

    # of equal vectors, only the k + 1 smallest ids can be near any query; the limit applies before the shuffle, too
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    points = stage(placed(projected.withColumn("_n", nth).where(F.col("_n") <= k + 1).drop("_n")), "ann-points")
    ask = stage(placed(projected.where(queries)).withColumn("q", F.monotonically_increasing_id()), "ann-queries")
    bounds = [f(F.col("point")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(M)]
    cells = stage(points.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), *bounds), "ann-cells")

    def look(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(asked):
            points = np.stack(held["vec"].to_numpy()).astype(np.float64)
            tree = KdTree(held["vec_id"].to_numpy(), points, projection(points.shape[1]))
            for q, query_id, v, bound in zip(asked["q"], asked["query_id"], asked["vec"], asked["bound"]):
                ids, d = tree.search(query_id, np.asarray(v, np.float64), k, quantile, bound)
                out.append(pd.DataFrame({"q": q, "query_id": query_id, "vec_id": ids, "score": d}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "query_id": [], "vec_id": [], "score": []})

    quantile = chi_square_quantile(STOP)

    def searched(asked: DataFrame) -> DataFrame:
        """The k nearest in each asked (cell, q, query_id, vec, bound): a task holds one part of a cell and a block of its queries."""
        load = asked.groupBy("cell").agg(F.count(F.lit(1)).alias("asked")).join(small(cells.select("cell", "rows")), "cell")
        parts, blocks = (F.ceil(F.col(c) / most).cast("int") for c, most in (("rows", PART_ROWS), ("asked", QUERY_ROWS)))
        load = small(stage(load.select("cell", parts.alias("parts"), blocks.alias("blocks")), "ann-load"))
        upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        held = points.join(load, "cell").select("cell", F.pmod(F.xxhash64("vec_id", "vec"), "parts").cast("int").alias("part"), upto("blocks").alias("block"), "vec_id", "vec")
        asked = asked.join(load, "cell").select("cell", upto("parts").alias("part"), F.pmod(F.xxhash64("q"), "blocks").cast("int").alias("block"), "q", "query_id", "vec", "bound")
        on = ["cell", "part", "block"]
        return held.groupBy(*on).cogroup(asked.groupBy(*on)).applyInPandas(look, "q long, query_id long, vec_id long, score double")

    ask = ask.withColumnRenamed("vec_id", "query_id")
    home = stage(searched(ask.withColumn("bound", F.lit(float("inf")))), "ann-home")
    boxes = cells.where("cell >= 0").toPandas()  # at most 2 ** MAX_DEPTH rows
    numbers = boxes["cell"].to_numpy()
    low, high = (boxes[[f"{name}{i}" for i in range(M)]].to_numpy() for name in ("low", "high"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = []
            for own, point, bound in zip(*(batch.column(i).to_pylist() for i in (0, 4, 5))):
                reach = numbers[box_distance(np.array(point), low, high) <= quantile * bound * bound] if own >= 0 else numbers[:0]
                to.append(reach[reach != own].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.list_(pa.int32())), *(batch.column(i) for i in (1, 2, 3, 5))], ["cells", "q", "query_id", "vec", "bound"])

    scores = home.groupBy("q", "vec_id").agg(F.min("score").alias("score")).groupBy("q").agg(F.array_sort(F.collect_list("score")).alias("scores"))
    kth = scores.select("q", F.get("scores", F.lit(k - 1)).alias("kth"))  # a query has k scores for each part of its cell
    known = ask.join(kth, "q", "left").select("cell", "q", "query_id", "vec", "point", F.coalesce("kth", F.lit(float("inf"))).alias("bound"))
    routed = stage(known.mapInArrow(route, f"cells array<int>, q long, query_id long, vec {kind}, bound double"), "ann-routed")
    away = searched(routed.select(F.explode("cells").alias("cell"), "q", "query_id", "vec", "bound"))
    every = home.unionByName(away).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
