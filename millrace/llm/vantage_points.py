"""Nearest neighbours by Euclidean distance with one vantage-point tree per shard.

The rows are dealt into shards of a bounded number of bytes. In each shard a tree is built: a node has a vantage point,
and its rows are split at the median distance from it; either side keeps the least and the largest of these distances. By
the triangle inequality a row of a side is at least ``bound`` away from a query, ``bound`` being how far the query's own
distance from the vantage point lies outside that interval. A side is left out where ``relax * bound`` exceeds
the distance of the k-th neighbour found so far. With ``relax`` of 1 the search is exact; larger factors leave out more
and may lose neighbours. Each query is asked in each shard, where it first goes down to its home leaf, and the best of
all shards are ranked. Shards are searched independently, so the result does not depend on which task has which shard.

Distances are sums of squares in the order of the components, in double precision, so equal vectors have equal
distances wherever they stand; a matrix product only tells which rows of a leaf can matter.

Vectors that are null, empty or zero, or hold null or non-finite components, take no part, nor do rows without an id.
Rows that are repeated in full count once. An id with several vectors is as many candidates, and as many queries; rows with
the query's own id are no candidates. Vectors of different dimensions are never compared. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.arrow import ship
from millrace.session import fresh_dir

SHARD_BYTES = 2 << 20  # of a tree's vectors, in double precision
LEAF = 64  # rows that are compared one by one
BLOCK_BYTES = 16 << 20  # of the queries that are sent to all tasks at once
SPREAD = (5, 64)  # vantage points tried for a node, and rows that tell how well each spreads distances
SLACK = 1e-9  # what rounding may cost, relative to the distances at hand

INDEX = "dim int, ids array<long>, vectors array<double>, inner array<int>, vantage array<double>, reach array<double>"
FOUND = "query_id long, query_row long, vec_id long, score double"


def usable(column: Column) -> Column:
    """Whether a vector takes part: finite components only, and not all of them 0."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(column, lambda x: x != 0), F.lit(False))


def _rows(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    named = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return named.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).distinct()


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of vectors that stand in columns, summed in the order of the components."""
    total = np.zeros(x.shape[1])
    for a, b in zip(x, y):
        step = a - b
        total += step * step
    return np.sqrt(total)


def _away(points: np.ndarray, vantage: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(points - vantage).sum(1))


class Tree:
    """A vantage-point tree over the rows of one shard.

    ``inner`` holds for each node, in depth-first order, its first row, its end and the node of its far side (0 for a
    leaf; the near side is the next node). ``vantage`` and ``reach`` hold the point of each node, and the least and largest
    distance from it on the near and the far side.
    """

    def __init__(self, ids, vectors, inner, vantage, reach):
        self.ids, self.vectors, self.inner, self.vantage, self.reach = ids, vectors, inner, vantage, reach
        self.columns = np.ascontiguousarray(vectors.T)
        self.squares = np.square(vectors).sum(1)
        self.compared = 0

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.arange(len(ids))
        inner: list[list[int]] = []
        vantage, reach = [], []
        todo = [(0, len(ids), -1)]
        while todo:
            a, b, parent = todo.pop()
            node = len(inner)
            if parent >= 0:
                inner[parent][2] = node
            inner.append([a, b, 0])
            own = vectors[order[a:b]]
            point, far = own[0] if b > a else np.zeros(vectors.shape[1]), np.zeros(0, bool)
            away = np.zeros(0)
            if b - a > leaf:
                # The point that spreads the distances most, of a few that stand evenly in the rows.
                tried = own[np.linspace(0, len(own) - 1, SPREAD[0]).astype(int)]
                seen = own[np.linspace(0, len(own) - 1, SPREAD[1]).astype(int)]
                point = max(tried, key=lambda p: _away(seen, p).var())
                away = _away(own, point)
                far = away > np.median(away)
                if not far.any():
                    far = away >= away.max()  # half of the distances or more are the largest one
            vantage.append(point)
            if not far.any() or far.all():
                reach.append([0.0] * 4)
                continue
            reach.append([away[~far].min(), away[~far].max(), away[far].min(), away[far].max()])
            order[a:b] = np.concatenate([order[a:b][~far], order[a:b][far]])
            middle = a + int((~far).sum())
            todo += [(middle, b, node), (a, middle, -1)]
        shape = (-1, vectors.shape[1])
        arrays = np.array(inner, np.int32), np.array(vantage).reshape(shape), np.array(reach)
        return cls(ids[order], vectors[order], *arrays)

    def _sides(self, node: int, asked: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query the least distance of a row on the near and on the far side, and what rounding may cost."""
        d = _away(queries[asked], self.vantage[node])
        low, high, far_low, far_high = self.reach[node]
        near = np.maximum(0, np.maximum(d - high, low - d))
        far = np.maximum(0, np.maximum(d - far_high, far_low - d))
        return near, far, SLACK * (d + far_high)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, relax: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the ``k`` nearest rows found for each query, nearest first; missing ones are infinitely far."""
        n = len(queries)
        best = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), np.inf)
        columns, squares = np.ascontiguousarray(queries.T), np.square(queries).sum(1)
        home = np.full(n, -1)

        def scan(node: int, asked: np.ndarray) -> None:
            a, b, _ = self.inner[node]
            for part in np.array_split(asked, -(-len(asked) * (b - a) // (1 << 20))):
                self.compared += len(part) * (b - a)
                limit = np.square(best[1][part, -1]) + SLACK * (squares[part] + self.squares[a:b].max())
                rough = squares[part][:, None] + self.squares[None, a:b] - 2 * queries[part] @ self.vectors[a:b].T
                near = rough <= limit[:, None]
                near &= self.ids[None, a:b] != query_ids[part][:, None]
                row, column = np.nonzero(near)
                if not len(row):
                    continue
                of, row = part[row], a + column
                d = _distances(columns[:, of], self.columns[:, row])
                hit = np.unique(of)
                owner = np.concatenate([np.repeat(hit, k), of])
                ids = np.concatenate([best[0][hit].ravel(), self.ids[row]])
                d = np.concatenate([best[1][hit].ravel(), d])
                order = np.lexsort((ids, d, owner))
                first = np.searchsorted(owner[order], hit)
                take = order[first[:, None] + np.arange(k)]
                best[0][hit], best[1][hit] = ids[take], d[take]

        # Down to the home leaf, which gives a first distance to beat.
        todo = [(0, np.arange(n))]
        while todo:
            node, asked = todo.pop()
            if not len(asked):
                continue
            if not self.inner[node][2]:
                home[asked] = node
                scan(node, asked)
                continue
            near, far, _ = self._sides(node, asked, queries)
            todo += [(self.inner[node][2], asked[near > far]), (node + 1, asked[near <= far])]
        # Then wherever the bound allows.
        todo = [(0, np.arange(n))]
        while todo:
            node, asked = todo.pop()
            if not len(asked):
                continue
            if not self.inner[node][2]:
                asked = asked[home[asked] != node]
                if len(asked):
                    scan(node, asked)
                continue
            near, far, slack = self._sides(node, asked, queries)
            beat = best[1][asked, -1] + slack
            todo += [(self.inner[node][2], asked[relax * far <= beat]), (node + 1, asked[relax * near <= beat])]
        return best


def build_index(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    leaf: int = LEAF,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """One row per shard with its tree, written to the shared folder; each is of bounded size."""
    spark = df.sparkSession
    ship(spark)
    rows = _rows(df, id_col, vector_col).withColumn("dim", F.size("vector"))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        dim = 0

        def shard() -> pa.RecordBatch:
            tree = Tree.build(*(np.concatenate(x) for x in zip(*held)), leaf)
            held.clear()
            arrays = [[dim], *([x.ravel()] for x in (tree.ids, tree.vectors, tree.inner, tree.vantage, tree.reach))]
            kinds = [pa.int32(), *map(pa.list_, (pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.float64()))]
            names = ["dim", "ids", "vectors", "inner", "vantage", "reach"]
            return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, kinds)], names)

        for batch in batches:
            ids, dims = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(dims, dtype=np.int64)])
            at = 0
            while at < len(ids):
                if held and dim != dims[at]:
                    yield shard()
                dim = int(dims[at])
                room = max(1, shard_bytes // (8 * dim)) - sum(len(i) for i, _ in held)
                stop = min(at + room, at + int(np.argmin(np.append(dims[at:], -1) == dim)))
                held.append((ids[at:stop], flat[ends[at] : ends[stop]].reshape(-1, dim)))
                if stop - at == room:
                    yield shard()
                at = stop
        if held:
            yield shard()

    ordered = rows.select("vec_id", "dim", "vector").sortWithinPartitions("dim", "vec_id", F.xxhash64("vector"))
    path = fresh_dir(spark, "vantage-points")
    ordered.mapInArrow(grow, INDEX).write.parquet(path)
    return spark.read.parquet(path)


def search(
    index: DataFrame,
    queries: DataFrame,
    k: int = 10,
    relax: float = 1.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each query, ties by the smaller id.

    The queries go to all shards in blocks of about ``block_bytes``, one pass over the index for each block; only one
    block is on the driver at a time. Each task gives the best of its shards.
    """
    if relax < 1:
        raise ValueError("search: a factor below 1 would prune less than the exact search")
    spark = queries.sparkSession
    ship(spark)
    base = fresh_dir(spark, "nearest")
    asked = _rows(queries, id_col, vector_col).withColumn("query_row", F.xxhash64("vector"))
    asked.write.parquet(f"{base}/queries")
    asked = spark.read.parquet(f"{base}/queries")
    total = asked.agg(F.coalesce(F.sum(F.size("vector") * 8 + 16), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total // block_bytes))
    block_of = F.pmod(F.xxhash64("vec_id", "query_row", F.lit("block")), F.lit(n_blocks))
    for b in range(n_blocks):
        rows = asked.where(block_of == b).orderBy("vec_id", "query_row").collect()
        by_dim: dict[int, list] = {}
        for r in rows:
            by_dim.setdefault(len(r.vector), []).append(r)
        block = {
            dim: (
                np.array([r.vec_id for r in own], np.int64),
                np.array([r.query_row for r in own], np.int64),
                np.array([r.vector for r in own], np.float64),
            )
            for dim, own in by_dim.items()
        }
        sent = spark.sparkContext.broadcast(block)
        _ask(index, sent, k, relax).write.mode("append").parquet(f"{base}/found")
        sent.unpersist()
    order = Window.partitionBy("query_id", "query_row").orderBy("score", "vec_id")
    ranked = spark.read.schema(FOUND).parquet(f"{base}/found").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _ask(index: DataFrame, sent, k: int, relax: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                dim, ids, vectors, inner, vantage, reach = (
                    c[i].values.to_numpy() if pa.types.is_list(c.type) else c[i].as_py() for c in batch.columns
                )
                if dim not in sent.value:
                    continue
                tree = Tree(ids, vectors.reshape(-1, dim), inner.reshape(-1, 3), vantage.reshape(-1, dim), reach.reshape(-1, 4))
                query_ids, _, points = sent.value[dim]
                found, d = tree.search(query_ids, points, k, relax)
                if dim in best:
                    found, d = np.hstack([best[dim][0], found]), np.hstack([best[dim][1], d])
                    order = np.lexsort((found, d), axis=1)[:, :k]
                    found, d = np.take_along_axis(found, order, 1), np.take_along_axis(d, order, 1)
                best[dim] = found, d
        for dim, (found, d) in best.items():
            query_ids, rows, _ = sent.value[dim]
            q, j = np.nonzero(np.isfinite(d))
            out = query_ids[q], rows[q], found[q, j], d[q, j]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["query_id", "query_row", "vec_id", "score"])

    return index.mapInArrow(run, FOUND)
