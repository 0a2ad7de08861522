"""Exact top-k inner-product search with one KD-tree per shard.

Candidates are dealt to shards by id; a task reads a shard's candidates, builds
a KD-tree by median splits with tight bounding boxes, and then streams the
queries past it, so it holds one shard and one batch of queries. A query first
meets its home shard, which gives it a k-th best score; the score travels with
the query to other shards in rounds, tightened from round to round, and
best-first traversal stops as soon as no box can beat it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import staged

LEAF = 256
#: Candidates to expect in a shard, and by how much more shards each round takes.
SHARD, ROUNDS = 16_384, 16


class KDTree:
    """Median-split tree over vectors of whole numbers; rows keep their ids.

    Scores are exact: float64 sums of integers below 2**53, or Python integers
    where components are too large for that; a score has to fit 64 bits.
    """

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.leaves: list[tuple[np.ndarray, np.ndarray] | None] = []
        todo = [(np.arange(len(ids)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            part = points[rows]
            node = len(self.low)
            self.low.append(part.min(axis=0))
            self.high.append(part.max(axis=0))
            self.children.append(None)
            self.leaves.append(None)
            if parent >= 0:
                a, b = self.children[parent] or (-1, -1)
                self.children[parent] = (node, b) if side == 0 else (a, node)
            spread = self.high[node] - self.low[node]
            axis = int(np.argmax(spread))
            if len(rows) <= LEAF or spread[axis] == 0:
                order = np.argsort(ids[rows], kind="stable")
                self.leaves[node] = ids[rows][order], part[order]
                continue
            half = len(rows) // 2
            split = np.argpartition(part[:, axis], half)
            todo += [(rows[split[:half]], node, 0), (rows[split[half:]], node, 1)]
        self.lows, self.highs = np.array(self.low), np.array(self.high)
        self.largest = float(max(np.abs(self.lows[0]).max(initial=0), np.abs(self.highs[0]).max(initial=0)))

    def search(self, query: np.ndarray, own: int, k: int, bound: int | None) -> list[tuple[int, int]]:
        """Up to k best (score, id) that are no worse than ``bound``.

        Ties go to the smaller id. ``own`` is left out. Boxes are taken in the
        order of the best score they could hold.
        """
        up, down = np.maximum(query, 0), np.minimum(query, 0)
        bounds = self.highs @ up + self.lows @ down
        exact = len(query) * self.largest * float(np.abs(query).max(initial=0)) < 2**53
        if not exact:  # what rounding could take from a bound is added to it
            bounds = bounds + 1e-12 * (np.maximum(np.abs(self.highs), np.abs(self.lows)) @ np.abs(query))
        best: list[tuple[int, int]] = []  # min-heap of (score, -id)
        floor = bound
        queue = [(-bounds[0], 0)]
        while queue:
            reach, node = heapq.heappop(queue)
            if floor is not None and -reach < floor:
                break
            if self.children[node]:
                for child in self.children[node]:
                    if floor is None or bounds[child] >= floor:
                        heapq.heappush(queue, (-bounds[child], child))
                continue
            ids, points = self.leaves[node]
            scores = points @ query if exact else np.array([sum(int(a) * int(b) for a, b in zip(p, query)) for p in points], object)
            other = ids != own
            at = np.flatnonzero(other & (scores >= floor)) if floor is not None else np.flatnonzero(other)
            if len(at) > 4 * k:  # a leaf can give no more than its own best k
                at = at[np.lexsort((ids[at], -scores[at]))[:k]]
            for i in at.tolist():
                item = (int(scores[i]), -int(ids[i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                floor = max(best[0][0], floor) if floor is not None else best[0][0]
        return [(s, -i) for s, i in best]


def _matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and floor(256 x) of the vectors of each dimension."""
    sizes = np.asarray(pc.list_value_length(column))
    values, starts = np.asarray(column.flatten()), np.cumsum(sizes) - sizes
    out = []
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        out.append((rows, np.floor(values[starts[rows][:, None] + np.arange(dim)] * 256.0)))
    return out


def _searched(k: int):
    """Streams rows (shard, query, id, vec, bound), sorted, a shard's candidates before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, trees = None, {}, None
        for batch in batches:
            shards, asks, ids, bounds = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in (0, 1, 2, 4))
            edges = np.flatnonzero(np.concatenate(([True], (shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1]), [True])))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if shards[a] != shard:
                    shard, held, trees = shards[a], {}, None
                found = _matrices(batch.column(3).slice(a, b - a))
                if not asks[a]:
                    for rows, points in found:
                        held.setdefault(points.shape[1], []).append((ids[a:b][rows], points))
                    continue
                if trees is None:
                    trees = {dim: KDTree(np.concatenate([i for i, _ in x]), np.concatenate([p for _, p in x])) for dim, x in held.items()}
                    held = {}
                out: list[tuple[int, int, int]] = []
                for rows, queries in found:
                    if tree := trees.get(queries.shape[1]):
                        for query, own, bound in zip(queries, ids[a:b][rows].tolist(), bounds[a:b][rows].tolist()):
                            out += [(own, i, s) for s, i in tree.search(query, own, k, None if bound is None or bound != bound else int(bound))]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)] or [pa.array([], pa.int64())] * 3, names=["query_id", "vec_id", "score"])

    return run


def usable_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec as array of double) of the rows that take part.

    Null ids, null vectors and vectors with a null, NaN or infinite component
    are left out.
    """
    vec = F.col(vec_col).cast("array<double>")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
        .where(F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0))
        .where(~bad)
    )


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shards: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best candidates.

    Score: inner product of the vectors floor(256 x). Candidates are rows:
    rows that repeat an id and a vector count as often as they are there, but
    rows of the query's own id are no candidates for it, nor are vectors of
    another dimension. A query row that is given twice is asked once; an id
    with several different vectors is asked with each, and what it finds is
    ranked together. Ties go
    to the smaller id. A query has fewer rows if fewer candidates exist; an
    empty table gives an empty result. A shard has about SHARD candidates.
    """
    points = usable_vectors(vectors, id_col, vec_col)
    n = shards or max(1, -(-vectors.count() // SHARD))
    home = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    placed = points.select(home.alias("shard"), F.lit(False).alias("query"), "id", "vec", F.lit(None).cast("long").alias("bound"))
    asked = usable_vectors(queries, id_col, vec_col).dropDuplicates(["id", "vec"]).withColumns({"home": home, "bound": F.lit(None).cast("long")})
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found, first = None, 0
    while first < n:
        last = min(n, max(1, first * ROUNDS)) if first else 1
        visits = F.explode(F.transform(F.sequence(F.lit(first), F.lit(last - 1)), lambda i: F.pmod(F.col("home") + i, F.lit(n)).cast("int")))
        onward = asked if found is None else asked.drop("bound").join(
            found.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("bound")), "id", "left"
        )
        both = placed.unionByName(onward.select(visits.alias("shard"), F.lit(True).alias("query"), "id", "vec", "bound"))
        ordered = both.repartition("shard").sortWithinPartitions("shard", "query", "id")
        fresh = ordered.mapInArrow(_searched(k), "query_id long, vec_id long, score long")
        whole = fresh if found is None else found.unionByName(fresh)
        found = staged(whole.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"))
        first = last
    return found.withColumn("rank", F.row_number().over(best)).select("query_id", "rank", "vec_id", "score")


def op10_kdtree_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""
