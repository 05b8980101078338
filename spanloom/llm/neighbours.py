"""Operator 12: approximate nearest neighbours by inner product, by counting collisions on sorted projections.

Vectors are dealt into ranges of their norm and, within a task, into blocks of BLOCK rows. Divided by the largest norm M of its block and
lengthened by the entry that brings it to norm 1, a vector's distance from the unit query (lengthened by 0) falls as their inner product
rises: distance^2 = 2 - 2 <q, x> / (|q| M). Norms that differ much don't blur this, as M is the block's own.

Index of a block: PROJECTIONS random directions, orthonormal as far as the dimension goes; for each one array of the block's
projections, sorted. A query looks at a window around its own projection in each array. A radius r makes the window r * WINDOW / sqrt(d)
wide to either side; a larger radius widens the windows in the same arrays (virtual rehashing). A vector collides once for each window
that holds it: one at distance r does so p(r) * PROJECTIONS times on average, and vectors with at least that number less SLACK standard
deviations are verified by their exact inner product. The search of a block ends once the k-th best distance found is within the radius;
until then the radius doubles, or goes straight to the k-th best distance where that is known. Windows that hold over half of the arrays
are counted by what they leave out.

Every row is indexed and no bound is set on windows or candidates. Queries are read in chunks of QUERIES, which go to all tasks; for each
chunk one pass over the vectors, without a shuffle of vectors, and a merge of each task's k best for each query.

Null, empty and all-zero vectors, those with null, NaN or infinite entries, and those of another length than most have take no part.
Equal scores go to the smaller id, a null id last. Each row is a candidate, repeated ones too; a query's own are the rows with its id.
Repeated query rows (same id and vector) ask once. Other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import save
from spanloom.llm.vectors import matrix, usable

NEAREST = 20
BLOCK, PROJECTIONS = 8192, 64
#: Half a window, in standard deviations of the projection of a difference as long as the radius.
WINDOW, SLACK = 1.4, 1.0
#: Radii before a k-th distance is known; 2 is the greatest distance there is.
FIRST_RADIUS, GREATEST = 0.25, 2.0
QUERIES = 8192
#: Rows of a range of norms: as many partitions as that makes, and no fewer than the session's default.
RANGE = 262_144
#: Stands for a null id inside a task.
NAMELESS = np.iinfo(np.int64).max


def least_collisions(projections: int = PROJECTIONS, window: float = WINDOW, slack: float = SLACK) -> int:
    """How often a vector at the distance of the radius collides, less the slack."""
    p = erf(window / sqrt(2))
    return max(1, ceil(projections * p - slack * sqrt(projections * p * (1 - p))))


def directions(d: int, count: int) -> np.ndarray:
    """d x count: random unit directions, each d of them orthonormal. The same for every task."""
    random = np.random.default_rng(12)
    return np.hstack([np.linalg.qr(random.standard_normal((d, d)))[0] for _ in range(-(-count // d))])[:, :count]


class Block:
    """Some vectors, and for each direction their projections in sorted order."""

    def __init__(self, vectors: np.ndarray, numbers: np.ndarray, projections: int = PROJECTIONS):
        self.vectors, self.numbers = vectors, numbers
        norms = np.sqrt((vectors**2).sum(axis=1))
        self.most = norms.max()
        rest = np.sqrt(np.maximum(0.0, 1 - (norms / self.most) ** 2))
        self.directions = directions(vectors.shape[1] + 1, projections)
        projected = np.hstack([vectors / self.most, rest[:, None]]) @ self.directions
        self.order = np.ascontiguousarray(projected.argsort(axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(projected.T, self.order, axis=1)

    def windows(self, at: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each query's windows begin and end in the sorted arrays: queries x directions."""
        low, high = np.empty(at.shape, np.int64), np.empty(at.shape, np.int64)
        for j, values in enumerate(self.sorted):
            low[:, j] = np.searchsorted(values, at[:, j] - half, "left")
            high[:, j] = np.searchsorted(values, at[:, j] + half, "right")
        return low, high

    def collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many of one query's windows hold each vector."""
        n, ends = len(self.numbers), list(zip(self.order, low.tolist(), high.tolist(), strict=True))
        if 2 * int((high - low).sum()) <= n * len(self.order):
            return np.bincount(np.concatenate([o[a:b] for o, a, b in ends]), minlength=n)
        return len(self.order) - np.bincount(np.concatenate([x for o, a, b in ends for x in (o[:a], o[b:])]), minlength=n)


class Best:
    """The k best of each query so far: scores (falling) and the numbers of the vectors they belong to."""

    def __init__(self, queries: np.ndarray, ids: list[int], k: int):
        self.queries, self.k = queries, k
        self.norms = np.sqrt((queries**2).sum(axis=1))
        self.scores, self.numbers = np.full((len(queries), k), -np.inf), np.full((len(queries), k), NAMELESS, np.int64)
        self.own = np.array(ids, np.int64)

    def add(self, i: int, block: Block, chosen: np.ndarray) -> None:
        """Verifies vectors of a block for query i."""
        near = block.vectors[chosen]
        worst = self.scores[i, -1]
        if np.isfinite(worst):  # a quick product rules most of them out; what is close is computed alike for all rows
            rough = near @ self.queries[i]
            keep = rough >= worst - 1e-9 * self.norms[i] * block.most
            chosen, near = chosen[keep], near[keep]
        numbers = block.numbers[chosen]
        other = numbers != self.own[i]
        scores = np.concatenate([self.scores[i], (near[other] * self.queries[i]).sum(axis=1)])
        numbers = np.concatenate([self.numbers[i], numbers[other]])
        top = np.lexsort((numbers, -scores))[: self.k]
        self.scores[i], self.numbers[i] = scores[top], numbers[top]

    def search(self, block: Block, window: float = WINDOW, slack: float = SLACK) -> int:
        """Brings all queries up to date with a block; returns how many vectors were verified."""
        need = least_collisions(len(block.order), window, slack)
        scale = self.norms * block.most
        at = np.hstack([self.queries / self.norms[:, None], np.zeros((len(self.queries), 1))]) @ block.directions
        width, n = window / sqrt(block.vectors.shape[1] + 1), len(block.numbers)
        limit = lambda: np.sqrt(np.clip(2 - 2 * self.scores[:, -1] / scale, 0.0, GREATEST**2))  # noqa: E731  distance of the k-th best
        radius, verified = np.where(np.isfinite(self.scores[:, -1]), limit(), FIRST_RADIUS), 0
        # A k-th score that no vector of the block can reach: its norm is too small.
        active = np.flatnonzero(~(self.scores[:, -1] > scale * (1 + 1e-12)))
        seen: dict[int, np.ndarray] = {}
        while len(active):
            low, high = block.windows(at[active], radius[active] * width)
            held = (high - low).sum(axis=1)
            for place, i in enumerate(active.tolist()):
                if radius[i] >= GREATEST:  # everything is within it
                    chosen = np.ones(n, bool)
                elif held[place] < need:
                    continue
                else:
                    chosen = block.collisions(low[place], high[place]) >= need
                fresh = chosen & ~seen[i] if i in seen else chosen
                if fresh.any():
                    seen[i] = chosen | seen[i] if i in seen else chosen
                    verified += int(fresh.sum())
                    self.add(i, block, np.flatnonzero(fresh))
            now = limit()
            active = active[(now[active] > radius[active]) & (radius[active] < GREATEST)]
            radius[active] = np.minimum(2 * radius[active], now[active])
        return verified


def _found(best: Best) -> pa.RecordBatch:
    query, place = np.nonzero(np.isfinite(best.scores))
    return pa.RecordBatch.from_pydict({"query": pa.array(query.astype(np.int32)), "number": pa.array(best.numbers[query, place]), "score": pa.array(best.scores[query, place])})


def blocks_of(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(vectors, numbers) of up to `size` rows."""
    held, rows = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, min(size - rows, batch.num_rows - at))
            held.append((matrix(part.column("vector")), part.column("number").to_numpy()))
            rows, at = rows + part.num_rows, at + part.num_rows
            if rows == size:
                yield np.concatenate([v for v, _ in held]), np.concatenate([i for _, i in held])
                held, rows = [], 0
    if rows:
        yield np.concatenate([v for v, _ in held]), np.concatenate([i for _, i in held])


def indexed(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """number, vector of the usable rows, dealt into ranges of their norm, saved: what all passes read."""
    good = usable(rows, key, vector, zeros=False).select(F.coalesce(F.col(key).cast("bigint"), F.lit(int(NAMELESS))).alias("number"), F.col(vector).alias("vector"))
    good = good.withColumn("norm", F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-good.count() // RANGE))
    return save(good.repartitionByRange(parts, "norm", "number").drop("norm"), "vectors")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, chunk: int = QUERIES) -> DataFrame:
    """vectors(number, vector) as indexed, queries(number, vector) -> query_id, rank (from 1), vec_id, score: the k best of each query, its own rows left out."""
    spark = vectors.sparkSession
    asked = queries.select("number", "vector").distinct()
    chunks = max(1, ceil(asked.count() / (0.8 * chunk)))  # numbers are dealt by hash, so chunks differ a little in size
    asked = save(asked.withColumn("chunk", F.pmod(F.xxhash64("number"), F.lit(chunks)).cast("int")).repartition("chunk"), "queries")
    found: DataFrame | None = None
    for c in range(chunks):
        own = asked.where(F.col("chunk") == c).orderBy("number", "vector").toArrow()  # about 0.8 * chunk rows
        if not own.num_rows:
            continue
        ids, points = own["number"].to_pylist(), matrix(own["vector"].combine_chunks())

        def search(batches: Iterator[pa.RecordBatch], ids: list[int] = ids, points: np.ndarray = points) -> Iterator[pa.RecordBatch]:
            best, any_rows = Best(points, ids, k), False
            for rows, numbers in blocks_of(batches):
                best.search(Block(rows, numbers))
                any_rows = True
            if any_rows:
                yield _found(best)

        named = spark.createDataFrame(pa.table({"query": pa.array(range(len(ids)), pa.int32()), "query_id": pa.array(ids, pa.int64())}))
        part = save(vectors.mapInArrow(search, "query int, number bigint, score double"), "found").join(F.broadcast(named), "query").withColumn("chunk", F.lit(c))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rank = F.row_number().over(W.partitionBy("chunk", "query").orderBy(F.desc("score"), "number"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.nullif("number", F.lit(int(NAMELESS))).alias("vec_id"), "score")


def nearest_neighbours(embeddings: DataFrame, asked: Column, key: str = "vec_id", vector: str = "embedding", k: int = NEAREST) -> DataFrame:
    """embeddings(key, vector, ...), asked: which rows are queries (a condition on `number`, their id) -> nearest()'s rows."""
    vectors = indexed(embeddings, key, vector)
    return nearest(vectors, vectors.where((F.col("number") != int(NAMELESS)) & asked), k)
