"""Approximate nearest neighbours by inner product over stable projections.

Vectors are lifted by one coordinate to a common length, which turns the largest inner
product into the smallest Euclidean distance, and projected to ``DIMS`` dimensions by a
Gaussian (2-stable) matrix: a pair's squared projected distance over its squared distance
then follows a chi-square law with DIMS degrees of freedom. The projected space is cut
into cells by a kd-tree fitted on a bounded sample (``SAMPLE_BYTES``); every row is
indexed in its cell, which has a finer kd-tree. A query goes through leaves in order of
their distance and verifies, on the original vectors, the projected neighbours that pass
the chi-square test: a vector nearer than the k-th found lies within that projected
distance with probability ``sure``. It stops when no leaf lies within it. The query's own
cell comes first; the k-th score found there goes with it to those other cells alone that
the test leaves.

Vectors with little contrast (independent directions) have so many projected neighbours
that the test excludes only a part; then every query meets every cell, and the work is a
share of queries times vectors. ``searched_share`` measures that share.

Equal vectors are one point; of its ids no more than k + 1 can be among a query's k
nearest, so only the smallest ones are kept, before anything is dealt out.

Defined results: vectors that are null, zero or of another length than most, or that hold
null or non-finite components, take no part; ties in score go to the smaller id; a query
with fewer candidates gets them all; repeated rows of one id and vector count once; an id
with several vectors is a candidate with each (and appears with its best) and asks with
the one that sorts first; null ids take no part; an empty table gives no rows. Other
columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Work, tidy

DIMS, LEAF = 32, 64
#: The probability with which the stopping test must hold; rows and bytes of a shard's
#: vectors; bytes of the sample that the cells are fitted on.
SURE, SHARD_ROWS, SHARD_BYTES, SAMPLE_BYTES = 0.9, 65_536, 64 << 20, 4 << 20
SEED = 5

FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def chi_square_bound(dims: int, sure: float) -> float:
    """The value below which a chi-square variable lies with probability ``sure``."""

    def below(x: float) -> float:
        # Regularised lower incomplete gamma function by its series.
        a, h = dims / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= h / n
            total += term
        return total * math.exp(-h + a * math.log(h) - math.lgamma(a))

    low, high = 1e-9, 200.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < sure else (low, middle)
    return high


class Projection:
    """The lift to a common length and the stable projection."""

    def __init__(self, width: int, longest: float):
        self.square = longest * longest
        self.matrix = np.random.default_rng(SEED).normal(size=(width + 1, DIMS))

    def of_rows(self, vectors: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(self.square - np.einsum("ij,ij->i", vectors, vectors), 0))
        return vectors @ self.matrix[:-1] + lift[:, None] * self.matrix[-1]

    def of_queries(self, vectors: np.ndarray) -> np.ndarray:
        """A query has its length, not the common one: it is lifted by nothing."""
        return vectors @ self.matrix[:-1]


def box_distances(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances from a place to boxes."""
    gap = np.maximum(np.maximum(low - q, q - high), 0)
    return np.einsum("ij,ij->i", gap, gap)


def median_cuts(points: np.ndarray, done):
    """Cuts places by medians of the widest side until ``done`` says so of a run's length:
    (order, runs as (from, to, cuts)); a cut is (axis, value, whether above)."""
    order, leaves, todo = np.arange(len(points)), [], [(0, len(points), ())]
    while todo:
        a, b, cuts = todo.pop()
        if done(b - a):
            leaves.append((a, b, cuts))
            continue
        own = points[order[a:b]]
        axis = int((own.max(axis=0) - own.min(axis=0)).argmax())
        middle = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(own[:, axis], middle)]
        value = float(points[order[a + middle], axis])
        todo += [(a, a + middle, (*cuts, (axis, value, False))), (a + middle, b, (*cuts, (axis, value, True)))]
    leaves.sort()
    return order, leaves


class Cells:
    """The upper kd-tree: which cell a projected place lies in, and how far it is from others."""

    def __init__(self, sample: np.ndarray, cells: int):
        _, leaves = median_cuts(sample, lambda n: n < 2 * max(1, len(sample) // max(cells, 1)) or n < 32)
        self.cuts = [cuts for _, _, cuts in leaves]
        self.n = len(leaves)
        self.low, self.high = np.full((self.n, DIMS), -np.inf), np.full((self.n, DIMS), np.inf)
        for i, cuts in enumerate(self.cuts):
            for axis, value, above in cuts:
                if above:
                    self.low[i, axis] = max(self.low[i, axis], value)
                else:
                    self.high[i, axis] = min(self.high[i, axis], value)

    def of(self, places: np.ndarray) -> np.ndarray:
        """The cell of each place; one on a cut belongs above it."""
        out, todo = np.zeros(len(places), np.int32), [(np.arange(len(places)), list(range(self.n)), 0)]
        while todo:
            rows, cells, depth = todo.pop()
            if len(cells) == 1 or not len(rows):
                out[rows] = cells[0]
                continue
            axis, value, _ = self.cuts[cells[0]][depth]
            above = places[rows, axis] >= value
            for side in (False, True):
                todo.append((rows[above == side], [c for c in cells if self.cuts[c][depth][2] == side], depth + 1))
        return out


class Shard:
    """A cell's points (or a share of them) under a kd-tree of their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, project: Projection, k: int, sure: float):
        # Equal vectors become one point; of its ids only the k + 1 smallest can matter.
        by_id = np.argsort(ids, kind="stable")
        ids, vectors = ids[by_id], np.ascontiguousarray(vectors[by_id])
        _, first, point = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_index=True, return_inverse=True)
        own = vectors[first].astype(np.float64)
        by = np.argsort(point.ravel(), kind="stable")
        bounds = np.searchsorted(point.ravel()[by], np.arange(len(first) + 1))
        projected = project.of_rows(own)
        order, leaves = median_cuts(projected, lambda n: n <= LEAF)
        self.starts, self.ends = (np.array([leaf[i] for leaf in leaves]) for i in (0, 1))
        self.exact = own[order]
        self.vectors = self.exact.astype(np.float32)
        self.projected = projected[order]
        self.low, self.high = np.minimum.reduceat(self.projected, self.starts), np.maximum.reduceat(self.projected, self.starts)
        self.norms = np.einsum("ij,ij->i", self.projected, self.projected)
        self.ids = [np.unique(ids[by[a:b]])[: k + 1] for a, b in ((bounds[i], bounds[i + 1]) for i in order)]
        self.project, self.k, self.bound = project, k, chi_square_bound(DIMS, sure)
        self.verified = 0

    def search(self, query_id: int, q: np.ndarray, known: float = -math.inf) -> list[tuple[int, float]]:
        """The k nearest ids here with their scores; ``known`` is a k-th score from elsewhere."""
        length, square = float(q @ q), self.project.square
        place, q32 = self.project.of_queries(q[None])[0], q.astype(np.float32)
        # Scores in single precision choose what is scored exactly.
        slack = 1e-5 * max(math.sqrt(length * square), 1e-30)
        distance = lambda score: max(length + square - 2 * (score - slack), 0.0)
        worst = distance(known)
        near = box_distances(self.low, self.high, place)
        leaves = np.argsort(near, kind="stable")
        best, scores, points, at, step = np.zeros(0, np.float32), [], [], 0, 4
        while at < len(leaves) and near[leaves[at]] <= self.bound * worst:
            some = leaves[at : at + step]
            rows = np.concatenate([np.arange(a, b) for a, b in zip(self.starts[some], self.ends[some])])
            d2 = self.norms[rows] - 2 * (self.projected[rows] @ place) + place @ place
            close = np.flatnonzero(d2 <= self.bound * worst + 1e-9 * square)
            by = close[np.argsort(d2[close])]
            rows, d2 = rows[by], d2[by]
            # Projected neighbours in order, in growing groups, as the test becomes stricter.
            a, group = 0, 2 * self.k + 64
            while a < len(rows) and d2[a] <= self.bound * worst + 1e-9 * square:
                b = min(a + group, int(np.searchsorted(d2, self.bound * worst + 1e-9 * square, "right")))
                found = self.vectors[rows[a:b]] @ q32
                scores.append(found)
                points.append(rows[a:b])
                best = np.concatenate([best, found])
                if len(best) > self.k:  # one more than k, as the query itself may be among them
                    best = -np.partition(-best, self.k)[: self.k + 1]
                    worst = min(worst, distance(float(best.min())))
                a, group = b, 4 * group
            at, step = at + step, 4 * step
        if not scores:
            return []
        scores, points = np.concatenate(scores), np.concatenate(points)
        self.verified += len(points)
        least = max(float(best.min()) if len(best) > self.k else -math.inf, known) - 2 * slack
        keep = points[np.flatnonzero(scores >= least)]
        # Sums are rounded once, from products that are exact for single-precision input, so
        # equal vectors score the same in every shard.
        found: dict[int, float] = {}
        for i in keep.tolist():
            score = math.fsum((self.exact[i] * q).tolist())
            for v in self.ids[i].tolist():
                if v != query_id:
                    found[v] = max(score, found.get(v, -math.inf))
        return sorted(found.items(), key=lambda x: (-x[1], x[0]))[: self.k]


def matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def searched(k: int, sure: float, project: Projection):
    """Streams of a shard's rows and then of queries, sorted by shard; yields what is found."""

    def run(batches):
        shard, built, ids, vectors, out = None, None, [], [], []
        for batch in batches:
            shards, kinds, keys, known = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            flat = matrix(batch.column(4), len(batch))
            edges = np.flatnonzero(np.concatenate([[True], (shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1])]))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(batch)]):
                if shards[a] != shard:
                    shard, built, ids, vectors = shards[a], None, [], []
                if kinds[a] == 0:
                    ids.append(keys[a:b].copy())
                    vectors.append(flat[a:b].copy())
                    continue
                if built is None:
                    if not ids:
                        continue
                    built = Shard(np.concatenate(ids), np.concatenate(vectors), project, k, sure)
                    ids, vectors = [], []
                for i in range(a, b):
                    out += [(keys[i], v, x) for v, x in built.search(int(keys[i]), flat[i].astype(np.float64), float(known[i]))]
                    if len(out) >= 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), FOUND.types)], schema=FOUND)
                        out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), FOUND.types)], schema=FOUND)

    return run


def placed(cells: Cells, project: Projection, parts: int):
    """(shard, kind, id, known, v) of rows: each in its cell, dealt by its id among the cell's parts."""

    def run(batches):
        for batch in batches:
            n = len(batch)
            cell = cells.of(project.of_rows(matrix(batch.column(1), n).astype(np.float64))) if n else np.zeros(0, np.int32)
            part = batch.column(0).to_numpy(zero_copy_only=False) % parts
            shard = (cell * parts + part).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.zeros(n, np.int32)), batch.column(0), pa.array(np.full(n, -math.inf)), batch.column(1)], names=["shard", "kind", "id", "known", "v"])

    return run


def asked(cells: Cells, project: Projection, parts: int, bound: float, home: bool):
    """Queries at the shards of their own cell, or of the others that the test leaves."""

    def run(batches):
        for batch in batches:
            n = len(batch)
            q = matrix(batch.column(1), n).astype(np.float64)
            places = project.of_queries(q) if n else np.zeros((0, DIMS))
            own, known = cells.of(places), batch.column(2).to_numpy(zero_copy_only=False)
            rows, shards = [], []
            for i in range(n):
                if home:
                    wanted = own[i : i + 1]
                else:
                    worst = max(float(q[i] @ q[i]) + project.square - 2 * float(known[i]), 0.0)
                    near = box_distances(cells.low, cells.high, places[i])
                    wanted = np.flatnonzero((near <= bound * worst + 1e-9 * project.square) & (np.arange(cells.n) != own[i]))
                each = (wanted[:, None] * parts + np.arange(parts)).ravel()
                rows.append(np.full(len(each), i))
                shards.append(each)
            at = pa.array(np.concatenate(rows)) if rows else pa.array([], pa.int64())
            shard = np.concatenate(shards).astype(np.int32) if shards else np.zeros(0, np.int32)
            taken = [batch.column(c).take(at) for c in (0, 2, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.ones(len(shard), np.int32)), *taken], names=["shard", "kind", "id", "known", "v"])

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0))


def nearest(vectors: DataFrame, is_query, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, sure: float = SURE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for each query.

    ``is_query`` is a condition on vec_id; a query's own row is no candidate.
    """
    spark = vectors.sparkSession
    work = Work(spark, "ann")
    rows = work.keep(usable(vectors, id_col, vector_col), "vectors")
    # The length that most vectors have; the number of different lengths is small.
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("square")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == lengths.d)
    kind, project = rows.schema["v"].dataType.simpleString(), Projection(lengths.d, math.sqrt(lengths.square))
    # Of equal vectors the k + 1 smallest ids, chosen before the shuffle and after it.
    equal = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    points = rows.withColumn("__place", F.dense_rank().over(equal)).where(F.col("__place") <= k + 1).select("vec_id", "v")
    # Enough shards to use the cluster, no more than rows and their size need.
    most = max(1, min(shard_rows, SHARD_BYTES // (4 * lengths.d)))
    shards = max(spark.sparkContext.defaultParallelism, -(-lengths.n // most))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(32, SAMPLE_BYTES // (8 * lengths.d))).select("v").toArrow().column("v").combine_chunks()
    cells = Cells(project.of_rows(matrix(sample, len(sample)).astype(np.float64)), shards)
    parts = -(-shards // cells.n)
    total = cells.n * parts
    stream = f"shard int, kind int, id long, known double, v {kind}"
    data = work.keep(points.mapInArrow(placed(cells, project, parts), stream), "placed")
    who = work.keep(rows.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("known", F.lit(float("-inf"))), "queries")

    def found_at(queries: DataFrame) -> DataFrame:
        dealt = data.unionByName(queries).repartitionById(total, "shard").sortWithinPartitions("shard", "kind")
        return dealt.mapInArrow(tidy(searched(k, sure, project)), "query_id long, vec_id long, score double")

    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ask = lambda q, home: q.select("vec_id", "v", "known").mapInArrow(asked(cells, project, parts, chi_square_bound(DIMS, sure), home), stream)
    found = found_at(ask(who, True))
    if cells.n > 1:
        own = work.keep(found.withColumn("rank", place).where(F.col("rank") <= k).drop("rank"), "at-home")
        # The k-th score at home; a query that found fewer than k there knows none.
        kth = own.groupBy("query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
        going = who.join(kth, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", F.coalesce("kth", "known").alias("known"))
        found = own.unionByName(found_at(ask(going, False)))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def searched_share(vectors: np.ndarray, queries: np.ndarray, k: int = 20, sure: float = SURE) -> float:
    """Of all (query, vector) pairs the share that is verified, in one shard."""
    project = Projection(vectors.shape[1], float(np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max())))
    shard = Shard(np.arange(len(vectors)), vectors, project, k, sure)
    for q in queries:
        shard.search(-1, q.astype(np.float64))
    return shard.verified / (len(shard.exact) * len(queries))
