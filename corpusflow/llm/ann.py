"""Approximate nearest neighbours by largest inner product: inverted lists and an adaptive scan of dimensions.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm (queries 0), so that the largest inner product is
the least distance, and are rotated at random. Each probed list holds them in blocks of columns. After each block a
candidate's partial distance, scaled to all dimensions, is tested against the query's current k-th best; those that very
likely lie beyond are abandoned. Survivors are scored exactly, in double precision, on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, with_columns_of

#: Bounded sample for the fit of centroids, rotation and number of probes, or four vectors a list if that is more; all vectors are indexed.
FIT_ROWS, FIT_QUERIES = 16_384, 256
#: Rows of one side of a tile, candidates taken together, columns of a block.
TILE, STEP, BLOCK = 4096, 512, 16
#: Part of a stretch's pairs up to which the survivors are picked out, instead of going on with the whole matrix.
SPARSE = 0.04
#: The recall that the sample must reach before the number of probes is settled, and the test's slack (in deviations).
AIM, SLACK = 0.96, 2.1


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


@dataclass
class Index:
    dim: int
    norm: float
    rotation: np.ndarray
    centroids: np.ndarray
    probes: int

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Rotated float32 vectors with the component that makes inner products distances."""
        x = x / self.norm
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, 1 - (x**2).sum(1)))
        return (np.concatenate([x, more[:, None]], axis=1) @ self.rotation).astype(np.float32)

    def distances(self, x: np.ndarray) -> np.ndarray:
        d = (x**2).sum(1)[:, None] + (self.centroids**2).sum(1)[None, :] - 2 * x @ self.centroids.T
        return np.sqrt(np.maximum(d, 0))


def kmeans(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:lists]].copy()
    for _ in range(rounds):
        near = np.concatenate([((c**2).sum(1)[None, :] - 2 * x[i : i + 2048] @ c.T).argmin(1) for i in range(0, len(x), 2048)])
        sums, n = np.zeros_like(c, dtype=np.float64), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c[n > 0] = (sums[n > 0] / n[n > 0, None]).astype(np.float32)
    return c


def fit(vectors: DataFrame, count: int, dim: int, norm: float, k: int, seed: int = 5) -> Index:
    """An index of about sqrt(count) lists, so that lists and their number grow alike."""
    rng = np.random.default_rng(seed)
    index = Index(dim, norm, np.linalg.qr(rng.standard_normal((dim + 1, dim + 1)))[0], np.zeros((1, dim + 1), np.float32), 1)
    lists = round(np.sqrt(count))
    hashed = vectors.select("v", F.xxhash64("vec_id", "v").alias("h"))
    rows = hashed.orderBy("h").limit(max(FIT_ROWS, 4 * lists)).select("v").toPandas()["v"]
    x = np.stack(rows.to_numpy()).astype(np.float64)
    lifted, asked = index.lifted(x), index.lifted(x[:FIT_QUERIES], True)
    index.centroids = kmeans(lifted, max(1, min(len(x) // 4, lists)))
    near = np.concatenate([index.distances(lifted[i : i + 2048]).argmin(1) for i in range(0, len(lifted), 2048)])
    order = np.argsort(np.argsort(index.distances(asked), axis=1, kind="stable"), axis=1, kind="stable")
    score = x[:FIT_QUERIES] @ x.T
    score[np.arange(len(score)), np.arange(len(score))] = -np.inf
    best = np.argsort(-score, axis=1)[:, : min(k, len(x) - 1)]
    ranks = np.sort(np.take_along_axis(order, near[best], axis=1).ravel())  # the probe that finds each true neighbour
    index.probes = int(ranks[min(len(ranks) - 1, int(np.ceil(AIM * len(ranks))))]) + 1 if len(ranks) else 1
    return index


def _stack(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _place(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for b in batches:
        d = index.distances(index.lifted(_stack(b.column(3), index.dim)))
        at = d.argmin(1)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(at)), at].astype(np.float64))], names=["row", "vec_id", "m", "v", "list", "far"])


def _probe(batches: Iterator[pa.RecordBatch], index: Index, radius: np.ndarray, sizes: np.ndarray, first: bool, k: int, only_lists: bool) -> Iterator[pa.RecordBatch]:
    """A row for each query and list. First: the nearest list. Then the next ones, but for those that lie beyond the k-th best."""
    for b in batches:
        d = index.distances(index.lifted(_stack(b.column(1), index.dim), True))
        order = np.argsort(d, axis=1, kind="stable")
        held = np.cumsum(sizes[order], axis=1)
        wanted = np.arange(order.shape[1])[None, :] < np.maximum(index.probes, 1 + (held < 4 * k).sum(1))[:, None]
        bound = np.asarray(b.column(2), np.float64) if not first else np.full(len(d), np.inf)
        wanted &= (np.take_along_axis(d, order, 1) - radius[order] <= bound[:, None] + 1e-5) & (sizes[order] > 0)
        wanted[:, 0] = first & (sizes[order[:, 0]] > 0)
        if first:
            wanted[:, 1:] = False
        at, rank = np.nonzero(wanted)
        lists = order[at, rank].astype(np.int32)
        if only_lists:
            found, n = np.unique(lists, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["list", "n"])
        else:
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(bound[at]), pa.array(lists)], names=["query", "q", "bound", "list"])


def scan(own: np.ndarray, x: np.ndarray, q: np.ndarray, bound: np.ndarray, index: Index, k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of a list's vectors for each query: (row of q, row of x, score).

    own is the row of x that a query must not find, or -1; ids break ties. A query abandons candidates by their partial
    distances from the moment that its limit is finite: bound, if that is, or the distance of its k-th best so far.
    """
    lx, lq, dims = index.lifted(x), index.lifted(q, True), index.dim + 1
    best: list = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    tau = bound.copy()
    for a in range(0, len(x), STEP):
        part = lx[a : a + STEP]
        whole = np.zeros((len(q), len(part)), np.float32)
        mine = np.flatnonzero((own >= a) & (own < a + len(part)))
        i = j = partial_sum = None
        for at in range(0, dims, BLOCK):
            end = min(dims, at + BLOCK)
            slack = (1 + SLACK / np.sqrt(end)) ** 2 if end < dims else 1 + 1e-4
            limit = tau**2 * slack * end / dims + 1e-6
            if i is None:
                bx, bq = part[:, at:end], lq[:, at:end]
                whole += (bq**2).sum(1)[:, None] + (bx**2).sum(1)[None, :] - 2 * bq @ bx.T
                whole[mine, own[mine] - a] = np.inf
                if end == dims and len(part) > k:  # no more than the k nearest of a stretch can count, and their ties
                    limit = np.minimum(limit, np.partition(whole, k - 1, axis=1)[:, k - 1] * (1 + 1e-4) + 1e-6)
                live = whole <= limit.astype(np.float32)[:, None]
                if end == dims or np.count_nonzero(live) <= SPARSE * live.size:
                    i, j = np.nonzero(live & np.isfinite(whole))
                    partial_sum = whole[i, j]
                else:
                    whole[~live] = np.inf
            else:
                partial_sum = partial_sum + ((part[j, at:end] - lq[i, at:end]) ** 2).sum(1)
                live = partial_sum <= limit[i]
                i, j, partial_sum = i[live], j[live], partial_sum[live]
        j = a + j
        score = np.empty(len(i))
        for c in range(0, len(i), 1 << 16):
            score[c : c + (1 << 16)] = (q[i[c : c + (1 << 16)]] * x[j[c : c + (1 << 16)]]).sum(1)
        best = [np.concatenate(z) for z in zip(best, (i, j, score), strict=True)]
        order = np.lexsort((ids[best[1]], -best[2], best[0]))
        best = [z[order] for z in best]
        top = np.arange(len(best[0])) - np.searchsorted(best[0], best[0]) < k
        best = [z[top] for z in best]
        full = np.flatnonzero(np.arange(len(best[0])) - np.searchsorted(best[0], best[0]) == k - 1)
        # |q'|^2 + 1 - 2 q'x' is the squared distance of the lifted vectors.
        norms = ((q[best[0][full]] / index.norm) ** 2).sum(1)
        reach = np.sqrt(np.maximum(norms + 1 - 2 * best[2][full] / index.norm**2, 0))
        tau[best[0][full]] = np.minimum(tau[best[0][full]], reach)
    return best[0], best[1], best[2]


FOUND = "query long, row long, vec_id long, copies long, score double"


def _tile(candidates: pa.Table, queries: pa.Table, index: Index, k: int) -> pa.Table:
    names, out = ["query", "row", "vec_id", "copies", "score"], [[] for _ in range(5)]
    if len(candidates) and len(queries):
        rows, ids, m = (candidates[n].to_numpy() for n in ("row", "vec_id", "m"))
        x, order = _stack(candidates["v"].combine_chunks(), index.dim), np.argsort(rows)
        for a in range(0, len(queries), 512):
            some = queries.slice(a, 512)
            asked = some["query"].to_numpy()
            at = order[np.minimum(np.searchsorted(rows[order], asked), len(rows) - 1)]
            # A query's own row counts no more; further copies of it are candidates.
            own = np.where((rows[at] == asked) & (m[at] == 1), at, -1)
            i, j, score = scan(own, x, _stack(some["q"].combine_chunks(), index.dim), some["bound"].to_numpy(), index, k, ids)
            for held, found in zip(out, (asked[i], rows[j], ids[j], m[j] - (rows[j] == asked[i]), score), strict=True):
                held.append(found)
    return pa.table({n: np.concatenate(held) if held else np.empty(0, np.float64 if n == "score" else np.int64) for n, held in zip(names, out, strict=True)})


def search(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every`, the k nearest others found.

    vectors has vec_id and embedding. Nearest first by inner product, ties to the smaller vec_id; all others, if there are
    fewer than k. Every row but the query's own is a candidate, those of its vec_id and equal ones too; equal rows are
    searched once and listed as often as they are there. Vectors that are null, empty or zero, hold a null or non-finite
    component or haven't the most frequent dimension (the larger on a tie), and rows without vec_id, take no part.
    Other columns are ignored. No usable vectors, or only one: no rows.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    kind = "array<float>" if dict(vectors.dtypes).get("embedding") == "array<float>" else "array<double>"  # as narrow as they came
    rows = with_columns_of(vectors, ["vec_id", "embedding"]).select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind).alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v"))).groupBy("vec_id", "v").agg(F.count("*").alias("m"))
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "m", "v"))
    own = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    norm = F.sqrt(own)
    dims = rows.groupBy(F.size("v").alias("dim")).agg(F.sum("m").alias("n"), F.count("*").alias("units"), F.max(norm).alias("norm")).orderBy(F.desc("n"), F.desc("dim")).first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == dims["dim"])
    index = fit(rows, dims["units"], dims["dim"], dims["norm"], k)
    placed = cut(rows.mapInArrow(partial(_place, index=index), f"row long, vec_id long, m long, v {kind}, list int, far double"))
    radius, sizes = np.zeros(len(index.centroids)), np.zeros(len(index.centroids), np.int64)
    for r in placed.groupBy("list").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():  # as many as lists, sqrt(count)
        radius[r["list"]], sizes[r["list"]] = r["far"], r["n"]
    queries = rows.where(F.col("vec_id") % every == 0).select("row", "vec_id", "m", "v")

    def pass_over(asked: DataFrame, first: bool) -> DataFrame:
        probe = partial(_probe, index=index, radius=radius, sizes=sizes, first=first, k=k)
        counted = asked.mapInArrow(partial(probe, only_lists=True), "list int, n long").groupBy("list").agg(F.sum("n").alias("n"))
        probes = {r["list"]: r["n"] for r in counted.collect()}  # as many as lists
        routed = asked.mapInArrow(partial(probe, only_lists=False), f"query long, q {kind}, bound double, list int")
        # Of a list beyond TILE vectors or queries, each chunk of these meets each block of those in a task of its own.
        parts = [(n, max(1, -(-int(sizes[n]) // TILE)), max(1, -(-c // TILE))) for n, c in probes.items()]
        dealt = lambda df: df.join(F.broadcast(spark.createDataFrame(parts, "list int, chunks long, blocks long")), "list")
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        asking = dealt(routed).withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks"))).withColumn("chunk", each("chunks"))
        held = dealt(placed).withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks"))).withColumn("block", each("blocks"))
        key = ["list", "chunk", "block"]
        return held.groupBy(*key).cogroup(asking.groupBy(*key)).applyInArrow(lambda x, y: _tile(x, y, index, k), FOUND)

    order = "over (partition by query order by score desc, vec_id, row)"
    top = lambda df: df.withColumn("rank", F.expr(f"row_number() {order}")).where(F.col("rank") <= k)
    near = cut(top(pass_over(queries.select("row", "v"), True)))
    worst = near.where(F.col("rank") == k).select("query", F.col("score").alias("kth"))
    reach = F.sqrt(F.greatest(F.lit(0.0), own / index.norm**2 + 1 - 2 * F.col("kth") / index.norm**2))
    asked = cut(queries.join(worst, queries["row"] == worst["query"], "left").select("row", "v", F.when(F.col("kth").isNull(), F.lit(float("inf"))).otherwise(reach).alias("bound")))
    found = top(near.drop("rank").union(pass_over(asked, False))).withColumn("before", F.expr(f"sum(copies) {order} - copies")).where(F.col("before") < k)
    asked = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("m").alias("times"))
    listed = found.join(asked, "query").withColumn("n", F.explode(F.expr(f"sequence(1L, least(copies, {k} - before))")))
    listed = listed.withColumn("__c", F.explode(F.expr("sequence(0L, (times - 1) div 4096)"))).withColumn("__t", F.explode(F.expr("sequence(1L, least(4096L, times - 4096 * __c))")))
    return listed.select("query_id", (F.col("before") + F.col("n")).cast("int").alias("rank"), "vec_id", "score")
