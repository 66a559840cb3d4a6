"""Exact top-k inner products of norm-sorted integer vectors.

Each vector becomes floor(scale * x). The second moment matrix (d x d, summed over all rows) gives the rotation of its singular vectors, so
that few rotated components hold most of each product. Candidates are taken by descending length in slices; each slice starts from the
k-th best score that the longer ones have given. Within a slice, blocks are visited by descending length: a candidate whose length times
the query's is below the query's k-th best is skipped with all shorter ones, and a partial sum of HEAD rotated components plus the
product of the residual lengths (Cauchy-Schwarz) must reach it. What survives is scored in integers. Bounds carry a margin for rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table
from .vectors import matrix

HEAD = 16
#: Shares of the candidates, the longest first, that are searched before the rest.
SLICES = (1 / 64, 1 / 8)
#: Bytes of a block of queries that is broadcast; more queries take more passes.
QUERY_BYTES = 32 << 20
BLOCK = 512
#: Stands for no score; its negative is a long, too.
LEAST = -(2**63 - 1)
#: Bounds the components of rotations and partial sums. A vector with a larger one counts as endless there, so no bound skips it; its scores are exact all the same.
MOST = 2.0**62


def _lengths(x: np.ndarray) -> np.ndarray:
    """Length of each row; infinite with a component beyond MOST."""
    y = np.clip(x, -MOST, MOST)
    return np.where((np.abs(x) > MOST).any(1), np.inf, np.sqrt((y * y).sum(1)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        x = np.asarray(b.column(0).flatten(), np.float64).reshape(len(b), -1) if len(b) else np.zeros((0, 0))
        x = np.clip(x, -MOST, MOST)
        if len(x):
            sums[x.shape[1]] = sums.get(x.shape[1], 0) + x.T @ x
    for d, m in sums.items():
        i, j = np.indices((d, d))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(m.ravel())], ["i", "j", "m"])


def _integers(scale: int, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = matrix(b.column(1), dim)
            with np.errstate(over="ignore"):
                x = np.nan_to_num(np.floor(x * scale))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * dim), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), values, pa.array(_lengths(x))], ["vec_id", "v", "norm"])

    return run


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; those beyond a long become its ends (the lower one less LEAST)."""
    with np.errstate(over="ignore"):
        most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    if most < 2**62:
        return q.astype(np.int64) @ x.T.astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in r] for r in m], object).reshape(m.shape)
    return np.clip(whole(q) @ whole(x).T, LEAST + 1, 2**63 - 1).astype(np.int64)


def _best(k: int, shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """Candidates (any order) to each query's best scores of the partition that may be among its k best. shared: a broadcast of (rotation, ids, integers, k-th best so far)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, ids, q, floor = shared.value
        floor = np.nextafter(floor.astype(np.float64), -np.inf)  # not above the exact score
        nq = len(ids)
        head = np.clip(q, -MOST, MOST) @ turn[:, :HEAD]
        q_norm = _lengths(q)
        q_rest = np.sqrt(np.maximum(q_norm**2 - (head * head).sum(1), 0))
        best = np.full((nq, 0), 0, np.int64)
        best_id = np.full((nq, 0), 0, np.int64)
        for b in batches:
            if not len(b):
                continue
            names = np.asarray(b.column(0))
            x = np.asarray(b.column(1).flatten()).reshape(len(b), -1)
            norm = np.asarray(b.column(2))
            order = np.argsort(-norm, kind="stable")
            names, x, norm = names[order], x[order], norm[order]
            x_head = np.clip(x, -MOST, MOST) @ turn[:, :HEAD]
            x_rest = np.sqrt(np.maximum(norm**2 - (x_head * x_head).sum(1), 0))
            for s in range(0, len(x), BLOCK):
                part = slice(s, s + BLOCK)
                with np.errstate(invalid="ignore"):
                    longest = np.nan_to_num(q_norm * norm[s], nan=0.0, posinf=np.inf)  # a zero vector's products are zero
                slack = 1e-6 * (1 + longest)
                live = np.flatnonzero(longest + slack >= floor)
                if not len(live):
                    break  # all that follow are shorter
                with np.errstate(invalid="ignore"):
                    bound = head[live] @ x_head[part].T + q_rest[live, None] * x_rest[None, part] + slack[live, None]
                bound[np.isnan(bound)] = np.inf
                near = (bound >= floor[live, None]) & (ids[live, None] != names[None, part])
                hit, cols = near.any(1), near.any(0)
                if not hit.any():
                    continue
                rows, cols = live[hit], np.flatnonzero(cols)
                score = products(q[rows], x[part][cols])
                who = np.broadcast_to(names[part][cols], score.shape)
                use = near[hit][:, cols] & (score >= floor[rows, None])
                score, who = np.where(use, score, LEAST), np.where(use, who, np.iinfo(np.int64).max)
                score, who = np.concatenate((best[rows], score), 1), np.concatenate((best_id[rows], who), 1)
                pick = np.lexsort((who, -score), axis=1)[:, :k]
                score, who = np.take_along_axis(score, pick, 1), np.take_along_axis(who, pick, 1)
                if best.shape[1] < k:
                    grow = k - best.shape[1]
                    best = np.pad(best, ((0, 0), (0, grow)), constant_values=LEAST)
                    best_id = np.pad(best_id, ((0, 0), (0, grow)), constant_values=np.iinfo(np.int64).max)
                width = score.shape[1]
                best[rows, :width], best_id[rows, :width] = score, who
                if width == k:
                    floor[rows] = np.maximum(floor[rows], np.nextafter(score[:, k - 1].astype(np.float64), -np.inf))
        use = best != LEAST
        at = np.nonzero(use)[0]
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(best_id[use]), pa.array(best[use])], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, scale: int = 1024, every: int = 100, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """For each query, the k other rows with the highest integer inner products of floor(scale * x); ties go to the smaller id.

    queries: rows with the same two columns; if None, the rows of `vectors` whose id is divisible by `every`. Returns query_id, rank (from 1),
    vec_id, score. A row never answers a query of its own id, and repeated rows (same id and vector) answer once. Rows of one id with different
    vectors are candidates of their own, so an id may answer several times; as queries, such an id has the k best scores over its vectors. Vectors that are
    null, empty, hold null or non-finite components, have a null id, or another length than most take no part. Fewer than k
    candidates are all returned; zero vectors score 0. Other columns are not read. Without valid rows the result is empty.
    Scores are exact, whatever the components' size; those beyond a long count as its ends, scaled components beyond the largest double as that."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    vectors = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(value).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    sizes = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None or not sizes["d"]:
        return spark.createDataFrame([], schema)
    dim = sizes["d"]
    ready = table(vectors.mapInArrow(_integers(scale, dim), "vec_id long, v array<double>, norm double").distinct())
    asked = ready.where(F.col("vec_id") % every == 0) if queries is None else table(queries.select(F.col(key).cast("long").alias("vec_id"), F.col(value).cast("array<double>").alias("v")).where("vec_id is not null").mapInArrow(_integers(scale, dim), "vec_id long, v array<double>, norm double").distinct())
    moments = ready.select("v").mapInArrow(_moments, "i int, j int, m double").groupBy("i", "j").agg(F.sum("m").alias("m")).toPandas()
    if moments.empty:
        return spark.createDataFrame([], schema)
    gram = np.zeros((dim, dim))
    gram[moments["i"], moments["j"]] = moments["m"]
    turn = np.linalg.svd((gram + gram.T) / 2)[0]
    cuts = [float(x) for x in ready.approxQuantile("norm", [1 - s for s in SLICES], 0.002)]
    slices = [ready.where(F.col("norm") >= cuts[0]), *(ready.where((F.col("norm") >= low) & (F.col("norm") < high)) for low, high in zip(cuts[1:], cuts, strict=False)), ready.where(F.col("norm") < cuts[-1])]
    blocks = max(1, -(-asked.count() * dim * 8 // QUERY_BYTES))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    results = []
    for block in range(blocks):
        part: pd.DataFrame = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toPandas().sort_values("vec_id", kind="stable")
        if part.empty:
            continue
        ids, q = part["vec_id"].to_numpy(np.int64), np.stack(part["v"].to_numpy()).astype(np.float64)
        floor, have = np.full(len(ids), -np.inf), None
        for s in slices:
            found = s.mapInArrow(_best(k, spark.sparkContext.broadcast((turn, ids, q, floor))), "query_id long, vec_id long, score long")
            found = found if have is None else found.unionByName(have)
            have = table(found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).drop("rank"))
            low = have.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n")).where(F.col("n") >= k).toPandas().set_index("query_id")["low"]
            floor = np.array([low.get(i, -np.inf) for i in ids.tolist()], np.float64)
        results.append(have)
    if not results:
        return spark.createDataFrame([], schema)
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.withColumn("rank", F.row_number().over(last).cast("int")).select("query_id", "rank", "vec_id", "score")
