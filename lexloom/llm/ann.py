"""Approximate nearest neighbours by collision counting (query-aware hashing).

The rows are dealt over index shards.  A shard keeps, for each of several random directions, its rows in the
order of their projections: one sorted array for each.  A query opens a window around its own projection in
each array; a row in the window collides with it.  Virtual rehashing widens all windows by one width after
the other.  Only the places that a widening adds are read: their rows collide from then on, and a row's
count is its collisions in all arrays at all widths so far.  Rows whose count reaches the threshold, a share
of the collisions possible so far, are candidates; once there are enough of them the highest counts are verified by their
exact inner products.  Directions come in orthonormal bases, so that one basis already sees all of a
difference.  Largest inner product becomes smallest distance by one more coordinate that lifts all rows to
one norm.  Each shard's best come together by query; every row is indexed, every query meets every shard
(a stated query set against all rows, in blocks).

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a
null id, take no part; vectors of different lengths never meet; a query's own id is no candidate; rows
that repeat a query's id and vector are one query; fewer candidates than k give fewer rows; ties go to the
smaller id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import batch_of, partitions, table

NEIGHBOURS = 20
#: Orthonormal bases of directions.
BASES = 1
#: Share of the collisions possible so far that makes a candidate.
THRESHOLD = 0.65
#: The windows widen until k times the one and the other's share of a shard's rows are candidates; as many are verified.
VERIFIED_TIMES, VERIFIED_SHARE = 10, 0.02
#: Half a window's first width, and what each widening adds, as a share of the rows' norm.
WIDTH = 0.3
SHARD_ROWS = 65_535
LEAST_SHARD = 16_384
#: Queries whose windows are found together.
QUERY_BLOCK = 32


class Shard:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bases: int = BASES, seed: int = 3):
        self.ids, self.vectors = ids, vectors
        norms = np.linalg.norm(vectors, axis=1)
        self.norm = float(norms.max())
        lift = np.sqrt(np.maximum(0, self.norm**2 - norms**2))
        rng, dim = np.random.default_rng(seed), vectors.shape[1] + 1
        self.directions = np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] * dim**0.5 for _ in range(bases)], axis=1)
        lines = np.c_[vectors, lift] @ self.directions
        order = np.argsort(lines, axis=0, kind="stable")
        self.values = np.ascontiguousarray(np.take_along_axis(lines, order, 0).T)
        self.order = np.ascontiguousarray(order.T.astype(np.uint16 if len(ids) <= 1 << 16 else np.uint32))
        self.verified = 0

    def candidates(self, queries: np.ndarray, wanted: int) -> Iterator[np.ndarray]:
        """Of each query the rows whose collisions reach the threshold, highest counts first, at the first width where there are `wanted` of them, or where the windows hold all rows."""
        n, m = len(self.ids), len(self.order)
        centre = (queries * (self.norm / np.linalg.norm(queries, axis=1))[:, None]) @ self.directions[:-1]
        found: list[np.ndarray | None] = [None] * len(queries)
        middle = np.stack([np.searchsorted(self.values[j], centre[:, j]) for j in range(m)], axis=1)
        lo, hi = middle, middle.copy()
        inside = np.zeros((len(queries), n), np.uint16 if m < 1 << 16 else np.uint32)
        counts = np.zeros((len(queries), n), np.uint32)
        open_, step = np.arange(len(queries)), 0
        while len(open_):
            step += 1
            half = step * WIDTH * self.norm
            new_lo = np.stack([np.searchsorted(self.values[j], centre[open_, j] - half) for j in range(m)], axis=1)
            new_hi = np.stack([np.searchsorted(self.values[j], centre[open_, j] + half, side="right") for j in range(m)], axis=1)
            everything = (new_lo == 0).all(axis=1) & (new_hi == n).all(axis=1)
            for q, below, above, whole in zip(open_.tolist(), new_lo.tolist(), new_hi.tolist(), everything):
                # What entered the windows: a stretch below and one above in each array.
                entered = [self.order[j, a:b] for j, (a, b) in enumerate(zip(below, lo[q].tolist()))]
                entered += [self.order[j, a:b] for j, (a, b) in enumerate(zip(hi[q].tolist(), above))]
                inside[q] += np.bincount(np.concatenate(entered), minlength=n).astype(inside.dtype)
                counts[q] += inside[q]
                hits = np.arange(n) if whole else np.flatnonzero(counts[q] >= math.ceil(THRESHOLD * m * step))
                if len(hits) > wanted:
                    # The highest counts first; rows that tie with the last of them are verified too.
                    count = counts[q, hits]
                    hits = hits[count >= np.partition(count, len(hits) - wanted)[len(hits) - wanted]]
                if len(hits) >= wanted or whole:
                    found[q] = hits
            lo[open_], hi[open_] = new_lo, new_hi
            open_ = np.array([q for q in open_ if found[q] is None], np.int64)
        yield from found

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and exact scores of the k best verified candidates of each query."""
        wanted = VERIFIED_TIMES * k + math.ceil(VERIFIED_SHARE * len(self.ids))
        for query_id, query, rows in zip(query_ids, queries, self.candidates(queries, wanted)):
            rows = rows[self.ids[rows] != query_id]
            self.verified += len(rows)
            scores = (self.vectors[rows] * query).sum(axis=1)
            if len(rows) > k:
                on = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                rows, scores = rows[on], scores[on]
            best = np.lexsort((self.ids[rows], -scores))[:k]
            yield self.ids[rows][best], scores[best]


def _search(batches: Iterator[pa.RecordBatch], k: int, bases: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, dim, is_query, id, vector): a shard's rows come before its queries."""
    schema = pa.schema([("query_id", pa.int64()), ("query_hash", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    now, ids, vectors, index = None, [], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        shard, dim, is_query, vec = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "dim", "is_query", "vec_id"))
        digest = batch.column("query_hash").to_numpy(zero_copy_only=False)
        flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        place = np.r_[0, np.cumsum(dim)]
        change = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (dim[1:] != dim[:-1]) | (is_query[1:] != is_query[:-1])])
        out: list[tuple] = []
        for a, b in zip(change, np.r_[change[1:], batch.num_rows]):
            rows = flat[place[a] : place[b]].reshape(b - a, dim[a])
            if now != (shard[a], dim[a]):
                now, ids, vectors, index = (shard[a], dim[a]), [], [], None
            if not is_query[a]:
                ids.append(vec[a:b].astype(np.int64))
                vectors.append(rows)
                continue
            if index is None and ids:
                index = Shard(np.concatenate(ids), np.concatenate(vectors), bases)
            if index is not None:
                for at in range(a, b, QUERY_BLOCK):
                    upto = min(b, at + QUERY_BLOCK)
                    for i, (found, scores) in zip(range(at, upto), index.search(vec[at:upto], rows[at - a : upto - a], k)):
                        out.append((np.full(len(found), vec[i]), np.full(len(found), digest[i]), found, scores))
        if out:
            yield batch_of(dict(zip(schema.names, map(np.concatenate, zip(*out)))), schema)


def nearest(vectors: DataFrame, is_query, k: int = NEIGHBOURS, bases: int = BASES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found rows of each row of vectors(vec_id, embedding) where the condition `is_query` holds."""
    spark = vectors.sparkSession
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    x = x.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(fine, F.lit(False)))
    n = x.count()
    shards = max(1, math.ceil(n / shard_rows), min(partitions(spark), math.ceil(n / LEAST_SHARD)))
    dim = F.size("vector").cast("long").alias("dim")
    rows = x.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("long").alias("shard"), dim, F.lit(False).alias("is_query"), "vec_id", F.lit(0).cast("long").alias("query_hash"), "vector"
    )
    queries = x.where(is_query).dropDuplicates(["vec_id", "vector"])
    asked = queries.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), dim, F.lit(True).alias("is_query"), "vec_id", F.xxhash64("vector").alias("query_hash"), "vector"
    )
    dealt = rows.unionByName(asked).repartition(max(partitions(spark), shards), "shard", "dim").sortWithinPartitions("shard", "dim", "is_query", "vec_id", "query_hash")
    found = dealt.mapInArrow(functools.partial(_search, k=k, bases=bases), "query_id long, query_hash long, vec_id long, score double")
    by_query = W.Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
