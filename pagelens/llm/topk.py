"""Exact top-k search by the threshold algorithm over sorted per-dimension lists.

Rows are dealt evenly to shards of bounded size and queries to blocks; each pair of a block and a shard is one task. A
shard keeps, for each dimension, its rows in order of their value. A query reads these lists in parallel, from the end
that raises its score, and scores every row it meets. The sum of the values reached bounds all rows not met; reading
stops when that is less than the kth score. The shards' answers are merged by score and id.

Defined cases: vectors that are null or empty, or hold null or non-finite components, take no part; vectors meet only
vectors of their length; ties go to the smaller vec_id; a row that repeats is a candidate each time; of query rows that
share a vec_id the least vector asks; a null vec_id neither asks nor is found; scores are exact below 2**53, of components
too large for that not; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 10
SHARD_ROWS = 1 << 14
BLOCK_QUERIES = 1 << 13


def quantised(rows: DataFrame, scale: float = 1024.0) -> DataFrame:
    """(vec_id, v) with v the floor of scale times each component, of the vectors that take part."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    used = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(ok)
    return used.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("vec_id").to_numpy()
    flat = table.column("v").combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return ids, flat.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(np.float64)


class Shard:
    """Rows with their sorted lists. Scores are of integers, exact in float64 while below 2**53."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.lists = np.argsort(self.rows, axis=0, kind="stable").T.astype(np.int32).copy()  # by dimension, ascending

    def search(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best rows whose id isn't own; ties to smaller ids."""
        n = len(self.ids)
        used = np.flatnonzero(q)
        up = q[used] > 0
        seen = np.zeros(n, bool)
        seen[np.searchsorted(self.ids, own, "left") : np.searchsorted(self.ids, own, "right")] = True
        best, score, depth, step = np.empty(0, np.int64), np.empty(0), 0, max(8, k)
        while depth < n and len(used):
            stop = min(n, depth + step)
            met = np.concatenate([self.lists[used[~up], depth:stop].ravel(), self.lists[used[up], n - stop : n - depth].ravel()])
            fresh = np.zeros(n, bool)
            fresh[met] = True
            new = np.flatnonzero(fresh & ~seen)
            seen |= fresh
            best, score = np.concatenate([best, new]), np.concatenate([score, self.rows[new] @ q])
            if len(best) > k:
                top = np.lexsort((best, -score))[:k]
                best, score = best[top], score[top]
            at = np.where(up, n - stop, stop - 1)
            bound = q[used] @ self.rows[self.lists[used, at], used]
            if len(best) == k and score.min() > bound:
                break
            depth, step = stop, step * 2
        else:
            if not len(used):  # a query of zeros scores 0 everywhere
                best = np.flatnonzero(~seen)[:k]
                score = np.zeros(len(best))
        top = np.lexsort((best, -score))
        return best[top], score[top]


def _search(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = [(np.empty(0, np.int64),) * 3]
        if len(queries) and len(rows):
            shard = Shard(*_matrix(rows))
            for own, q in zip(*_matrix(queries)):
                at, score = shard.search(own, q, k)
                out.append((np.full(len(at), own), shard.ids[at], score.astype(np.int64)))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))

    return run


def top_k(queries: DataFrame, rows: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of queries and rows (vec_id, v array<bigint>)."""
    shards, blocks = (max(1, -(-df.count() // n)) for df, n in ((rows, shard_rows), (queries, block_queries)))
    each = lambda n, other: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(other)
    dealt = lambda n: F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
    asked = queries.select("vec_id", "v", F.size("v").alias("dim"), dealt(blocks).alias("block")).select("*", each(shards, "shard"))
    kept = rows.select("vec_id", "v", F.size("v").alias("dim"), dealt(shards).alias("shard")).select("*", each(blocks, "block"))
    keys = ("dim", "block", "shard")
    found = asked.groupBy(*keys).cogroup(kept.groupBy(*keys)).applyInArrow(_search(k), "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk_search(spark, sf_dir: str) -> DataFrame:
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    queries = rows.where("vec_id % 100 = 0").groupBy("vec_id").agg(F.min("v").alias("v"))
    return top_k(queries, rows)


OP5_SQL = """
WITH r AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_dot_product(q.v, r.v) AS BIGINT) AS score
  FROM r q JOIN r ON q.vec_id % 100 = 0 AND r.vec_id <> q.vec_id AND len(r.v) = len(q.v)
), t AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 10
"""
