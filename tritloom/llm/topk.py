"""Exact top-k by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Candidates are taken in blocks of ``BLOCK`` rows. A block keeps, for every dimension, its rows sorted by that
component. A query walks all lists at once, from the top where its own component is positive and from the bottom where
it is negative (sorted access), works out the whole score of each row it meets for the first time (random access), and
stops as soon as the threshold, the score that a row at the current depth of all lists would have, is below its k-th
score so far, or all rows have been met. The k-th score is carried from block to block of a task. A threshold equal to the k-th score does not
stop the walk, for an unseen row of that score may have a smaller id.

Queries are a stated set. They are counted and cut into passes of at most about ``QUERIES`` rows, each broadcast in a
pass of its own over all candidates; a pass gives k rows for each query and task, and a window keeps the k best. Of
several passes each is finished, and its rows written to the shared folder, before the next one's queries are gathered.

Defined results: vectors that are null or hold null or non-finite components, or whose id is null, take no part; an
empty vector scores zero with other empty vectors; vectors of different lengths do not meet. Scores are exact while
they are below 2**53. Equal scores go to the smaller id. A query that occurs twice gets its result twice. Candidates
with the query's own id are left out. Empty tables give an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, table, written

BLOCK, QUERIES, K = 16384, 16384, 20
SCHEMA = "q int, query_id bigint, vec_id bigint, score bigint"


class SortedBlock:
    """Rows of equal length with their per-dimension lists."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        most = np.abs(rows).max(initial=0)
        #: Sums of integers below 2**24 are exact in single precision too.
        self.ids, self.rows = ids, rows.astype(np.float32 if most * most * rows.shape[1] < 1 << 24 else np.float64)
        order = np.argsort(rows, axis=0, kind="stable")
        self.sorted = np.take_along_axis(rows, order, axis=0)
        self.tops, self.bottoms = np.ascontiguousarray(order[::-1].T), np.ascontiguousarray(order.T)
        self.mark = np.zeros(len(ids), dtype=bool)
        self.first = max(8, len(ids) // 256)

    def search(self, query: np.ndarray, own: int, best_score: np.ndarray, best_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of (best_score, best_id), which are sorted, and this block."""
        n, mark = len(self.ids), self.mark
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = np.zeros(n, dtype=bool)
        single = query.astype(self.rows.dtype) if np.abs(query).max(initial=0) ** 2 * len(query) < 1 << 24 else query.astype(np.float64)
        depth, step, met = 0, self.first, 0
        if not len(up) and not len(down):  # every list is at its end: all scores are zero
            depth, step = 0, n
        while depth < n:
            to = min(n, depth + step)
            mark[:] = False
            mark[self.tops[up, depth:to].ravel()] = True
            mark[self.bottoms[down, depth:to].ravel()] = True
            if not len(up) and not len(down):
                mark[:] = True
            new = np.flatnonzero(mark & ~seen)
            seen |= mark
            met += len(new)
            score = (self.rows @ single if len(new) == n else np.take(self.rows, new, axis=0) @ single).astype(np.float64)
            full = len(best_id) >= k
            good = self.ids[new] != own
            if full:
                good &= score >= best_score[-1]
            if good.any():
                score = np.concatenate((best_score, score[good]))
                ids = np.concatenate((best_id, self.ids[new[good]]))
                if len(score) > 4 * k:
                    least = np.partition(score, len(score) - k)[len(score) - k]
                    near = score >= least
                    score, ids = score[near], ids[near]
                top = np.lexsort((ids, -score))[:k]
                best_score, best_id = score[top], ids[top]
            depth, step = to, step * 2
            if met == n:  # no row is left to meet
                break
            if len(best_id) >= k:
                bound = self.sorted[n - to][up] @ query[up] + self.sorted[to - 1][down] @ query[down]
                if bound < best_score[-1]:
                    break
        return best_score, best_id


def _search(shared, k: int, block: int):
    schema = pa.schema([("q", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        queries = [(i, v) for i, v in shared.value]
        best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in queries]
        held: dict[int, tuple[list, list]] = {}

        def flush(length: int) -> None:
            ids, rows = held.pop(length)
            built = SortedBlock(np.concatenate(ids), np.concatenate(rows))
            for q, (own, query) in enumerate(queries):
                if len(query) == length:
                    best[q] = built.search(query, own, *best[q], k)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                rows = flat[starts[at][:, None] + np.arange(length)].astype(np.float64)
                for lo in range(0, len(at), block):
                    mine = held.setdefault(length, ([], []))
                    mine[0].append(ids[at[lo : lo + block]])
                    mine[1].append(rows[lo : lo + block])
                    if sum(map(len, mine[0])) >= block:
                        flush(length)
        for length in list(held):
            flush(length)
        for lo in range(0, len(queries), 512):
            part = range(lo, min(lo + 512, len(queries)))
            n = [len(best[q][1]) for q in part]
            if sum(n):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array(part, np.int32), n)), pa.array(np.repeat(np.array([queries[q][0] for q in part], np.int64), n)), pa.array(np.concatenate([best[q][1] for q in part])), pa.array(np.concatenate([best[q][0] for q in part]).astype(np.int64))],
                    schema=schema,
                )

    return run


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = K, block: int = BLOCK, per_pass: int = QUERIES) -> DataFrame:
    """vectors and queries: vec_id bigint, v array<bigint>. Returns query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    vectors, queries = (x.select("vec_id", "v").where("vec_id is not null and v is not null") for x in (vectors, queries))
    ship(spark)
    passes = max(1, -(-queries.count() // per_pass))
    found = None
    for p in range(passes):
        part = queries.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(passes)) == p) if passes > 1 else queries
        rows = sorted((r["vec_id"], list(r["v"])) for r in part.collect())  # a pass of a stated set, of bounded size
        shared = spark.sparkContext.broadcast([(i, np.array(v, dtype=np.float64)) for i, v in rows])
        one = vectors.mapInArrow(_search(shared, k, block), SCHEMA)
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
        one = one.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if passes > 1:
            one, _ = written(one, "topk")
            shared.destroy()
        found = one if found is None else found.unionByName(one)
    return found


def quantised(embeddings: DataFrame, *, scale: int = 64) -> DataFrame:
    """vec_id and v: floor(scale * x) of every component; vectors with null or non-finite components are left out."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    fine = F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True))
    return embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.when(fine, F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c))).alias("v")).where("v is not null")


def op1(spark, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
