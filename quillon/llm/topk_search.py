"""Exact top-k search by distributed histogram selection.

Queries come in blocks of a bounded number; a block's matrix travels to all
tasks, and every candidate is scored against it, in slices, by matrix products.
Scores are integers. A pass counts, for each query, the scores in each of
``BINS`` equal bins of the interval that holds the query's kth value; the summed
histogram tells in which bin that value lies, and the next pass refines that bin,
until a bin is one value wide. A task reports only the bins down to its own kth
score, as lower ones cannot hold the global one. The last pass keeps the scores
over the kth value and, of those equal to it, the smallest vec_ids that can still
be needed, so equal vectors by the million cost a task a few rows. Of more than
``PLAN_BLOCKS`` blocks each one's answers, k rows a query, are written to the shared
folder when it is done: a lost executor costs one block, and plans stay small.

Defined cases: vectors that are null, empty or hold null or non-finite components
take no part, nor do rows without vec_id; vectors of different lengths have no
score; of several query rows of one vec_id the smallest vector is the query, and
candidates of that vec_id are the query's own; repeated candidates are candidates
each; with fewer candidates than k all of them are returned. Extra columns are
ignored. The products are exact while 1024 times any component, squared and summed
over a vector, stays under 2**53; larger vectors are refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir

SCALE = 1024
TOP = 10
BINS = 1024
QUERY_BLOCK = 4096
_SLICE = 256
#: With more blocks than this, each block's answers are written as soon as it is searched, so that the plan does not grow with the queries.
PLAN_BLOCKS = 4


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and q, the components as floor(1024 * x), of the rows that take part."""
    double = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists(double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad)
    return fine.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(double, lambda x: F.floor(x * SCALE).cast("double")).alias("q"))


def _matrices(batch: pa.RecordBatch):
    """(vec_ids, matrix) of each vector length in a batch, in slices."""
    ids, column = batch.column("vec_id").to_numpy(), batch.column("q")
    flat, offsets = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
    lengths = np.diff(offsets)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        for i in range(0, len(rows), _SLICE):
            part = rows[i : i + _SLICE]
            yield int(n), ids[part], flat[offsets[part][:, None] + np.arange(n)]


class Block:
    """Queries of one block, by vector length."""

    def __init__(self, rows: list):
        self.parts = {}
        for n in sorted({len(r["q"]) for r in rows}):
            mine = sorted((r["vec_id"], r["q"]) for r in rows if len(r["q"]) == n)
            self.parts[n] = (np.array([i for i, _ in mine]), np.array([q for _, q in mine]))
        self.ids = np.concatenate([ids for ids, _ in self.parts.values()])
        self.start = dict(zip(self.parts, np.cumsum([0, *(len(ids) for ids, _ in self.parts.values())]).tolist(), strict=False))

    def scores(self, batch: pa.RecordBatch):
        """(first query, candidates' ids, integer scores, whether they count) for each slice."""
        for n, ids, matrix in _matrices(batch):
            if n in self.parts:
                queries, held = self.parts[n]
                yield self.start[n], ids, (held @ matrix.T).astype(np.int64), queries[:, None] != ids[None, :]


def _count(block: Block, low: np.ndarray, span: int, width: int, need: np.ndarray):
    """A pass: counts of the bins of [low, low + span) that a task's own top scores reach."""

    def run(batches):
        counts = np.zeros((len(low), BINS), np.int64)
        for batch in batches:
            for first, _, scores, counted in block.scores(batch):
                n = len(scores)
                above = scores - low[first : first + n, None]
                at = above // width
                row, column = np.nonzero(counted & (above >= 0) & (above < span))
                counts[first : first + n] += np.bincount(row * BINS + at[row, column], minlength=n * BINS).reshape(n, BINS)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts  # scores in higher bins
        row, column = np.nonzero((counts > 0) & (above < need[:, None]))
        yield pa.record_batch({"query": pa.array(row.astype(np.int32)), "bin": pa.array(column.astype(np.int32)), "n": pa.array(counts[row, column])})

    return run


def _select(block: Block, kth: np.ndarray, need: np.ndarray):
    """The last pass: what is over the kth value, and the smallest ids among what is equal to it."""

    def run(batches):
        query, ids, score = (np.zeros(0, np.int64) for _ in range(3))
        for batch in batches:
            for first, found, scores, counted in block.scores(batch):
                row, column = np.nonzero(counted & (scores >= kth[first : first + len(scores), None]))
                query = np.concatenate((query, row + first))
                ids = np.concatenate((ids, found[column]))
                score = np.concatenate((score, scores[row, column]))
                order = np.lexsort((ids, -score, query))
                query, ids, score = query[order], ids[order], score[order]
                edge = np.flatnonzero(np.diff(query, prepend=-1))
                place = np.arange(len(query)) - np.repeat(edge, np.diff(np.append(edge, len(query))))
                keep = place < need[query]
                query, ids, score = query[keep], ids[keep], score[keep]
        yield pa.record_batch({"query_id": pa.array(block.ids[query]), "vec_id": pa.array(ids), "score": pa.array(score)})

    return run


def _search(rows: DataFrame, block: Block, k: int, bound: int) -> DataFrame:
    n = len(block.ids)
    low, need, span = np.full(n, -bound), np.full(n, k), 2 * bound + 1
    alive = np.ones(n, bool)  # has at least k candidates
    while span > 1:
        width = -(-span // BINS)
        counts = rows.mapInArrow(_count(block, low, span, width, need), "query int, bin int, n bigint").groupBy("query", "bin").agg(F.sum("n").alias("n"))
        over = Window.partitionBy("query").orderBy(F.desc("bin"))
        needs = rows.sparkSession.createDataFrame([(i, int(c)) for i, c in enumerate(need)], "query int, need int")
        upto = counts.withColumn("upto", F.sum("n").over(over)).join(F.broadcast(needs), "query")  # QUERY_BLOCK rows
        held = upto.where("upto >= need").groupBy("query").agg(F.max_by(F.struct("bin", "n", "upto"), "bin").alias("b")).select("query", "b.*")
        found = {r["query"]: r for r in held.collect()}  # a row for each query of the block
        for i in range(n):
            if alive[i] and i in found:
                r = found[i]
                low[i] += r["bin"] * width
                need[i] -= r["upto"] - r["n"]
            else:
                alive[i] = False
        span = width
    kth = np.where(alive, low, -bound)
    return rows.mapInArrow(_select(block, kth, np.full(n, k)), "query_id bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, query_filter: str, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest scores of each query; vectors: vec_id, embedding."""
    rows = usable(vectors)
    stats = rows.agg(F.max(F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")).first()
    bound = int(stats["norm"] or 0) + 1
    if bound >= 2**53:
        raise ValueError("components too large for exact products")
    queries = rows.where(query_filter).groupBy("vec_id").agg(F.min("q").alias("q"))
    blocks = -(-queries.count() // QUERY_BLOCK)
    out = rows.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0).cast("bigint").alias("score")).limit(0)
    path = f"{shared_dir(rows.sparkSession).rstrip('/')}/quillon-top-k-{uuid.uuid4().hex}" if blocks > PLAN_BLOCKS else None
    for b in range(blocks):
        # the hash deals about QUERY_BLOCK queries to each block
        held = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        if not held:
            continue
        answers = _search(rows, Block(held), k, bound)
        if path:
            best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
            answers.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank").write.mode("append").parquet(path)
        else:
            out = out.unionByName(answers)
    if path:
        out = rows.sparkSession.read.schema(out.schema).parquet(path)
    over = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 100 = 0")


QUERIES: dict[str, Callable] = {"op3_topk_search": op3_topk_search}
ORACLE = {
    "op3_topk_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 10""",
}
