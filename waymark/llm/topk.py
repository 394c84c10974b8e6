"""Exact top-k search by term-at-a-time accumulation.

Vectors are sparse rows of whole numbers (component x becomes floor(scale * x)); a term is a dimension, and a block of candidates
has a posting list (row, weight) for each. A query takes its terms one after another and scatters its weight times the posting weights
into a dense array of scores for the block; a partition selection keeps the block's k best, and the bests of all blocks are merged.
Every candidate is scored against every query.

Queries are taken in passes of about `pass_queries` (a pass is a scan of the candidates; its queries, of that bounded size, go to all tasks), so that
memory depends neither on the number of queries nor on that of candidates.

Defined results: vectors that are null, or hold null or non-finite components, take no part. Ties go to the smaller identifier. Fewer than k candidates:
all of them. Vectors of different length are padded with zeros; an empty one has score 0 with all. A candidate never has its query's identifier; rows that repeat another identifier are
candidates each, and of queries that share one, the smallest vector asks. A null identifier takes no part. Scores are 64-bit integers: components
must be small enough for their products' sum to fit. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import shared_path

K, SCALE, PASS_QUERIES = 5, 256, 8192
CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 256
LEAST = np.iinfo(np.int64).min


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def dense(lists: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of a batch of vectors, padded with zeros."""
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    values = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    width = int(np.diff(ends).max(initial=0))
    out = np.zeros((len(lists), width), np.int64)
    row = np.repeat(np.arange(len(lists)), np.diff(ends))
    out[row, np.arange(len(values)) - ends[row]] = values
    return out


def accumulate(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Scores (queries, rows of the block), one term after another."""
    scores = np.zeros((len(queries), len(block)), np.int64)
    room = np.empty_like(scores)
    for term in range(min(queries.shape[1], block.shape[1])):
        rows, asking = np.flatnonzero(block[:, term]), np.flatnonzero(queries[:, term])
        if not len(rows) or not len(asking):
            continue
        if 2 * len(rows) >= len(block):  # a long posting list is as fast read whole
            np.multiply(queries[:, term, None], block[None, :, term], out=room)
            scores += room
        else:
            scores[np.ix_(asking, rows)] += queries[asking, term, None] * block[None, rows, term]
    return scores


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """A mask of each row's k largest, ties to the left."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k, None]
    above = scores > least
    tie = scores == least
    return above | (tie & (np.cumsum(tie, axis=1, dtype=np.int32) <= k - above.sum(1)[:, None]))


def search_pass(ids: np.ndarray, queries: np.ndarray, candidates: DataFrame, k: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    shared = candidates.sparkSession.sparkContext.broadcast((ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        top_score, top_id = np.full((len(ids), k), LEAST), np.zeros((len(ids), k), np.int64)

        def add(block_ids: np.ndarray, block: np.ndarray) -> None:
            order = np.argsort(block_ids, kind="stable")
            block_ids, block = block_ids[order], block[order]
            for at in range(0, len(ids), QUERY_BLOCK):
                own = slice(at, at + QUERY_BLOCK)
                scores = accumulate(queries[own], block)
                scores[ids[own, None] == block_ids[None, :]] = LEAST
                keep = best(scores, k)
                n = keep.sum(1)[0]
                score = np.concatenate([top_score[own], scores[keep].reshape(-1, n)], 1)
                name = np.concatenate([top_id[own], np.broadcast_to(block_ids, keep.shape)[keep].reshape(-1, n)], 1)
                first = np.lexsort((name, ~score), axis=1)[:, :k]
                top_score[own], top_id[own] = np.take_along_axis(score, first, 1), np.take_along_axis(name, first, 1)

        held, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, CANDIDATE_BLOCK):
                part = batch.slice(at, CANDIDATE_BLOCK)
                held.append((part.column(0).to_numpy(), dense(part.column(1), scale)))
                rows += part.num_rows
                if rows >= CANDIDATE_BLOCK:
                    add(*_joined(held))
                    held, rows = [], 0
        if held:
            add(*_joined(held))
        q, r = np.nonzero(top_score > LEAST)
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(top_id[q, r]), pa.array(top_score[q, r])], names=["query_id", "vec_id", "score"])

    return candidates.select(F.col(id_col).cast("long"), vector_col).mapInArrow(run, "query_id long, vec_id long, score long")


def _joined(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    width = max(b.shape[1] for _, b in held)
    return np.concatenate([i for i, _ in held]), np.concatenate([np.pad(b, ((0, 0), (0, width - b.shape[1]))) for _, b in held])


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", pass_queries: int = PASS_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score."""
    spark = candidates.sparkSession
    ask = queries.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(vector_col).alias("vector"))
    have = candidates.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    passes = max(1, -(-ask.count() // pass_queries))
    at = shared_path(spark, "bests")
    for i in range(passes):
        chunk = ask.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == i).toArrow()
        ids = chunk.column("id").to_numpy()
        vectors = chunk.column("vector").combine_chunks()
        own = dense(vectors, scale) if len(ids) else np.zeros((0, 0), np.int64)
        search_pass(ids, own, have, k, scale, id_col, vector_col).write.mode("append").parquet(at)
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = spark.read.schema("query_id long, vec_id long, score long").parquet(at)
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
