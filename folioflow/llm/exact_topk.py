"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are rows of integer weights; a term is a component with its postings,
the rows where it is not zero. Candidates and queries are dealt into blocks of
bounded size and every block of queries meets every block of candidates: term
by term the queries' weights are scattered, times the postings' weights, into
dense score arrays, from which each block keeps its k best. A merge of those
gives the result, whatever the blocks.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .vectors import dimension, list_matrix, usable

#: Rows of a block of candidates and of queries.
BLOCK_ROWS = 4096
QUERY_ROWS = 4096
#: Queries whose dense score arrays are held at once.
QUERY_STEP = 64
#: Weights between minus and plus this, or less where vectors are long, are added up in 64 bits; rows with larger ones are scored with Python's integers.
LARGEST = 1 << 28


def best_of(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, room: float = 0) -> tuple[np.ndarray, np.ndarray]:
    """Per row of scores the k best candidates by (score descending, id), without the query's own id: (row, column) indices.

    With room all that lie within it of the k-th are given.
    """
    if not scores.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    floor_ = -np.inf if scores.dtype.kind == "f" else np.iinfo(scores.dtype).min
    scores = np.where(ids[None, :] == own[:, None], floor_, scores)
    keep = min(k, scores.shape[1])
    # All that tie with the k-th are taken first; ids decide among them.
    limit = np.partition(scores, scores.shape[1] - keep, axis=1)[:, scores.shape[1] - keep]
    row, col = np.nonzero((scores >= limit[:, None] - room if room else scores >= limit[:, None]) & (scores > floor_))
    if room:
        return row, col
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    starts = np.searchsorted(row, row, "left")
    near = np.arange(len(row)) - starts < k
    return row[near], col[near]


def term_at_a_time(candidates: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Scores (query, candidate) of integer weights, accumulated term by term over postings."""
    scores = np.zeros((len(candidates), len(queries)), np.int64)
    for t in range(candidates.shape[1]):
        asking = np.flatnonzero(queries[:, t])
        if not len(asking):
            continue
        rows = np.flatnonzero(candidates[:, t])
        if len(rows) == len(candidates) and len(asking) == len(queries):
            scores += candidates[:, t, None] * queries[None, :, t]
        else:
            scores[np.ix_(rows, asking)] += candidates[rows, t, None] * queries[None, asking, t]
    return scores.T


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * float(scale))
    out = np.empty(values.shape, object)
    out.flat = [int(y) if np.isfinite(y) else int(x) * scale for x, y in zip(values.flat, scaled.flat)]
    return out


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score) of each query row's k best of all other rows by integer inner product.

    Components become floor(scale * x), of any size, and products are exact; one
    that fits no long is the nearest number that does. Vectors that are null or hold null or
    non-finite components take no part, nor do rows without an id; shorter
    vectors count as padded with zeros; rows of one id repeat as candidates are
    one candidate each, of which none answers that id. Ties go to the smaller
    id. An empty table gives no rows. Other columns are not read.
    """
    id_type = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.where(usable(vector_col) & F.col(id_col).isNotNull())
    values = F.transform(vector_col, lambda x: x.cast("double"))
    rows = materialize(rows.select(F.col(id_col).alias("id"), values.alias("w"), F.coalesce(is_query, F.lit(False)).alias("asks")), "weights")
    dim, n = dimension(rows, "w"), rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    blocks, parts = -(-n["n"] // BLOCK_ROWS) or 1, -(-n["q"] // QUERY_ROWS) or 1
    dealt = rows.withColumns({"block": F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), "part": F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(parts)).cast("int")})
    stored = dealt.select("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(False).alias("asks"), "id", "w")
    asked = dealt.where("asks").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "part", F.lit(True).alias("asks"), "id", "w")

    limit, most = min(LARGEST, isqrt((2**63 - 1) // max(1, dim))), 2**63 - 1

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks = table["asks"].to_numpy()
        ids, values = table["id"].to_numpy(), list_matrix(table["w"].chunk(0), dim)
        with np.errstate(over="ignore"):
            scaled = np.floor(values * float(scale))
        given, wide = np.clip(scaled, -limit, limit).astype(np.int64), (np.abs(scaled) > limit).any(axis=1)
        queries, query_ids = given[asks], ids[asks]
        stored_rows, stored_ids = given[~asks], ids[~asks]
        wide_queries, wide_stored = wide[asks], np.flatnonzero(wide[~asks])
        asked_values, stored_values = values[asks], values[~asks]
        wide_rows = whole(stored_values[wide_stored], scale)
        all_rows = whole(stored_values, scale) if wide_queries.any() else None

        def correct(scores: np.ndarray, at: int) -> None:
            """Exact products of the rows with large weights in place of those of held ones."""
            for k in range(len(scores)):
                some, rows_ = (np.arange(len(stored_values)), all_rows) if wide_queries[at + k] else (wide_stored, wide_rows)
                if len(some):
                    for j, x in zip(some, rows_ @ whole(asked_values[at + k], scale)):
                        scores[k, j] = max(-most, min(most, x))

        out = []
        for at in range(0, len(queries), QUERY_STEP):
            scores = term_at_a_time(stored_rows, queries[at : at + QUERY_STEP])
            if wide.any():
                correct(scores, at)
            row, col = best_of(scores, stored_ids, query_ids[at : at + QUERY_STEP], k)
            out.append((query_ids[at : at + QUERY_STEP][row], stored_ids[col], scores[row, col]))
        return pa.table([np.concatenate([x[i] for x in out] or [np.zeros(0, np.int64)]) for i in range(3)], names=["query_id", "id", "score"])

    found = stored.unionByName(asked).groupBy("block", "part").applyInArrow(search, f"query_id {id_type}, id {id_type}, score long")
    return merge_best(found, k, id_col)


def merge_best(found: DataFrame, k: int, id_col: str) -> DataFrame:
    """The k best per query of each block's best."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
