"""Approximate nearest neighbours by learned partitions.

On a bounded sample a neighbour graph is built and cut into parts of equal
size that keep neighbours together. A small network learns, from a vector, in
which parts its neighbours lie. Every vector is stored in its most probable
part; a query is sent to its most probable parts, up to a share of probability,
where exact cosines decide. That share is measured: some rows' true neighbours,
found by a scan of all rows, say how far down the parts one has to go for the
recall asked for, so tables with structure are searched in few parts and others
in more. Parts are dealt into blocks of bounded size, so a part that holds a
third of all vectors is searched by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fit_in_task, materialize, sampled_rows
from .exact_topk import best_of, merge_best
from .vectors import list_matrix, matrix, usable

#: Share of true neighbours to find on the rows that the search depth is measured on.
RECALL = 0.94
#: Rows that the graph and the network are fitted on: so many times the root of all rows, within these bounds; parts are the root of all rows, of SAMPLE_OF_PART sample rows at least.
SAMPLE_PER_ROOT = 64
SAMPLE_LEAST, SAMPLE_MOST = 2048, 65_536
SAMPLE_OF_PART = 20
#: Sample rows that the network sees in its training, repeats counted.
SEEN = 480_000
#: Rows that the depth is measured on.
MEASURED = 512
#: Neighbours of a vector in the graph.
NEIGHBOURS = 10
#: Rows of a block of stored vectors and of queries.
BLOCK_ROWS = 4096
QUERY_ROWS = 4096
#: Queries scored together, and how far two roundings of one cosine may lie apart.
QUERY_STEP = 64
ROUNDING = 1e-12


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Each row's k nearest other rows by cosine; x has unit rows."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        out[at : at + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, sweeps: int = 8, slack: float = 1.05) -> np.ndarray:
    """Parts of near equal size that cut few edges: halves along main directions, then moves to the neighbours' part while it has room."""
    part = np.zeros(len(x), np.int64)
    pending = [(np.arange(len(x)), 0, parts)]
    while pending:
        rows, first, n = pending.pop()
        if n == 1:
            part[rows] = first
            continue
        centred = x[rows] - x[rows].mean(axis=0)
        direction = np.linalg.svd(centred.T @ centred)[0][:, 0]
        rows = rows[np.argsort(centred @ direction, kind="stable")]
        at = len(rows) * (n // 2) // n
        pending += [(rows[:at], first, n // 2), (rows[at:], first + n // 2, n - n // 2)]
    room = int(np.ceil(len(x) / parts * slack))
    size = np.bincount(part, minlength=parts)
    both: list[list[int]] = [list(r) for r in graph.tolist()]
    for i, row in enumerate(graph.tolist()):
        for j in row:
            both[j].append(i)
    order = np.random.default_rng(0)
    for _ in range(sweeps):
        moved = 0
        for i in order.permutation(len(x)).tolist():
            near = np.bincount(part[both[i]], minlength=parts)
            own = part[i]
            near[(size >= room) & (np.arange(parts) != own)] = -1
            to = int(near.argmax())
            if near[to] > near[own]:
                size[own] -= 1
                size[to] += 1
                part[i] = to
                moved += 1
        if not moved:
            break
    return part


class Router:
    """A network of one hidden layer from a unit vector to the parts of its neighbours."""

    def __init__(self, x: np.ndarray, share: np.ndarray, hidden: int = 256, batch: int = 128, rate: float = 3e-3):
        rng = np.random.default_rng(0)
        sizes = [(x.shape[1], hidden), (hidden, share.shape[1])]
        self.w = [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in sizes]
        self.b = [np.zeros(b) for _, b in sizes]
        params = self.w + self.b
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step, epochs = 0, int(np.clip(SEEN // len(x), 8, 80))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                h = np.maximum(x[rows] @ self.w[0] + self.b[0], 0)
                d = (self._softmax(h @ self.w[1] + self.b[1]) - share[rows]) / len(rows)
                dh = d @ self.w[1].T * (h > 0)
                step += 1
                for p, m, v, g in zip(params, first, second, (x[rows].T @ dh, h.T @ d, dh.sum(axis=0), d.sum(axis=0))):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each row's neighbours to lie in each part."""
        return self._softmax(np.maximum(x @ self.w[0] + self.b[0], 0) @ self.w[1] + self.b[1])

    def home(self, x: np.ndarray) -> np.ndarray:
        """The part that each row is stored in."""
        return self.probabilities(x).argmax(axis=1)

    def before(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(parts, mass): each row's parts by falling probability, and the probability of those before each."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        p = np.take_along_axis(p, order, 1)
        return order, np.cumsum(p, axis=1) - p


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_router(sample: np.ndarray, parts: int, least: int = SAMPLE_OF_PART) -> Router | None:
    """Graph, partition and network on unit vectors, of which equal ones count once and a part holds ``least`` or more; None for a single part."""
    sample = np.unique(sample, axis=0)
    parts = min(parts, len(sample) // least)
    if parts < 2:
        return None
    graph = neighbour_graph(sample, min(NEIGHBOURS, len(sample) - 1))
    part = balanced_partition(sample, graph, parts)
    share = np.zeros((len(sample), parts))
    np.add.at(share, (np.repeat(np.arange(len(sample)), graph.shape[1] + 1), part[np.concatenate([graph, np.arange(len(sample))[:, None]], axis=1)].ravel()), 1 / (graph.shape[1] + 1))
    return Router(sample, share)


def search_depth(routed: DataFrame, router: Router, dim: int, k: int, recall: float) -> float:
    """The probability that parts before the last one visited may hold, for the recall asked for on MEASURED rows against a scan of all."""
    some = sampled_rows(routed.select("id", "v"), "id", MEASURED, "depth").toArrow().combine_chunks()
    if not some.num_rows:
        return 1.0
    asked, asked_ids = _unit(list_matrix(some["v"].chunk(0), dim)), some["id"].to_numpy()

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's k nearest rows of each measured row, in memory that doesn't grow with its rows."""
        best = np.full((len(asked), k), -np.inf)
        part = np.zeros((len(asked), k), np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                ids, v, own = (batch.column(i).slice(at, BLOCK_ROWS) for i in range(3))
                score = asked @ _unit(list_matrix(v, dim)).T
                score[asked_ids[:, None] == ids.to_numpy(zero_copy_only=False)[None, :]] = -np.inf
                score = np.hstack([best, score])
                of = np.hstack([part, np.broadcast_to(own.to_numpy(zero_copy_only=False), (len(asked), len(own)))])
                near = np.argpartition(-score, k - 1, axis=1)[:, :k]
                best, part = np.take_along_axis(score, near, 1), np.take_along_axis(of, near, 1)
        found = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(found)[0]), pa.array(best[found]), pa.array(part[found].astype(np.int32))], names=["q", "score", "part"])

    found = routed.select("id", "v", "part").mapInArrow(nearest, "q long, score double, part int")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "part"))).where(F.col("rank") <= k).select("q", "part").toArrow()
    if not found.num_rows:
        return 1.0
    order, mass = router.before(asked)
    q, part = found["q"].to_numpy(), found["part"].to_numpy()
    needed = np.sort(np.take_along_axis(mass, np.argsort(order, axis=1), 1)[q, part])
    return float(needed[int(np.ceil(recall * len(needed))) - 1])


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 5, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each query row the k nearest found of all other rows by cosine, in double precision.

    The graph and router are fitted in a task on a bounded sample, the rows of
    smallest hash; every row is stored, once. Vectors that are null, zero or
    hold null or non-finite components take no part, nor do rows without an id;
    shorter vectors count as padded with zeros; rows that repeat an id never
    answer it. Ties go to the smaller id. A table of fewer than 2 *
    SAMPLE_OF_PART different vectors is one part; an empty one gives no rows.
    Other columns are not read.
    """
    id_type = vectors.schema[id_col].dataType.simpleString()
    routed, router, dim, depth = partitioned(vectors, is_query, k, recall, id_col, vector_col)
    shared = vectors.sparkSession.sparkContext.broadcast((router, depth))

    @F.pandas_udf("array<int>")
    def visits(v: pd.Series) -> pd.Series:
        router, depth = shared.value
        if router is None:
            return pd.Series([[0]] * len(v))
        order, mass = router.before(_unit(matrix(v.to_list(), dim)))
        return pd.Series([o[:n].astype(np.int32) for o, n in zip(order, (mass <= depth).sum(axis=1))])

    asking = routed.where("asks").select(F.explode(visits("v")).alias("part"), F.lit(True).alias("asks"), "row", "id", "v")
    asking = materialize(asking, "asking")
    # One row per part, of which there are SAMPLE_MOST / SAMPLE_OF_PART at most.
    blocks = F.broadcast(routed.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")))
    turns = F.broadcast(asking.groupBy("part").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("turns")))
    stored = routed.join(turns, "part").join(blocks, "part")
    stored = stored.select("part", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), F.lit(False).alias("asks"), "row", "id", "v")
    asking = asking.join(blocks, "part").join(turns, "part")
    asking = asking.select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64(F.lit(1), "id"), F.col("turns")).cast("int").alias("turn"), "asks", "row", "id", "v")

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks, ids = table["asks"].to_numpy(), table["id"].to_numpy()
        given = list_matrix(table["v"].chunk(0), dim)
        norms = np.sqrt((given * given).sum(axis=1))
        queries, query_ids, query_norms = given[asks], ids[asks], norms[asks]
        held_rows, held_ids, held_norms = given[~asks], ids[~asks], norms[~asks]
        held_at = table["row"].to_numpy()[~asks]
        out = []
        for at in range(0, len(queries), QUERY_STEP):
            own, own_ids = queries[at : at + QUERY_STEP], query_ids[at : at + QUERY_STEP]
            rough = own @ held_rows.T / (query_norms[at : at + QUERY_STEP, None] * held_norms[None, :])
            # A matrix product may round equal vectors apart, so candidates come with some room and are scored again one by one.
            row, col = best_of(rough, held_ids, own_ids, k, ROUNDING)
            score = (own[row] * held_rows[col]).sum(axis=1) / (query_norms[at : at + QUERY_STEP][row] * held_norms[col])
            order = np.lexsort((held_ids[col], -score, row))
            row, col, score = row[order], col[order], score[order]
            near = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
            out.append((own_ids[row[near]], held_at[col[near]], held_ids[col[near]], score[near]))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([np.concatenate([x[i] for x in out]) if out else pa.array([], t) for i, t in enumerate(types)], names=["query_id", "row", "id", "score"])

    found = stored.unionByName(asking).groupBy("part", "block", "turn").applyInArrow(search, f"query_id {id_type}, row long, id {id_type}, score double")
    return merge_best(found.select("query_id", "id", "score"), k, id_col)


def partitioned(vectors: DataFrame, is_query: Column, k: int, recall: float, id_col: str, vector_col: str) -> tuple[DataFrame, Router | None, int, float]:
    """(rows, router, dimension, depth): usable rows as (id, v, asks, part, row), each in its part."""
    rows = vectors.where(usable(vector_col) & F.exists(vector_col, lambda v: v != 0) & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.transform(vector_col, lambda v: v.cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    dim, n = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count("*")).first()
    sample = sampled_rows(rows.select("id", "v"), "id", min(SAMPLE_MOST, max(SAMPLE_LEAST, SAMPLE_PER_ROOT * isqrt(n))), "ann")
    least = SAMPLE_OF_PART
    router = fit_in_task(sample, lambda table: fit_router(_unit(list_matrix(table["v"].combine_chunks(), dim)), isqrt(n), least))
    shared = vectors.sparkSession.sparkContext.broadcast(router)

    @F.pandas_udf("int")
    def home(v: pd.Series) -> pd.Series:
        return pd.Series(shared.value.home(_unit(matrix(v.to_list(), dim))) if shared.value else np.zeros(len(v)), dtype="int32")

    routed = materialize(rows.withColumn("part", home("v")).withColumn("row", F.monotonically_increasing_id()), "routed")
    return routed, router, dim, search_depth(routed, router, dim, k, recall) if router else 1.0
