"""Vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import ann, exact_topk

ODD = [(1000, None), (1001, [0.0] * 8), (1002, [1.0, None] + [0.0] * 6), (1003, [float("nan")] * 8), (1004, [float("inf")] + [0.0] * 7), (1005, []), (1006, [0.5, 0.25]), (1050, [3e38] * 8), (None, [1.0] * 8)]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 8))
    base[::7] = base[0]
    return [(i, x.tolist()) for i, x in enumerate(base)] + [(5, base[5].tolist())] + ODD


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, id string, asks int").repartition(3)


def usable(rows, zero):
    out = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v) and (zero or any(v)):
            out.append((i, np.array([np.float64(np.float32(x)) for x in v] + [0.0] * (8 - len(v)))))
    return out


def brute(rows, score, zero):
    some, out = usable(rows, zero), []
    for q, a in some:
        if q % 50 == 0:
            best = sorted(((-score(a, b), i) for i, b in some if i != q))[:5]
            out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    return sorted(out)


def test_exact_top_k(spark, rows, monkeypatch):
    monkeypatch.setattr(exact_topk, "BLOCK_ROWS", 40)
    monkeypatch.setattr(exact_topk, "QUERY_ROWS", 3)
    weigh = lambda x: [int(np.floor(256 * v)) for v in x]
    most = 2**63 - 1
    want = brute(rows, lambda a, b: max(-most, min(most, sum(p * q for p, q in zip(weigh(a), weigh(b))))), True)
    got = exact_topk.exact_top_k(frame(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == want


def test_exact_top_k_of_large_weights(spark):
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(120, 8)) * 2.0 ** rng.integers(0, 22, size=(120, 8)))
    x[:40] = rng.normal(size=(40, 8))
    x[60, :], x[61, :] = [2.0**100] + [0] * 7, [0, 3e6] + [1] * 6
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    weigh = lambda a: [int(np.floor(256 * v)) for v in a]
    score = lambda a, b: sum(p * q for p, q in zip(weigh(a), weigh(b)))
    fits = [(i, v) for i, v in rows if all(abs(score(np.float64(np.float32(v)), np.float64(np.float32(w)))) < 2**63 for _, w in rows[::50])]
    assert len(fits) > 100 and np.abs(x).max(axis=1)[[i for i, _ in fits]].max() > 2**20
    got = exact_topk.exact_top_k(frame(spark, fits), F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == brute(fits, score, True)
    # 200 dimensions of large components, whose products just fit a long.
    long_ = [(i, v.tolist()) for i, v in enumerate(rng.integers(2**17, 2**19, size=(60, 200)) * rng.choice([-1.0, 1.0], size=(60, 200)))]
    got = exact_topk.exact_top_k(frame(spark, long_), F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == brute(long_, lambda a, b: sum(p * q for p, q in zip(weigh(a), weigh(b))), True)
    # A weight beyond a long, where the product is not.
    apart = [(0, [0.0, 1.0] + [0.0] * 6), (1, [2.0**100, 2.0] + [0.0] * 6), (2, [0.0, 3.0] + [0.0] * 6)]
    got = exact_topk.exact_top_k(frame(spark, apart), F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 2, 3 * 65536), (0, 2, 1, 2 * 65536)]


def cosine(a, b):
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))


def test_one_part_is_exact(spark, rows, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE_OF_PART", 1000)
    want = brute(rows, cosine, False)
    got = sorted(map(tuple, ann.nearest_neighbours(frame(spark, rows), F.col("vec_id") % 50 == 0).collect()))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


def test_all_parts_are_exact(spark, rows, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 7)
    monkeypatch.setattr(ann, "QUERY_ROWS", 2)
    got = sorted(map(tuple, ann.nearest_neighbours(frame(spark, rows), F.col("vec_id") % 50 == 0, recall=1.0).collect()))
    want = brute(rows, cosine, False)
    assert np.mean([g[:2] == w[:2] and np.isclose(g[3], w[3], rtol=1e-12) for g, w in zip(got, want)]) > 0.95


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_and_work(spark, monkeypatch, sf):
    """Recall against brute force is 0.9 or more, by a router that leaves a part of the rows out."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 100)
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    asks = F.col("vec_id") % 50 == 0
    routed, router, dim, depth = ann.partitioned(df, asks, 5, ann.RECALL, "vec_id", "embedding")
    got = ann.nearest_neighbours(df, asks).toPandas()
    pdf = df.toPandas()
    x = np.stack(pdf.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = got.groupby("query_id").vec_id.apply(set)
    queries, hits = np.flatnonzero(pdf.vec_id % 50 == 0), []
    for q in queries:
        s = x @ x[q]
        s[q] = -9
        hits.append(len(set(pdf.vec_id[np.argsort(-s)[:5]]) & found[pdf.vec_id[q]]) / 5)
    size = np.bincount(router.home(x), minlength=router.w[1].shape[1]) / len(x)
    order, mass = router.before(x[queries])
    scored = (size[order] * (mass <= depth)).sum(axis=1).mean()
    print(sf, "parts", len(size), "recall", np.mean(hits), "scored", scored)
    assert len(size) > 8 and np.mean(hits) >= 0.9 and scored < 0.65
    assert not got.duplicated(["query_id", "vec_id"]).any() and (got.groupby("query_id").size() == 5).all()


def test_clustered_vectors_are_searched_in_few_parts(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(40, size=2000)] + rng.normal(scale=0.2, size=(2000, 16))
    x[:700] = x[0]  # a third of all rows are one vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    routed, router, dim, depth = ann.partitioned(df, F.col("vec_id") % 50 == 0, 5, ann.RECALL, "vec_id", "embedding")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    order, mass = router.before(u[750::50])
    assert (mass <= depth).sum(axis=1).mean() < 0.35 * order.shape[1]
    got = {r.query_id: r for r in ann.nearest_neighbours(df, F.col("vec_id") % 50 == 0).where("rank = 1").collect()}
    assert len(got) == 40 and got[0].vec_id == 1 and got[50].vec_id == 0 and got[650].score == pytest.approx(1)


def test_partition_is_balanced():
    x = np.random.default_rng(0).normal(size=(600, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = ann.neighbour_graph(x, 5)
    part = ann.balanced_partition(x, graph, 6)
    assert np.bincount(part).max() <= np.ceil(100 * 1.05) and (part[graph] == part[:, None]).mean() > 0.3


def test_empty(spark, rows):
    none = frame(spark, rows).where("false")
    assert ann.nearest_neighbours(none, F.col("vec_id") % 50 == 0).count() == 0
    assert exact_topk.exact_top_k(none, F.col("vec_id") % 50 == 0).count() == 0
