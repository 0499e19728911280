"""Near-duplicate classes against all pairs, and signatures against exact similarity."""

import random
from collections import Counter

import numpy as np

from folioflow.llm import neardup
from folioflow.llm.common import mix


def bag(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def classes(rows):
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [(i, b, sum(b.values())) for i, t in rows for b in [bag(t)]]
    for k, (i, a, m) in enumerate(bags):
        for j, b, n in bags[:k]:
            both = sum((a & b).values()) if min(m, n) >= 0.8 * max(m, n) and not a.keys().isdisjoint(b) else 0
            if both and both >= 0.8 * sum((a | b).values()) - 1e-9:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i, _ in rows}


def corpus():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdefg", k=3))
    rows = [(0, None), (1, ""), (2, " \t"), (3, "one two"), (4, "ONE  two"), (5, "one two three"), (6, "x " * 400), (7, "x " * 380), (8, "x " * 100)]
    shared = [word() for _ in range(40)]
    for g in range(6):
        base = [word() for _ in range(rnd.randint(40, 160))]
        for _ in range(30 if g == 0 else 6):
            copy = list(base)
            for _ in range(rnd.randint(0, 5)):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    for _ in range(30):
        rows.append((len(rows), " ".join([word() for _ in range(rnd.randint(5, 40))] + shared)))
    rows += [(len(rows) + k, rows[20][1]) for k in range(40)]
    rnd.shuffle(rows)
    return rows


def test_classes(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows] + [(None, "one two", "x", 1)], "doc_id long, text string, node string, band int").repartition(4)
    found = neardup.near_duplicate_classes(df).collect()
    assert len(found) == len(rows) + 1
    assert {r.doc_id: r.class_id for r in found if r.doc_id is not None} == classes(rows)
    kept = neardup.one_of_each(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(classes(rows).values()))


def test_one_row_of_each_class(spark, tmp_path):
    """Rows that repeat an id or have none, columns of awkward names and types, from files and not."""
    long_ = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "a b c", {"k": 1}, "p", 1), (1, "a b c", {"k": 2}, "q", 2), (1, "other text", {}, "r", 3), (2, "A  b c", {}, "s", 4), (None, "a b c", {}, "t", 5), (None, None, {}, "u", 6), (None, None, {}, "v", 7), (3, "", {}, "w", 8), (None, long_, {}, "x", 9), (None, long_ + " z", {}, "y", 10), (9, long_, {}, "z", 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, row_key string, row_place int")
    df.repartition(3).write.parquet(str(tmp_path / "rows"))
    for table in (df, spark.read.parquet(str(tmp_path / "rows"))):
        got = neardup.one_of_each(table)
        assert got.columns == df.columns
        kept = {r.row_place for r in got.collect()}
        assert kept - {1, 2} == {3, 6, 7, 8, 11} and len(kept & {1, 2}) == 1
        assert neardup.one_of_each(table.where("false")).count() == 0


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 9, 200)
    b = np.where(rng.random(200) < 0.7, a, rng.integers(0, 9, 200))
    value = mix(np.arange(200, dtype=np.uint64))
    owner, count = np.repeat([0, 1], 200), np.r_[a, b]
    has = count > 0
    signature = neardup.bag_minhash(owner[has], np.r_[value, value][has], count[has], 2, 6000)
    exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((signature[0] == signature[1]).mean() - exact) < 0.025


def test_slices_change_nothing(monkeypatch):
    rng = np.random.default_rng(0)
    owner, value, count = np.repeat(np.arange(5), 40), mix(rng.integers(0, 99, 200).astype(np.uint64)), rng.integers(1, 5, 200)
    whole = neardup.bag_minhash(owner, value, count, 5, 64)
    monkeypatch.setattr(neardup, "SLICE", 17)
    assert (neardup.bag_minhash(owner, value, count, 5, 64) == whole).all()


def test_empty(spark):
    assert neardup.near_duplicate_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
