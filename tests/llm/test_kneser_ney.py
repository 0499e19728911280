"""The language model against a plain dictionary version."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from folioflow.llm import kneser_ney


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute(train):
    uni, bi = Counter(), Counter()
    for text in train:
        previous = None
        for w in tokens(text):
            uni[w] += 1
            bi[previous, w] += 1
            previous = w
    kinds = Counter(w for _, w in bi)

    def discounts(counts):
        m = [sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)]
        if not m[0] or not m[1]:
            return 0.5, 0.75, 0.9
        y = m[0] / (m[0] + 2 * m[1])
        d = [1 - 2 * y * m[1] / m[0], 2 - 3 * y * m[2] / m[1], 3 - 4 * y * m[3] / m[2] if m[2] else 1.5]
        return [min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d)]

    d2, d1 = discounts(bi), discounts(kinds)
    whole, taken = Counter(), defaultdict(float)
    for (a, _), n in bi.items():
        whole[a] += n
        taken[a] += d2[min(n, 3) - 1]
    all_kinds = sum(kinds.values())
    unseen = sum(d1[min(n, 3) - 1] for n in kinds.values()) / all_kinds / (len(kinds) + 1)

    def score(text):
        total, previous = 0.0, None
        for w in tokens(text):
            low = (kinds[w] - d1[min(kinds[w], 3) - 1]) / all_kinds + unseen if w in kinds else unseen
            n = bi.get((previous, w), 0)
            p = low if not whole[previous] else ((n - d2[min(n, 3) - 1]) / whole[previous] if n else 0) + taken[previous] / whole[previous] * low
            total += math.log10(p)
            previous = w
        return total

    n, v = sum(uni.values()), len(uni)
    return score, lambda text: sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in tokens(text)), uni, n


def test_against_brute_force(spark):
    train = ["the cat sat on the mat", "The dog sat on the log", "a cat and a dog", "", None, "the the the", "one\ttwo\x0bthree\nfour", "ünï code ünï"] * 3 + ["only once here", "x " * 700]
    asked = [*train, "unknown words the cat", "  ", "mat the on"]
    spark_train = spark.createDataFrame([(i, t, "other") for i, t in enumerate(train)], "doc_id long, text string, score string").repartition(3)
    model = kneser_ney.train(spark_train, bucket_words=20)
    got = {r.i: r for r in kneser_ney.score(spark.createDataFrame(list(enumerate(asked)), "i long, text string"), model).select("i", "_lm.*").collect()}
    score, base, uni, n = brute(train)
    assert model.tokens == n and model.types == len(uni)
    for i, text in enumerate(asked):
        assert got[i].n_tokens == len(tokens(text))
        assert got[i].n_known == sum(w in uni for w in tokens(text))
        assert got[i].base_score == pytest.approx(base(text), rel=1e-9)
        assert got[i].score == pytest.approx(score(text), rel=1e-4)


def test_large_counts_are_kept(spark, monkeypatch):
    """Counts too large for their array, here those from 3 on, stand beside it."""
    monkeypatch.setattr(kneser_ney, "MANY", 3)
    train = ["the cat sat on the mat the cat"] * 9 + ["x " * 50, "a cat"]
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in train], "text string"), bucket_words=5)
    score = brute(train)[0]
    for text, got in zip([*train, "the cat"], kneser_ney.score_texts(model, [*train, "the cat"])["score"]):
        assert got == pytest.approx(score(text), rel=1e-4)


def test_probabilities_add_up(spark):
    train = ["a b c a b", "b c c a", "a a b"]
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in train], "text string"))
    seen = ["a", "b", "c", "zzz"]
    got = kneser_ney.score_texts(model, [f"b {w}" for w in seen] + ["b"])
    # p(b) p(w|b) p(end|w) against p(b) p(w|b): chains of one word more.
    assert (got["score"] < 0).all() and got["n_known"].tolist() == [3, 3, 3, 2, 2]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = kneser_ney.train(empty)
    assert kneser_ney.score(empty, model).count() == 0
    assert kneser_ney.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).select("_lm.score").first()[0] <= 0


def test_held_out_beats_unigrams(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas()
    held = docs.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 7 == 2)
    model = kneser_ney.train(spark.createDataFrame(docs.loc[~held, ["text"]]))
    got = kneser_ney.score_texts(model, docs.text[held].tolist())
    assert got["score"].sum() > got["base_score"].sum()
