"""Language identification with error-correcting output codes.

Each language has a codeword of +1 and -1. For each bit a binary classifier
over character n-grams of words (naive Bayes weights, each language counting
alike) says on which side a text lies. The losses of the bits' margins against
a codeword, weighted by how well each bit does on the learning texts, add up to
its distance; the nearest codeword wins, and a text is ambiguous if the second
is nearly as near.
"""

from __future__ import annotations

import itertools
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_worker_cache, fit_in_task, materialize, worker_cache
from .wordrows import COMPUTED, WordRows, codes_of, slices_of_texts

#: Learning texts per language at most, and of all languages together.
TEXTS_PER_LANGUAGE = 1000
TEXTS = 5000
BUCKETS = 1 << 18
LONGEST = 4
#: Below this share of the two nearest languages' probability a prediction is ambiguous.
AMBIGUOUS = 0.6
UNKNOWN = "und"


def codewords(classes: int) -> np.ndarray:
    """A +1/-1 matrix (class, bit): all different splits of up to seven classes, else the best of some random codes."""
    if classes == 1:
        return np.ones((1, 1))
    if classes <= 7:
        return np.array([[1, *bits] for bits in itertools.product((1, -1), repeat=classes - 1) if -1 in bits]).T.astype(float)
    rng, bits = np.random.default_rng(0), 10 * int(np.ceil(np.log2(classes)))
    best, most = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (classes, bits))
        code = code[:, np.abs(code.sum(axis=0)) < classes]
        apart = (code.shape[1] - (code @ code.T)[np.triu_indices(classes, 1)].max()) / 2
        if apart > most:
            best, most = code, apart
    return best


def fold(word: str) -> str:
    """A word's letters in lower case."""
    low = word.lower()
    return low if low.isalpha() else "".join(filter(str.isalpha, low))


def ngram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams (1 to LONGEST letters, word ends marked) of folded words, and each one's word."""
    codes, lengths = codes_of([f" {w} " for w in words])
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(starts + lengths, lengths) - np.arange(len(codes))
    buckets, owners = [], []
    value = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, LONGEST + 1):
            value = value[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(1)
            fits = left[: len(value)] >= n
            if n == 1:
                fits &= codes != 32
            h = value[fits] * np.uint64(0x9E3779B97F4A7C15 + 2 * n)
            buckets.append((h >> np.uint64(46)).astype(np.int64))
            owners.append(owner[: len(value)][fits])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class LanguageModel:
    names: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    bit_weight: np.ndarray
    key: str

    @classmethod
    def fit(cls, texts: list[str], langs: list[str]) -> LanguageModel:
        names = sorted(set(langs))
        code = codewords(len(names))
        words: list[Counter] = [Counter() for _ in names]
        for text, lang in zip(texts, langs):
            words[names.index(lang)].update(text.split())
        counts = np.zeros((len(names), BUCKETS))
        for own, row in zip(words, counts):
            folded = Counter()
            for w, n in own.items():
                folded[fold(w)] += n
            folded.pop("", None)
            distinct = list(folded)
            for at in range(0, len(distinct), COMPUTED):
                some = distinct[at : at + COMPUTED]
                buckets, owners = ngram_buckets(some)
                row += np.bincount(buckets, np.array([folded[w] for w in some])[owners], BUCKETS)
        rates = (counts + 0.05) / (counts.sum(axis=1, keepdims=True) + 0.05 * BUCKETS)
        weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
        for b in range(code.shape[1]):
            one, other = code[:, b] > 0, code[:, b] < 0
            if other.any():
                weights[:, b] = np.log(rates[one].mean(axis=0)) - np.log(rates[other].mean(axis=0))
        model = cls(names, code, weights, np.ones(code.shape[1]), np.ones(code.shape[1]), uuid.uuid4().hex)
        sums = model.text_sums(texts)
        drop_worker_cache()
        known = sums[:, -1] > 0
        if known.any():
            margins = sums[known, :-1] / sums[known, -1:]
            signed = margins * code[[names.index(x) for x, k in zip(langs, known) if k]]
            model.scale = 4 / np.maximum(np.median(np.abs(margins), axis=0), 1e-6)
            right = (signed > 0).mean(axis=0)
            model.bit_weight = np.maximum(right - 0.5, 0.05) / np.maximum(right - 0.5, 0.05).mean()
        return model

    def word_sums(self, words: list[str]) -> np.ndarray:
        """Per word the summed weights of its n-grams by bit, and their number."""
        out = np.zeros((len(words), self.code.shape[1] + 1), np.float32)
        folded = list(map(fold, words))
        has = [i for i, w in enumerate(folded) if w]
        if has:
            buckets, owners = ngram_buckets([folded[i] for i in has])
            at = np.array(has)[owners]
            order = np.argsort(at, kind="stable")
            at, got = at[order], self.weights[buckets[order]]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            out[at[first], :-1] = np.add.reduceat(got, first, axis=0)
            out[at[first], -1] = np.diff(np.r_[first, len(at)])
        return out

    def text_sums(self, texts: list[str]) -> np.ndarray:
        """Per text the summed weights of its n-grams by bit, and their number."""
        rows = worker_cache(self.key, lambda: WordRows(self.word_sums, self.code.shape[1] + 1))
        sums = np.zeros((len(texts), self.code.shape[1] + 1))
        for first, group in slices_of_texts(texts):
            index, counts = rows.of([t.split() for t in group])
            some = np.flatnonzero(counts)
            if len(some):
                sums[first + some] = np.add.reduceat(rows.rows[index].astype(np.float64), (np.cumsum(counts) - counts)[some], axis=0)
        return sums

    def predict(self, texts: list[str]) -> pd.DataFrame:
        sums = self.text_sums(texts)
        letters = sums[:, -1] > 0
        margin = sums[:, :-1] / np.maximum(sums[:, -1:], 1) * self.scale
        distance = (np.logaddexp(0, -margin[:, None, :] * self.code[None]) * self.bit_weight).sum(axis=2)
        share = np.exp(-(distance - distance.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        best = distance.argmin(axis=1)
        top = share.max(axis=1)
        second = np.sort(share, axis=1)[:, -2] if share.shape[1] > 1 else np.zeros(len(share))
        name = np.array(self.names, object)[best]
        return pd.DataFrame({"lang_pred": np.where(letters, name, UNKNOWN), "score": np.where(letters, top, 0.0), "ambiguous": ~letters | (top / (top + second) < AMBIGUOUS)})


def learn_languages(documents: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", per_language: int = TEXTS_PER_LANGUAGE, most: int = TEXTS) -> LanguageModel | None:
    """Fit on a bounded sample of rows where ``learn`` holds: whole texts of the smallest hashes, at most ``most`` of them.

    Each of n languages gives about min(per_language, most / n) texts; with
    more than ``most`` languages some are not learned. Which rows are taken
    depends on their text and language alone. The fit runs in a task.
    """
    labelled = documents.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = materialize(labelled.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    each = max(1, min(per_language, most // max(1, counts.count())))
    point = F.pmod(F.xxhash64(F.lit("languages"), "text"), F.lit(1 << 20)) / float(1 << 20)
    sample = labelled.join(counts, "lang").withColumn("point", point).where(F.col("point") < each / F.col("n")).orderBy("point", "text", "lang").limit(most)
    return fit_in_task(sample.select("text", "lang"), lambda rows: LanguageModel.fit(rows["text"].to_pylist(), rows["lang"].to_pylist()))


def identify_language(documents: DataFrame, model: LanguageModel | None, text_col: str = "text", into: str = "_language") -> DataFrame:
    """All rows and columns of documents with the struct ``into``, in place of a column of that name: lang_pred, score (0 to 1) and ambiguous.

    Texts that are null or without a letter are ``und`` with score 0 and
    ambiguous, as are all without a model. Whole texts count; equal texts get
    equal results; an empty table gives no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(text: pd.Series) -> pd.DataFrame:
        if shared.value is None:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(text), "score": 0.0, "ambiguous": True})
        return shared.value.predict(text.fillna("").tolist())

    # Taken as not deterministic, so that a filter on the result doesn't compute it twice.
    return documents.withColumn(into, predict.asNondeterministic()(text_col))
