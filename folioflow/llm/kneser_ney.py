"""Interpolated modified Kneser-Ney language model over hashed bigrams, for scoring texts.

Workers count the bigrams of their texts and send, for every context bucket,
one block of sorted counts; each bucket's blocks merge into sorted arrays of
bigram hashes with their discounted shares and of context hashes with their
interpolation weights. Word continuation counts gather the same way by word.
The arrays are files in the shared folder that scoring workers memory-map, so
a worker holds only the pages that its texts touch, whatever the model's size.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_slices, materialize, mix, shared_dir, text_buffer, word_hashes
from .wordrows import slices_of_texts

#: Word that ends each text and precedes the first; text hashes never equal it but by chance.
END = np.uint64(0x243F6A8885A308D3)
_U = np.uint64
_K = _U(0x9E3779B97F4A7C15)
#: Bigrams of a bucket to aim at, by the number of training words.
BUCKET_WORDS = 2_000_000
#: Words a worker gathers before it sends counts.
BATCH_WORDS = 2_000_000
#: Counts below this are kept in four bytes each.
MANY = (1 << 32) - 1
#: Characters scored together.
SCORED_CHARS = 1 << 22


def _pair(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(context * _K + word)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, tokens per text) of all texts, each closed by END and begun after END."""
    words, counts = word_hashes(*text_buffer(column))
    own = counts + 1
    ends = np.cumsum(own) - 1
    token = np.empty(len(words) + len(counts), _U)
    inside = np.ones(len(token), bool)
    inside[ends] = False
    token[inside], token[ends] = words, END
    context = np.empty_like(token)
    context[1:], context[ends - counts] = token[:-1], END
    return context, token, own


def _counted(*keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of keys in order, and their summed weights."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    total = np.diff(np.r_[first, len(order)]) if weights is None else np.add.reduceat(weights[order], first) if len(first) else np.zeros(0, np.int64)
    return [k[first] for k in keys], total


def _pack(*arrays: np.ndarray) -> bytes:
    parts = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return struct.pack(f"<{len(parts)}q", *map(len, parts)) + b"".join(parts)


def _unpack(blob: bytes, *types: str) -> list[np.ndarray]:
    sizes, at, out = struct.unpack_from(f"<{len(types)}q", blob), 8 * len(types), []
    for n, kind in zip(sizes, types):
        out.append(np.frombuffer(blob, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def _runs(buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of the runs of sorted buckets, those that occur alone."""
    first = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]][: len(buckets)])
    return list(zip(buckets[first].tolist(), first.tolist(), np.r_[first[1:], len(buckets)].tolist()))


def _bigram_blocks(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block) of bigram counts by context, gathered per worker batch."""

    def emit(context: list[np.ndarray], word: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        (c, w), n = _counted(np.concatenate(context), np.concatenate(word))
        runs = _runs(_bucket(c, buckets))
        for at in range(0, len(runs), 16):
            blocks = []
            for _, a, b in runs[at : at + 16]:
                heads, sizes = np.unique(c[a:b], return_counts=True)
                blocks.append(_pack(heads, sizes.astype("<u4"), w[a:b], np.minimum(n[a:b], 255).astype("u1"), n[a:b][n[a:b] >= 255].astype("<i8")))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in runs[at : at + 16]], pa.int32()), pa.array(blocks, pa.binary())], names=["bucket", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, word, size = [], [], 0
        for batch in batches:
            for column in column_slices(batch.column(0)):
                c, w, _ = _tokens(column)
                context.append(c)
                word.append(w)
                size += len(w)
                if size >= BATCH_WORDS:
                    yield from emit(context, word)
                    context, word, size = [], [], 0
        if size:
            yield from emit(context, word)

    return texts.mapInArrow(run, "bucket int, block binary")


def _merge_bigrams(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    context, word, count = [], [], []
    for blob in blocks:
        heads, sizes, w, small, large = _unpack(blob, "<u8", "<u4", "<u8", "u1", "<i8")
        n = small.astype(np.int64)
        n[small == 255] = large
        context.append(np.repeat(heads, sizes))
        word.append(w)
        count.append(n)
    (c, w), n = _counted(np.concatenate(context), np.concatenate(word), weights=np.concatenate(count))
    return c, w, n


def _discounts(ones: int, twos: int, threes: int, fours: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from the numbers of n-grams met 1 to 4 times."""
    if not ones or not twos:
        return 0.5, 0.75, 0.9
    y = ones / (ones + 2 * twos)
    d = [1 - 2 * y * twos / ones, 2 - 3 * y * threes / twos, 3 - 4 * y * fours / threes if threes else 1.5]
    return tuple(float(np.clip(x, 0.05, k - 0.05)) for k, x in zip((1, 2, 3), d))


def _discount(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.choose(np.minimum(n, 3) - 1, d)


class ModelFiles:
    """Sorted arrays in the shared folder, one file per array and bucket."""

    def __init__(self, folder: str, buckets: int):
        self.folder, self.buckets = folder, buckets
        self.open: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return {"folder": self.folder, "buckets": self.buckets, "open": {}}

    def local(self) -> str:
        url = urlparse(self.folder)
        if url.scheme not in ("", "file"):
            raise ValueError(f"memory-mapped models need a shared folder that is mounted on all machines, not {self.folder}")
        return url.path

    def write(self, name: str, array: np.ndarray) -> None:
        """Whole or not at all, so a task that runs again may write again."""
        os.makedirs(self.local(), exist_ok=True)
        path = f"{self.local()}/{name}"
        with open(temporary := f"{path}.{uuid.uuid4().hex}", "wb") as f:
            f.write(np.ascontiguousarray(array).tobytes())
        os.replace(temporary, path)

    def read(self, name: str, kind: str) -> np.ndarray:
        """An array as it lies in its file; empty where no word or context fell into its bucket."""
        if name not in self.open:
            path = f"{self.local()}/{name}"
            self.open[name] = np.memmap(path, kind, "r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, kind)
        return self.open[name]

    def lookup(self, table: str, keys: np.ndarray, column: str, kind: str, missing: float) -> np.ndarray:
        """Values of sorted distinct keys; missing where the table lacks one."""
        out = np.full(len(keys), missing, kind)
        for b, first, last in _runs(_bucket(keys, self.buckets)):
            have = self.read(f"{table}-{b}", "<u8")
            at = np.searchsorted(have, keys[first:last])
            at[at == len(have)] = 0
            known = np.flatnonzero(have[at] == keys[first:last]) if len(have) else np.zeros(0, np.int64)
            out[first + known] = self.read(f"{column}-{b}", kind)[at[known]]
        return out


class KneserNey:
    """Totals of a trained model, small enough to send along, and its files."""

    def __init__(self, files: ModelFiles, tokens: int, types: int, kinds: int, pair_discounts: tuple, word_discounts: tuple, taken: float):
        self.files, self.tokens, self.types, self.kinds = files, tokens, types, kinds
        self.pair_discounts, self.word_discounts, self.many = pair_discounts, word_discounts, MANY
        # What the words' discounts leave over is spread over all types and one unknown word.
        self.unseen = taken / kinds / (types + 1) if kinds else 1.0


def train(texts: DataFrame, text_col: str = "text", bucket_words: int = BUCKET_WORDS) -> KneserNey:
    """Count and write a model of all texts (null: empty).

    The bigrams are shuffled once; a bucket's task merges its blocks, writes the
    counts as sorted arrays and passes on what the words' buckets need.
    Discounts depend on all counts, so scoring applies them.
    """
    spark = texts.sparkSession
    texts = texts.select(F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    buckets = max(1, -(-size // (6 * bucket_words)))
    files, most = ModelFiles(f"{shared_dir(spark)}/kneser-ney-{uuid.uuid4().hex}", buckets), MANY

    def write_bigrams(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        c, w, n = _merge_bigrams(table["block"].to_pylist())
        (words,), kinds = _counted(w)
        _, uses = _counted(w, weights=n)
        first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        files.write(f"context-{bucket}", c[first])
        files.write(f"whole-{bucket}", np.add.reduceat(n, first).astype("<i8"))
        for k, met in enumerate((n == 1, n == 2, n >= 3)):
            files.write(f"met{k + 1}-{bucket}", np.add.reduceat(met.astype(np.int64), first).astype("<u4"))
        # Bigrams stay in their context's bucket, in order of their own hashes.
        pair = _pair(c, w)
        order = np.argsort(pair)
        files.write(f"pair-{bucket}", pair[order])
        files.write(f"times-{bucket}", np.minimum(n[order], most).astype("<u4"))
        # The few counts from MANY on stand beside it, by their place.
        many = np.flatnonzero(n[order] >= most)
        files.write(f"many-{bucket}", np.stack([many, n[order][many]], axis=1).astype("<i8"))
        rows = [(b, _pack(words[i:j], kinds[i:j].astype("<i8"), uses[i:j].astype("<i8")), [0] * 4) for b, i, j in _runs(_bucket(words, buckets))]
        rows.append((-1, None, [int((n == k).sum()) for k in (1, 2, 3, 4)]))
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["bucket", "block", "met"])

    words = materialize(_bigram_blocks(texts, buckets).groupBy("bucket").applyInArrow(write_bigrams, "bucket int, block binary, met array<long>"), "words")
    met = words.where("bucket < 0").select(*[F.sum(F.col("met")[k]).alias(f"m{k}") for k in range(4)]).first()

    def write_words(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        got = [_unpack(x, "<u8", "<i8", "<i8") for x in table["block"].to_pylist()]
        keys, kinds, uses = (np.concatenate([g[i] for g in got]) for i in range(3))
        (own,), kinds_ = _counted(keys, weights=kinds)
        uses_ = _counted(keys, weights=uses)[1]
        files.write(f"word-{bucket}", own)
        files.write(f"kinds-{bucket}", kinds_.astype("<i8"))
        files.write(f"uses-{bucket}", uses_.astype("<i8"))
        return pa.table({"types": [len(own)], "kinds": [int(kinds_.sum())], "tokens": [int(uses_.sum())]} | {f"m{k}": [int((kinds_ == k).sum())] for k in (1, 2, 3, 4)})

    counted = words.where("bucket >= 0").groupBy("bucket").applyInArrow(write_words, "types long, kinds long, tokens long, m1 long, m2 long, m3 long, m4 long")
    t = counted.groupBy().sum().toDF("types", "kinds", "tokens", "m1", "m2", "m3", "m4").first()
    types, kinds, tokens, *m = (t[k] or 0 for k in ("types", "kinds", "tokens", "m1", "m2", "m3", "m4"))
    below = _discounts(*m)
    taken = below[0] * m[0] + below[1] * m[1] + below[2] * (types - m[0] - m[1])
    return KneserNey(files, tokens, types, kinds, _discounts(*[x or 0 for x in met]), below, taken)


def score(documents: DataFrame, model: KneserNey, text_col: str = "text") -> DataFrame:
    """All rows and columns of documents with the struct _lm: n_tokens, n_known, base_score and score, both log10.

    base_score is the add-one unigram model's. Null texts count as empty: one
    token, the end. Equal texts score alike; an empty table gives no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("n_tokens long, n_known long, base_score double, score double")
    def run(text: pd.Series) -> pd.DataFrame:
        return pd.concat([score_texts(shared.value, group) for _, group in slices_of_texts(text.fillna("").tolist(), SCORED_CHARS)] or [score_texts(shared.value, [])])

    return documents.withColumn("_lm", run(text_col))


def score_texts(m: KneserNey, texts: list[str]) -> pd.DataFrame:
    context, token, own = _tokens(pa.array(texts, pa.large_string()))
    words, at = np.unique(token, return_inverse=True)
    uses = m.files.lookup("word", words, "uses", "<i8", 0)
    kinds = m.files.lookup("word", words, "kinds", "<i8", 0)
    share = np.where(kinds > 0, (kinds - _discount(np.maximum(kinds, 1), m.word_discounts)) / max(m.kinds, 1), 0) + m.unseen
    heads, head = np.unique(context, return_inverse=True)
    whole = m.files.lookup("context", heads, "whole", "<i8", 0)
    spared = sum(d * m.files.lookup("context", heads, f"met{k + 1}", "<u4", 0) for k, d in enumerate(m.pair_discounts))
    rest = np.where(whole > 0, spared / np.maximum(whole, 1), 1.0)
    pair, home = _pair(context, token), _bucket(heads, m.files.buckets)[head]
    order = np.lexsort((pair, home))
    pair, home = pair[order], home[order]
    found = np.zeros(len(pair), np.int64)
    for b, i, j in _runs(home):
        have = m.files.read(f"pair-{b}", "<u8")
        if len(have):
            place = np.searchsorted(have, pair[i:j])
            place[place == len(have)] = 0
            known = np.flatnonzero(have[place] == pair[i:j])
            times = m.files.read(f"times-{b}", "<u4")[place[known]].astype(np.int64)
            if (times >= m.many).any():
                many = m.files.read(f"many-{b}", "<i8").reshape(-1, 2)
                large = np.flatnonzero(times >= m.many)
                times[large] = many[np.searchsorted(many[:, 0], place[known][large]), 1]
            found[order[i:j][known]] = times
    own_share = np.where(found > 0, found - _discount(np.maximum(found, 1), m.pair_discounts), 0) / np.maximum(whole[head], 1)
    probability = own_share + rest[head] * share[at]
    first = np.cumsum(own) - own

    def sums(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, first) if len(first) else np.zeros(0)

    base = np.log10((uses + 1.0) / (m.tokens + 1.0 * (m.types + 1)))
    return pd.DataFrame({"n_tokens": own, "n_known": sums((uses > 0).astype(np.int64)[at]).astype(np.int64), "base_score": sums(base[at]), "score": sums(np.log10(probability))})
