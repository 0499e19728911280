"""Toxicity by a support vector machine with a gapped subsequence string kernel and Nyström landmarks, trained on labelled sentences.

The kernel of two words is that of the letter triples they share as
subsequences within a short span, each weighted by a decay per letter skipped,
scaled to one for a word with itself; so spellings with inserted or left-out
letters stay near. The kernel of two phrases is the sum over their pairs of
words, scaled by the roots of their lengths. A sentence is as toxic as its most
toxic phrase of a few words, and a text as its most toxic sentence.

Labels are of texts: all sentences of a clean text are clean, and some sentence
of a toxic text is toxic. Training begins with all sentences of toxic texts as
examples; then, round by round, each toxic text gives the sentences and phrases
that the machine finds more toxic than nearly all clean texts, and each clean
text the one that it finds hardest.
The machine works on the Nyström features of landmark phrases; its decision
function is linear in triples, so a word is scored from one table, and a phrase
from its words.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_worker_cache, fit_in_task, materialize, worker_cache
from .wordrows import COMPUTED, WordRows, codes_of, slices_of_texts

#: Learning texts at most, toxic and clean.
TOXIC_TEXTS = 2000
CLEAN_TEXTS = 5000
LANDMARKS = 512
#: Letters a triple spans at most, and the weight of each letter skipped in it.
SPAN = 5
DECAY = 0.5
#: Words of a phrase at most.
PHRASE = 3
#: Scores from here on are predicted toxic.
THRESHOLD = 0.7
#: Rounds of choosing toxic texts' sentences after the first, which takes them all.
ROUNDS = 3
#: Different sentences that a phrase's strongest word has to be in for the phrase to teach.
WITNESSES = 5


@dataclass(frozen=True)
class Learning:
    """Bounds of the examples that a fit works on; the texts and rounds they come from are all looked through."""

    #: Sentences of either label in the first round; clean phrases by chance in each later one.
    sentences: int = 4000
    #: Words that landmarks are chosen from in the first round.
    candidates: int = 1500
    #: Words of toxic phrases that also teach with a letter inserted, and spellings of each.
    misspelt: int = 100
    spellings: int = 6


_ALPHABET = 96
_TRIPLES = _ALPHABET**3
_OTHER = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_LOOK = str.maketrans(_OTHER)
#: Three or more single characters with white space between: a word spelled out.
_SPELLED = re.compile(r"(?<!\S)[^\W_](?:\s+[^\W_](?!\S)){2,}")
_END = (".", "!", "?", "\u3002", "\uff01", "\uff1f")


def fold(word: str) -> str:
    """A token's letters, lower-case and without accents; digits and signs that stand for letters between letters count as those."""
    low = word.lower()
    if not (low.isascii() and low.isalpha()):
        if any(c in _OTHER for c in low.strip("!$@.,;:?")) and any(c.isalpha() for c in low):
            low = low.strip("!$@.,;:?").translate(_LOOK)
        low = "".join(c for c in unicodedata.normalize("NFKD", low) if c.isalpha())
    return low


def tokens(text: str) -> list[str]:
    """A text's words, and after them those it spells out letter by letter, each a sentence of its own."""
    words = text.split()
    for m in _SPELLED.finditer(text):
        words += [".", "".join(m[0].split()) + "."]
    return words


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, triple, weight) of all distinct triples of folded words, weights summed per word and scaled to length 1."""
    codes, lengths = codes_of([f"^{w}$" for w in words])
    codes = codes.astype(np.int64)
    # a to z, the word's ends, and all other letters in 68 codes, which keeps those of one alphabet apart.
    letter = np.where((codes >= 97) & (codes <= 122), codes - 97, np.where(codes == 94, 26, np.where(codes == 36, 27, 28 + codes % 68)))
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
    who, what, weight = [], [], []
    for span in range(3, SPAN + 1):
        first = np.flatnonzero(left >= span)
        for middle in range(1, span - 1):
            who.append(owner[first])
            what.append((letter[first] * _ALPHABET + letter[first + middle]) * _ALPHABET + letter[first + span - 1])
            weight.append(np.full(len(first), DECAY ** (span - 3)))
    who, what, weight = map(np.concatenate, (who, what, weight))
    key, at = np.unique(who * _TRIPLES + what, return_inverse=True)
    total = np.bincount(at, weight, len(key))
    who, what = key // _TRIPLES, key % _TRIPLES
    norm = np.sqrt(np.bincount(who, total * total, len(words)))
    return who, what, total / norm[who]


def _weighted_sums(table: np.ndarray, rows: np.ndarray, weight: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per group, of so many rows each, the sum of the table's rows times their weights; the k-th rows of all groups go together."""
    order = np.argsort(-sizes, kind="stable")
    first, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
    got = np.zeros((len(sizes), table.shape[1]), np.float32)
    for k in range(int(sizes[0]) if len(sizes) else 0):
        at = first[: int(np.searchsorted(-sizes, -k, "left"))] + k
        got[: len(at)] += table[rows[at]] * weight[at, None]
    out = np.empty_like(got)
    out[order] = got
    return out


def _products(words: list[str], used: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sums over the words' triples of their weights times the table's rows, which are of the used triples in order."""
    out = np.zeros((len(words), table.shape[1]), np.float32)
    for at in range(0, len(words), 512):
        who, what, weight = triples(words[at : at + 512])
        place = np.minimum(np.searchsorted(used, what), len(used) - 1)
        known = used[place] == what
        out[at : at + 512] = _weighted_sums(table, place[known], weight[known].astype(np.float32), np.bincount(who[known], minlength=len(words[at : at + 512])))
    return out


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """The normalised gapped subsequence kernel of words with landmarks."""
    return phrase_features([(w,) for w in words], [(w,) for w in landmarks])


def misspelt(word: str, rng: np.random.Generator, n: int) -> list[str]:
    """Spellings of a word with a letter inserted or doubled."""
    out = []
    for at in rng.integers(1, len(word), n).tolist():
        letter = word[at - 1] if rng.random() < 0.3 else chr(97 + int(rng.integers(26)))
        out.append(word[:at] + letter + word[at:])
    return out


def diverse(words: list[str], n: int) -> list[str]:
    """Up to n words that span the others best: pivoted Cholesky of their kernel matrix."""
    if not words:
        return []
    near = kernel(words, words)
    left, rows, out = np.ones(len(words)), np.zeros((0, len(words))), []
    while len(out) < min(n, len(words)) and left.max() > 1e-3:
        pick = int(left.argmax())
        row = (near[pick] - rows.T @ rows[:, pick]) / np.sqrt(left[pick])
        rows = np.vstack([rows, row])
        left = np.maximum(left - row * row, 0)
        left[pick] = 0
        out.append(words[pick])
    return out


def squared_hinge(z: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear SVM (squared hinge, cost c per row) by Newton steps."""
    z = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.r_[np.ones(z.shape[1] - 1), 1e-3]
    for _ in range(rounds):
        slack = 1 - y * (z @ w)
        on = slack > 0
        gradient = ridge * w - 2 * z.T @ np.where(on, c * y * slack, 0)
        root = z[on] * np.sqrt(c[on])[:, None]
        hessian = np.diag(ridge) + 2 * root.T @ root
        del root
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def phrase_features(phrases: list[tuple[str, ...]], landmarks: list[tuple[str, ...]]) -> np.ndarray:
    """The kernel of phrases with landmarks, both of folded words: summed over pairs of words, scaled by the roots of the lengths."""
    owner = np.repeat(np.arange(len(landmarks)), [len(m) for m in landmarks])
    who, what, weight = triples([w for m in landmarks for w in m])
    used, row = np.unique(what, return_inverse=True)
    table = np.zeros((len(used), len(landmarks)), np.float32)
    np.add.at(table, (row, owner[who]), weight / np.sqrt([len(m) for m in landmarks])[owner[who]])
    out = np.zeros((len(phrases), len(landmarks)))
    for at in range(0, len(phrases), 2048):
        some = phrases[at : at + 2048]
        sizes = np.array([len(p) for p in some])
        words, place = np.unique([w for p in some for w in p], return_inverse=True)
        rows = _products(words.tolist(), used, table)
        out[at : at + 2048] = _weighted_sums(rows, place, np.ones(len(place), np.float32), sizes) / np.sqrt(sizes)[:, None]
    return out


def best_phrases(weight: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text its most toxic phrase's (sum of weights over the root of its words, last word, words); no phrase crosses a sentence's end.

    weight and ends are of all texts' words after each other, counts the words
    of each text. A text without a word gives (0, -1, 0).
    """
    n = len(weight)
    first = np.cumsum(counts) - counts
    begins = np.r_[True, ends[:-1]][:n]
    begins[first[counts > 0]] = True
    best, size = weight.astype(np.float64), np.ones(n, np.int64)
    total, inside = best.copy(), np.ones(n, bool)
    for words in range(2, min(PHRASE, n) + 1):
        total[words - 1 :] += weight[: n - words + 1]
        inside = ~begins & np.r_[False, inside[:-1]]
        value = np.where(inside, total / np.sqrt(words), -np.inf)
        better = value > best
        best, size = np.where(better, value, best), np.where(better, words, size)
    out, last, length = np.zeros(len(counts)), np.full(len(counts), -1), np.zeros(len(counts), np.int64)
    some = np.flatnonzero(counts)
    if len(some):
        top = np.maximum.reduceat(best, first[some])
        hit = np.flatnonzero(best == np.repeat(top, counts[some]))
        who = np.repeat(np.arange(len(some)), counts[some])[hit]
        one = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        out[some], last[some], length[some] = top, hit[one], size[hit[one]]
    return out, last, length


@dataclass
class ToxicityModel:
    table: np.ndarray
    offset: float
    slope: float
    shift: float
    key: str
    #: Phrases and their weights, of which table and offset are the sum.
    landmarks: list[tuple[str, ...]] = field(default_factory=list)
    beta: np.ndarray | None = None

    def word_weights(self, folded: list[str]) -> np.ndarray:
        """Folded words' part of the decision function."""
        out = np.zeros(len(folded))
        for at in range(0, len(folded), COMPUTED):
            some = folded[at : at + COMPUTED]
            who, what, weight = triples(some)
            out[at : at + COMPUTED] = np.bincount(who, weight * self.table[what], len(some))
        return out

    def word_rows(self, words: list[str]) -> np.ndarray:
        """Per token its weight (0 for less than three letters) and whether it ends a sentence."""
        folded = list(map(fold, words))
        out = np.zeros((len(words), 2), np.float32)
        has = [i for i, w in enumerate(folded) if len(w) > 2]
        if has:
            out[has, 0] = self.word_weights([folded[i] for i in has])
        out[:, 1] = [w.endswith(_END) for w in words]
        return out

    def text_margins(self, texts: list[str]) -> np.ndarray:
        rows = worker_cache(self.key, lambda: WordRows(self.word_rows, 2))
        out = np.zeros(len(texts))
        for first, group in slices_of_texts(texts):
            index, counts = rows.of([tokens(t) for t in group])
            got = rows.rows[index]
            out[first : first + len(group)] = best_phrases(got[:, 0], got[:, 1] > 0, counts)[0]
        return out + self.offset

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.text_margins(texts) + self.shift, -30, 30)))


class _Sample:
    """Learning texts as numbers of folded words (-1: of less than three letters), by sentence."""

    def __init__(self, texts: list[str]):
        known: dict[str, int] = {}
        seen: dict[str, tuple[int, bool]] = {}
        index, ends, counts = [], [], []
        for text in texts:
            words = tokens(text or "")
            for w in words:
                if w not in seen:
                    low = fold(w)
                    seen[w] = (known.setdefault(low, len(known)) if len(low) > 2 else -1, w.endswith(_END))
            got = [seen[w] for w in words]
            index.append(np.fromiter((g[0] for g in got), np.int32, len(got)))
            ends.append(np.fromiter((g[1] for g in got), bool, len(got)))
            counts.append(len(got))
        self.words = list(known)
        self.index = np.concatenate(index) if index else np.zeros(0, np.int32)
        self.ends = np.concatenate(ends) if ends else np.zeros(0, bool)
        self.counts = np.array(counts, np.int64)
        self.first = np.cumsum(self.counts) - self.counts

        stop = self.ends.copy()
        stop[(self.first + self.counts - 1)[self.counts > 0]] = True
        self.end = np.flatnonzero(stop) + 1
        self.begin = np.r_[0, self.end[:-1]][: len(self.end)]
        #: Each sentence's text.
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)[self.begin]

    def phrase(self, begin: int, end: int) -> tuple[str, ...]:
        return tuple(self.words[i] for i in self.index[begin:end].tolist() if i >= 0)

    def top(self, values: np.ndarray) -> np.ndarray:
        """Per text its highest sentence, -1 for a text without a word."""
        out = np.full(len(self.counts), -1)
        order = np.lexsort((-np.arange(len(values)), values))
        out[self.text[order]] = order
        return out


def _machine(landmarks: list[tuple[str, ...]], phrases: list[tuple[str, ...]], target: np.ndarray, cost: np.ndarray) -> ToxicityModel:
    """The machine of weighted examples on the landmarks' Nyström features."""
    values, vectors = np.linalg.eigh(phrase_features(landmarks, landmarks))
    good = values > 1e-6 * values.max()
    project = vectors[:, good] / np.sqrt(values[good])
    features = np.empty((len(phrases), int(good.sum())))
    for at in range(0, len(phrases), 1024):
        features[at : at + 1024] = phrase_features(phrases[at : at + 1024], landmarks) @ project
    w, offset = squared_hinge(features, target, cost)
    beta = project @ w
    table = np.zeros(_TRIPLES)
    for b, m in zip(beta, landmarks):
        _, what, weight = triples(list(m))
        np.add.at(table, what, weight * (b / np.sqrt(len(m))))
    return ToxicityModel(table.astype(np.float32), offset, 1.0, 0.0, uuid.uuid4().hex, landmarks, beta)


def fit_toxicity(texts: list[str], toxic: list[int], landmarks: int = LANDMARKS, rounds: int = ROUNDS, learning: Learning = Learning()) -> ToxicityModel | None:
    """Fit on labelled texts; None without a word of three letters in texts of either label."""
    y = np.array(toxic, dtype=np.int64) > 0
    sample, rng = _Sample(texts), np.random.default_rng(0)
    of_toxic = y[sample.text]

    def some(sentences: np.ndarray, n: int) -> list[tuple[str, ...]]:
        pick = rng.permutation(sentences)[:n]
        return [p for i in pick.tolist() if (p := sample.phrase(sample.begin[i], sample.end[i]))]

    positives, negatives = some(np.flatnonzero(of_toxic), learning.sentences), some(np.flatnonzero(~of_toxic), learning.sentences)
    if not positives or not negatives:
        return None
    # The first landmarks: words that many toxic texts hold, as far apart as may be.
    held = Counter()
    for i in np.flatnonzero(y).tolist():
        held.update(set(sample.index[sample.first[i] : sample.first[i] + sample.counts[i]].tolist()))
    held.pop(-1, None)
    frequent = [sample.words[i] for i, _ in sorted(held.items(), key=lambda x: (-x[1], sample.words[x[0]]))[: learning.candidates]]
    marks = [(w,) for w in diverse(frequent, landmarks)]
    # A sentence of a toxic text is toxic by the share of one in its text.
    target = np.r_[np.ones(len(positives)), -np.ones(len(negatives))]
    cost = np.r_[np.full(len(positives), 1.0), np.full(len(negatives), len(positives) / len(negatives))]
    model = _machine(marks, positives + negatives, target, cost)
    for turn in range(rounds):
        weight = np.r_[model.word_weights(sample.words), 0.0]
        value, last, size = best_phrases(weight[sample.index], sample.ends, sample.end - sample.begin)

        def phrases_of(sentences: np.ndarray) -> Counter:
            return Counter(p for i in sentences.tolist() if (p := sample.phrase(last[i] - size[i] + 1, last[i] + 1)))

        top = sample.top(value)
        top = top[top >= 0]
        # Toxic texts without a phrase above those of nearly all clean texts may bear a wrong label: they teach little.
        usual = np.quantile(value[top[~of_toxic[top]]], 0.95)
        above = np.flatnonzero(of_toxic & (value > usual))
        doubtful = phrases_of(top[of_toxic[top] & (value[top] <= usual)])
        hard = top[~of_toxic[top]]
        clean = phrases_of(hard[np.argsort(-value[hard], kind="stable")])
        # A word that one sentence and its copies bear proves nothing: the strongest words count by different sentences.
        strongest = dict(zip(parts := sorted({w for p in phrases_of(above) for w in p}), model.word_weights(parts)))
        seen_in: dict[str, set[bytes]] = {}
        witness = []
        for i in above.tolist():
            if p := sample.phrase(last[i] - size[i] + 1, last[i] + 1):
                head = max(p, key=strongest.__getitem__)
                seen_in.setdefault(head, set()).add(sample.index[sample.begin[i] : sample.end[i]].tobytes())
                witness.append((p, head))
        told, heads = Counter(), Counter()
        for p, head in witness:
            if len(seen_in[head]) >= WITNESSES:
                told[p] += 1
                heads[head] += 1
            else:
                doubtful[p] += 1
        clear = set(w for p in clean for w in p)
        common = [w for w, _ in sorted(heads.items(), key=lambda x: (-x[1], x[0])) if w not in clear][: learning.misspelt]
        varied = sorted({v for w in common for v in misspelt(w, rng, learning.spellings)} - set(sample.words))
        chance = Counter()
        for i in rng.permutation(np.flatnonzero(~of_toxic))[: learning.sentences].tolist():
            at = int(rng.integers(sample.begin[i], sample.end[i]))
            if p := sample.phrase(at, min(int(sample.end[i]), at + 1 + int(rng.integers(PHRASE)))):
                chance[p] += 1
        groups = [(told, 1.0, 4.0), (Counter((v,) for v in varied), 1.0, 20.0), (doubtful, 1.0, 0.02), (clean, -1.0, 8.0), (chance, -1.0, 4.0)]
        phrases = [p for g, _, _ in groups for p in g]
        if not told:
            break
        target = np.concatenate([np.full(len(g), t) for g, t, _ in groups])
        cost = np.concatenate([np.array(list(g.values()), float) * c for g, _, c in groups])
        # Landmarks: toxic phrases as far apart as may be, then the hardest clean ones, then others by chance.
        marks = [(w,) for w in diverse([w for w, _ in sorted(heads.items(), key=lambda x: (-x[1], x[0]))][: learning.candidates], landmarks // 4)]
        for more, n in (([p for p, _ in told.most_common()], landmarks // 2), (list(clean), 3 * landmarks // 4), (list(chance), landmarks)):
            taken = set(marks)
            marks += [p for p in dict.fromkeys(more) if p not in taken][: n - len(marks)]
        model = _machine(marks, phrases, target, cost)
    # The cut between clean and toxic texts with the best F score, precision counting double.
    weight = np.r_[model.word_weights(sample.words), 0.0].astype(np.float32)
    margins = best_phrases(weight[sample.index], sample.ends, sample.counts)[0] + model.offset
    order = np.argsort(-margins, kind="stable")
    hits, false = np.cumsum(y[order]), np.cumsum(~y[order])
    f = 1.25 * hits / (hits + false + 0.25 * int(y.sum()))
    last = np.r_[margins[order][1:] < margins[order][:-1], True]
    best = int(np.where(last, f, 0).argmax())
    low = margins[order][best + 1] if best + 1 < len(order) else margins[order][best] - 1
    cut = (margins[order][best] + low) / 2
    model.slope = 4.0
    model.shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - model.slope * cut)
    return model


def learn_toxicity(documents: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_texts: int = TOXIC_TEXTS, clean_texts: int = CLEAN_TEXTS) -> ToxicityModel | None:
    """Fit on a bounded sample of the labelled rows where ``learn`` (over the id) holds, those of the smallest hash of the id.

    A document with several labels counts as toxic if one says so; null labels
    and ids are passed over; of several texts of one id the least counts. The
    sample is taken in Spark, the same on every run, and fitted in a task.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & learn).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_toxic"))
    order = [F.xxhash64(F.lit("toxicity"), F.col("_id")), F.col("_id")]
    ids = materialize(known.where("_toxic > 0").orderBy(*order).limit(toxic_texts).unionByName(known.where("_toxic <= 0").orderBy(*order).limit(clean_texts)), "labelled")
    # At most toxic_texts + clean_texts ids, so they can go to every executor.
    rows = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    sample = rows.join(F.broadcast(ids), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.min("_toxic").alias("_toxic"))

    def fit(table: pa.Table) -> ToxicityModel | None:
        table = table.sort_by([("_id", "ascending")])
        drop_worker_cache()
        return fit_toxicity(table["_text"].to_pylist(), table["_toxic"].to_pylist())

    return fit_in_task(sample, fit)


def score_toxicity(documents: DataFrame, model: ToxicityModel | None, text_col: str = "text", into: str = "_toxicity") -> DataFrame:
    """All rows and columns of documents with the double ``into``, from 0 to 1, in place of a column of that name.

    Whole texts count. A null or empty text scores as one without any toxic
    word; without a model all texts score 0; equal texts score alike; an empty
    table gives no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(text.fillna("").tolist()) if shared.value else np.zeros(len(text)))

    # Taken as not deterministic, so that a filter on the score doesn't compute it twice.
    return documents.withColumn(into, score.asNondeterministic()(text_col))
