"""Best-two-fit packing of tokenised documents into fixed-length sequences.

Packing depends on piece lengths alone, so the bins are planned from the
histogram of lengths (at most ``max_len`` counts, whatever the corpus): each
step builds one bin and repeats it as often as the counts allow. Every piece
then finds its bin from its rank among pieces of its length, without any task
or the driver seeing more than the histogram.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_buffer, worker_cache

#: Words whose ids one Python worker keeps; beyond it the kept words are dropped and gathered anew.
CACHE_WORDS = 400_000

#: Bytes of text split at once; the work takes some 20 times as much memory.
SPLIT_BYTES = 4 << 20

_BLANK = bytes.maketrans(b"\t\n\r", b"   ")
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class WordIds(dict):
    """Ids (little-endian uint32 bytes) of blank-delimited chunks, by lower-cased word where a chunk is a word and signs.

    The tokenizer never merges over white space, so a text's ids are those of
    its chunks in order. Chunks of Latin letters followed by ASCII signs
    go straight to the tokenizer's BPE model, which is the same result without
    the per-call cost; all others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.signs: dict[str, bytes] = {}
        self.plain = '"end_of_word_suffix":"</w>"' in self.tokenizer.to_str() and '"Lowercase"' in self.tokenizer.to_str()

    def __missing__(self, chunk: str) -> bytes:
        m = _PLAIN.fullmatch(chunk) if self.plain and chunk else None
        if m is None:
            return self.keep(chunk, self.tokenizer.encode(chunk, add_special_tokens=False).ids if chunk else [])
        word, signs = m[1].lower(), m[2]
        ids = self.get(word)
        if ids is None:
            ids = self.keep(word, [x.id for x in self.model.tokenize(self.spell(word))])
        return ids + self.sign_ids(signs) if signs else ids

    def keep(self, chunk: str, ids: list[int]) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[chunk] = out = array("I", ids).tobytes()
        return out

    def sign_ids(self, signs: str) -> bytes:
        if signs not in self.signs:
            if len(self.signs) >= CACHE_WORDS:
                self.signs.clear()
            self.signs[signs] = array("I", [x.id for x in self.model.tokenize(signs)]).tobytes()
        return self.signs[signs]

    def spell(self, word: str) -> str:
        return word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))

    def encode(self, text: str) -> bytes:
        return self.encode_column(pa.array([text], pa.string()))[0].tobytes()

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts, one after another, and the n + 1 places where texts begin and end.

        Texts are split in spans of bounded bytes that end at white space or a
        text's end; a span's distinct chunks are looked up once.
        """
        data, offsets = text_buffer(column)
        bounds, counts, found = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(0, np.uint32)]
        at = before = 0
        while at < len(data):
            end = _span_end(data, offsets, at)
            inside = np.unique(offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, end)])
            own = np.r_[at, inside, end]
            texts = pa.LargeStringArray.from_buffers(len(own) - 1, pa.py_buffer(own - at), pa.py_buffer(_blanked(data[at:end])))
            lists = pc.split_pattern(texts, " ")
            chunks = lists.flatten().dictionary_encode()
            ids = [self[chunk] for chunk in chunks.dictionary.to_pylist()]
            each = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            code = chunks.indices.to_numpy()
            n = each[code]
            total = np.r_[0, np.cumsum(n)]
            place = np.repeat((np.cumsum(each) - each)[code] - total[:-1], n) + np.arange(total[-1])
            found.append(np.frombuffer(b"".join(ids), "<u4")[place])
            bounds.append(own[1:])
            counts.append(before + total[np.cumsum(lists.value_lengths().to_numpy())])
            before += int(total[-1])
            at = end
        return np.concatenate(found), np.concatenate(counts)[np.searchsorted(np.concatenate(bounds), offsets)]


def _span_end(data: np.ndarray, offsets: np.ndarray, at: int) -> int:
    """The last place within SPLIT_BYTES where a text ends or a chunk begins, or the first one beyond."""
    end = at + SPLIT_BYTES
    if end >= len(data):
        return len(data)
    last = max(int(offsets[np.searchsorted(offsets, end, "right") - 1]), at + 1 + _blanked(data[at:end]).rfind(b" "))
    while last <= at:
        stop = int(offsets[np.searchsorted(offsets, end, "right")])
        first = _blanked(data[end : min(end + SPLIT_BYTES, stop)]).find(b" ")
        last = end + first + 1 if first >= 0 else stop if stop <= end + SPLIT_BYTES else at
        end += SPLIT_BYTES
    return last


def _blanked(data: np.ndarray) -> bytes:
    return data.tobytes().translate(_BLANK)


def plan_bins(histogram: dict[int, int], max_len: int) -> tuple[pd.DataFrame, int]:
    """Best-two-fit over a histogram of lengths.

    A bin takes the longest piece left and then, as long as any fits, the
    longest that fits the gap. If a gap remains, the bin's smallest piece is
    taken out and the two pieces whose sum fills the wider gap best go in,
    if they fill more than it did. The bin is repeated while counts last.

    Returns rows (length, rank, sequence, each, offset): from that rank among
    the pieces of that length on, ``each`` of them go to every sequence from
    ``sequence`` on, at ``offset``; and the number of sequences.
    """
    left = np.zeros(max_len + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    used = np.zeros(max_len + 1, np.int64)
    sizes = np.arange(max_len + 1)
    rows: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    while left.any():
        bin_: list[int] = []
        gap, spare = max_len, left.copy()
        while gap:
            below = np.flatnonzero(spare[1 : gap + 1])
            if not len(below):
                break
            length = int(below[-1]) + 1
            take = min(gap // length, int(spare[length]))
            bin_ += [length] * take
            spare[length] -= take
            gap -= length * take
        if gap and len(bin_) > 1:
            smallest, wide = bin_[-1], gap + bin_[-1]
            spare[smallest] += 1
            present = np.where(spare > 0, sizes, 0)
            nearest = np.maximum.accumulate(present)
            first = present[1:wide][present[1:wide] > 0]
            second = nearest[wide - first]
            second = np.where((second == first) & (spare[first] < 2), nearest[np.maximum(second - 1, 0)], second)
            total = np.where(second > 0, first + second, 0)
            if len(total) and total.max() > smallest:
                best = int(total.argmax())
                bin_[-1:] = [int(first[best]), int(second[best])]
        each = np.bincount(bin_, minlength=max_len + 1)
        kinds = np.flatnonzero(each)
        times = int((left[kinds] // each[kinds]).min())
        offset = 0
        for length in sorted(kinds.tolist(), reverse=True):
            n = int(each[length])
            rows.append((length, int(used[length]), sequence, n, offset))
            offset += n * length
            used[length] += times * n
            left[length] -= times * n
        sequence += times
    return pd.DataFrame(rows, columns=["length", "rank", "sequence", "each", "offset"], dtype=np.int64), sequence


def tokenize_pieces(documents: DataFrame, tokenizer_path: str, max_len: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Cut each document's ids into pieces of at most max_len: (doc_id, piece, start, length, ids_crc32, part, nth[, ids]).

    ``nth`` counts the pieces of one length within one task (``part``), so write the result before use.
    """
    schema = f"doc_id {documents.schema[id_col].dataType.simpleString()}, piece int, start long, length int, ids_crc32 long, part int, nth long" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = worker_cache(tokenizer_path, lambda: WordIds(tokenizer_path)), TaskContext.get().partitionId()
        seen = np.zeros(max_len + 1, np.int64)
        for batch in batches:
            ids, ends = words.encode_column(batch.column(1))
            ids = np.insert(ids, ends[1:], end_id).astype("<u4")
            sizes = np.diff(ends) + 1
            pieces = -(-sizes // max_len)
            doc = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            length = np.minimum(sizes[doc] - piece * max_len, max_len)
            bound = np.r_[0, np.cumsum(length)]
            view = memoryview(ids)
            crc = [zlib.crc32(view[a:b]) for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())]
            # The rank among pieces of the length, in order of arrival.
            order = np.argsort(length, kind="stable")
            many = np.bincount(length, minlength=max_len + 1)
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(order)) - np.repeat(np.cumsum(many) - many, many)
            nth += seen[length]
            seen += many
            columns = [pa.array(piece, pa.int32()), pa.array(piece * max_len), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part), pa.int32()), pa.array(nth)]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(ids.view("<i4"))))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), *columns], names=[x.split()[0] for x in schema.split(", ")])

    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def best_two_fit_pack(documents: DataFrame, tokenizer_path: str, max_len: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most max_len ids.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset and, with keep_ids, the ids. A null or empty text is the end id
    alone; only documents longer than max_len are cut; repeated rows are packed
    each; an empty table gives no rows. Other columns are not read.
    """
    pieces = materialize(tokenize_pieces(documents, tokenizer_path, max_len, end_id, id_col, text_col, keep_ids), "pieces")
    by_part = materialize(pieces.groupBy("part", "length").agg((F.max("nth") + 1).alias("n")), "piece-counts")
    plan, _ = plan_bins({r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}, max_len)
    plan = plan.sort_values(["length", "rank"])
    key = (plan["length"].to_numpy() << 48) + plan["rank"].to_numpy()
    table = documents.sparkSession.sparkContext.broadcast((key, *(plan[c].to_numpy() for c in ("rank", "sequence", "each", "offset"))))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, first, sequence, each, offset = table.value
        size, nth = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(keys, (size << 48) + nth, "right") - 1
        k = nth - first[at]
        return pd.DataFrame({"sequence_id": sequence[at] + k // each[at], "offset": offset[at] + k % each[at] * size})

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = pieces.join(base, ["part", "length"]).withColumn("at", place("length", F.col("base") + F.col("nth")))
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "at.sequence_id", "at.offset", *["ids"] * keep_ids)
