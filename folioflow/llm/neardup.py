"""Near-duplicates by BagMinHash signatures, banding and exact multiset overlap.

A document is a multiset of word shingles. A BagMinHash signature comes from
Poisson processes, one per shingle and dyadic segment of its count: points fall
in time at the segment's rate, each at a place in the segment and in a slot of
the signature, and count if their place is under the shingle's count. A slot's
value is its earliest point, so two signatures agree in a slot with the
probability of the multisets' weighted Jaccard similarity.

Equal texts become one node first. Nodes that agree in a whole band meet in a
bucket; each is compared with its bucket's centre, the member that most buckets
share, and linked by the exact overlap of multisets. Members of a centre's
buckets that these links leave apart are then compared with each other, in
blocks of bounded size, so that no link between different texts is lost, no
task gets a whole group and copies are never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_slices, free_name, materialize, mix, text_buffer, uniform, with_row_keys, word_hashes

WORDS = 5
SIMILARITY = 0.8
#: Bands and rows of a band. A pair at the least similarity is missed by all bands with a probability below 1e-6.
BANDS = 48
ROWS = 6
#: Nodes on either side of a block of comparisons.
BLOCK = 512
#: Shingles whose points are drawn together.
SLICE = 300_000

_U = np.uint64
_K1, _K2, _K3 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)


def shingles(words: np.ndarray, counts: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count) of the distinct shingles; a document of fewer than n words is one shingle."""
    ends = np.cumsum(counts)
    first = ends - counts
    have = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), have)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(have) - have, have) + first[owner]
    with np.errstate(over="ignore"):
        value = np.full(len(at), _K3, _U)
        for k in range(n):
            inside = at + k < ends[owner]
            value = np.where(inside, mix(value * _K1 + words[np.minimum(at + k, max(len(words) - 1, 0))] if len(words) else value), value)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])][: len(owner)])
    return owner[new], value[new], np.diff(np.r_[new, len(owner)])


def bag_minhash(owner: np.ndarray, value: np.ndarray, count: np.ndarray, documents: int, slots: int) -> np.ndarray:
    """Signatures (document, slot) of multisets: the earliest point's time in each slot, infinite for an empty document."""
    out = np.full((documents, slots), np.inf)
    flat = out.reshape(-1)
    limit = np.full(documents, np.inf)
    for at in range(0, len(owner), SLICE):
        who, what, weight = owner[at : at + SLICE], value[at : at + SLICE], count[at : at + SLICE].astype(np.float64)
        # Segments of a count: [0, 1), [1, 2), [2, 4), [4, 8) and so on, as far as they reach below it.
        levels = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1, 1)
        pick = np.repeat(np.arange(len(who)), levels)
        level = np.arange(len(pick)) - np.repeat(np.cumsum(levels) - levels, levels)
        low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
        rate = np.where(level > 0, low, 1.0)
        who, reach = who[pick], weight[pick] - low
        with np.errstate(over="ignore"):
            seed = mix(what[pick] + _K2 * level.astype(_U))
        time, step = np.zeros(len(who)), 0
        while len(who):
            with np.errstate(over="ignore"):
                draw = mix(seed + _K1 * _U(2 * step + 1))
                other = mix(seed + _K1 * _U(2 * step + 2))
            time = time - np.log(uniform(draw)) / rate
            soon = time <= limit[who]
            if not soon.all():
                who, reach, rate, seed, time, other = who[soon], reach[soon], rate[soon], seed[soon], time[soon], other[soon]
            slot = ((other >> _U(40)) * _U(slots) >> _U(24)).astype(np.int64)
            hit = (other & _U((1 << 32) - 1)).astype(np.float64) * (rate / (1 << 32)) < reach
            np.minimum.at(flat, who[hit] * slots + slot[hit], time[hit])
            step += 1
            if len(who):
                live = np.flatnonzero(np.bincount(who, minlength=documents))
                limit[live] = out[live].max(axis=1)
    return out


def band_hashes(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(document, band) hashes of the signature's bands, apart for each band."""
    bits = signature.view(_U).reshape(len(signature), bands, rows)
    with np.errstate(over="ignore"):
        value = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=_U) * _K2), bits.shape[:2]).copy()
        for r in range(rows):
            value = mix(value * _K1 + bits[:, :, r])
    return value.view(np.int64)


def _lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(values, kind))


def _groups(data_counts: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Documents in order of size, in groups of at most so many words or one document."""
    order = np.argsort(data_counts, kind="stable")
    first, size = 0, 0
    for i, n in enumerate(data_counts[order].tolist()):
        if i > first and (size + n > most or i - first >= 2048):
            yield order[first:i]
            first, size = i, 0
        size += n
    if len(order):
        yield order[first:]


def _text_nodes(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each document's sequence of words."""
    ends = np.cumsum(counts)
    return np.fromiter((xxhash.xxh3_64_intdigest(words[e - n : e].tobytes()) for e, n in zip(ends.tolist(), counts.tolist())), _U, len(counts)).view(np.int64)


def signatures(documents: DataFrame, n_words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, node, bands): node is null and bands empty for documents without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            words, counts = word_hashes(data, offsets)
            nodes, first = _text_nodes(words, counts), np.cumsum(counts) - counts
            out = np.zeros((len(counts), bands), np.int64)
            # Equal texts in a batch are drawn once.
            _, one, again = np.unique(nodes, return_index=True, return_inverse=True)
            for group in _groups(counts[one], SLICE):
                docs = one[group]
                own = counts[docs]
                at = np.repeat(first[docs] - (np.cumsum(own) - own), own) + np.arange(own.sum())
                owner, value, count = shingles(words[at], own, n_words)
                out[docs] = band_hashes(bag_minhash(owner, value, count, len(docs), bands * rows), bands, rows)
            out = out[one[again]]
            full = counts > 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64(), mask=~full), _lists(out[full].ravel(), np.where(full, bands, 0), pa.int64())], names=["doc_id", "node", "bands"])

    return documents.mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, node long, bands array<long>")


def multisets(documents: DataFrame, n_words: int) -> DataFrame:
    """(node, shingles, counts): each document's distinct shingles in order, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for column in column_slices(batch.column(0)):
                words, counts = word_hashes(*text_buffer(column))
                nodes = _text_nodes(words, counts)
                owner, value, count = shingles(words, counts, n_words)
                sizes = np.bincount(owner, minlength=len(counts))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), _lists(value.view(np.int64), sizes, pa.int64()), _lists(count, sizes, pa.int32())], names=["node", "shingles", "counts"])

    return documents.select("text").mapInArrow(run, "node long, shingles array<long>, counts array<int>")


def _links(table: pa.Table, similarity: float, forest: bool) -> list[tuple[int, int]]:
    """Pairs of an asking row and another at the similarity or more, by exact overlap; with forest, only those that join groups."""
    asks = table["asks"].to_numpy()
    nodes = table["node"].to_numpy()
    groups = table["class"].to_numpy() if forest else nodes
    lists, counts = table["shingles"].combine_chunks(), table["counts"].combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists, counts = lists.chunk(0), counts.chunk(0)
    ends = np.asarray(lists.offsets)
    value, count = np.asarray(lists.flatten()), np.asarray(counts.flatten()).astype(np.int64)
    ends = ends - ends[0]
    lengths = np.diff(ends)
    others = np.flatnonzero(~asks)
    inside = np.repeat(~asks, lengths)
    row = np.repeat(np.cumsum(~asks) - 1, lengths)[inside]
    value_o, count_o = value[inside], count[inside]
    order = np.argsort(value_o, kind="stable")
    value_o, count_o, row = value_o[order], count_o[order], row[order]
    total = np.bincount(row, count_o, len(others)).astype(np.int64)
    parent = {int(g): int(g) for g in np.unique(groups)}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for i in np.flatnonzero(asks).tolist():
        own, times = value[ends[i] : ends[i + 1]], count[ends[i] : ends[i + 1]]
        low, high = np.searchsorted(value_o, own, "left"), np.searchsorted(value_o, own, "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(row[at], np.minimum(count_o[at], np.repeat(times, n)), len(others)).astype(np.int64)
        near = np.flatnonzero(both >= similarity * (total + int(times.sum()) - both) - 1e-9)
        for j in others[near].tolist():
            if forest:
                a, b = root(int(groups[i])), root(int(groups[j]))
                if a == b:
                    continue
                parent[a] = b
            if nodes[i] != nodes[j]:
                found.append((int(nodes[i]), int(nodes[j])))
    return found


def compare(tasks: DataFrame, bags: DataFrame, similarity: float, forest: bool) -> DataFrame:
    """Links (a, b) found in each block of tasks (centre, block, turn, asks, node, class)."""

    def run(table: pa.Table) -> pa.Table:
        found = _links(table, similarity, forest)
        return pa.table([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return tasks.join(bags, "node").groupBy("centre", "block", "turn").applyInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, class) of all linked nodes, class being the least node reached, by large-star and small-star rounds."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _digest(edges)
    while True:
        # Large star: every larger neighbour of a node goes to the node's least neighbour.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node and its smaller neighbours go to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = materialize(small, "links")
        after = _digest(now)
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("class")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("class")).distinct())
        edges, before = now, after


def _digest(edges: DataFrame) -> tuple:
    """Number of distinct edges and two sums over them, which differ for different edges."""
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())


def near_duplicate_classes(documents: DataFrame, similarity: float = SIMILARITY, n_words: int = WORDS, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, copies): one row per document; class_id is the least doc_id of its class, copies the documents of equal words.

    Words are runs without white space, A-Z lower-cased. Two documents are
    linked if the multisets of their n_words-word shingles overlap by
    similarity or more of their union; classes are connected by links. A text
    of fewer words is one shingle. A null or empty text is a class of its own,
    as is any row without an id; repeated rows are copies; an empty table gives
    no rows. Other columns are not read.
    """
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(signatures(docs, n_words, bands, rows), "signatures")
    buckets = signed.select("node", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("band")
    members = materialize(buckets.join(shared, "band").select("band", "node").distinct(), "members")
    # Sums per band and per centre are written before they are joined, so that each join has its own exchange, of which Spark splits a hot band or centre.
    sizes = materialize(members.groupBy("band").agg(F.count("*").alias("n")), "band-sizes")
    weights = members.join(sizes, "band").groupBy("node").agg(F.sum("n").alias("weight"))
    centres = materialize(members.join(weights, "node").groupBy("band").agg(F.max(F.struct("weight", "node")).alias("top")).select("band", F.col("top.node").alias("centre")), "centres")
    stars = materialize(members.join(centres, "band").where("node <> centre").select("centre", "node").distinct(), "stars")
    met = stars.select("node").unionByName(stars.select(F.col("centre").alias("node"))).distinct()
    first = signed.where("node is not null and doc_id is not null").join(met, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    bags = materialize(multisets(docs.join(first.select("doc_id").distinct(), "doc_id"), n_words).dropDuplicates(["node"]), "multisets")

    blocks = materialize(stars.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    dealt = stars.join(blocks, "centre").select("centre", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("turn"), F.lit(False).alias("asks"), "node")
    asked = blocks.select("centre", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("turn"), F.lit(True).alias("asks"), F.col("centre").alias("node"))
    links = materialize(compare(dealt.unionByName(asked), bags, similarity, False), "star-links")
    classes = components(links)

    # Members of a centre's buckets in other classes than most of them are compared with all the members.
    inside = materialize(stars.join(classes, "node", "left").select("centre", "node", F.coalesce("class", "node").alias("class")), "inside")
    by_class = inside.groupBy("centre", "class").agg(F.count("*").alias("n"))
    most = by_class.groupBy("centre").agg(F.max(F.struct("n", "class")).alias("top"), F.count("*").alias("classes"), F.sum("n").alias("all")).where("classes > 1")
    open_ = materialize(most.select("centre", F.col("top.class").alias("most"), F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("turns")), "open")
    apart = inside.join(open_, "centre")
    dealt = apart.select("centre", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), F.lit(False).alias("asks"), "node", "class")
    asked = apart.where(F.col("class") != F.col("most")).select("centre", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64(F.lit(1), "node"), F.col("turns")).cast("int").alias("turn"), F.lit(True).alias("asks"), "node", "class")
    more = materialize(compare(dealt.unionByName(asked), bags, similarity, True), "block-links")
    if not more.isEmpty():
        classes = components(classes.select(F.col("node").alias("a"), F.col("class").alias("b")).unionByName(more))

    nodes = signed.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    nodes = nodes.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    heads = nodes.groupBy("class").agg(F.min("least").alias("class_id"))
    nodes = materialize(nodes.join(heads, "class").select("node", "class_id", "copies"), "nodes")
    return signed.join(nodes, "node", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"))


def one_of_each(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each near-duplicate class, that of the least id (null last), with all columns of documents.

    Rows are told apart by their place in their files: of rows that repeat an
    id, or have none, one stays if they are near copies, and all that are not.
    Each null or empty text is a class of its own. Columns may be of any type
    and name; an empty table gives no rows.
    """
    keyed, keys = with_row_keys(documents)
    key = free_name(keyed, "row_key")
    keyed = keyed.withColumn(key, F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.col(keys[0]).alias("file"), F.col(keys[1]).alias("place")))
    classes = near_duplicate_classes(keyed, id_col=key, text_col=text_col, **options)
    kept = classes.where("doc_id = class_id").select(F.col("doc_id.file").alias(keys[0]), F.col("doc_id.place").alias(keys[1]))
    return keyed.join(kept, keys, "left_semi").select(*[F.col(f"`{c}`") for c in documents.columns])
