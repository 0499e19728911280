"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Every source's documents are shuffled by a hash and laid end to end, and that
stream of words is cut into blocks of equal size. Golden-ratio points, mapped
through the cumulative quotas of the sources, say which source each slot of the
mix serves; the slot's rank among its source's slots picks the block. All of it
is DataFrame operations; prefix sums and ranks go by buckets, so that no task
holds a whole source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, with_row_keys

#: Words of a block at most; fewer where the sources would get less than SLOTS slots each on average.
BLOCK_WORDS = 2048
SLOTS = 2000
MAX_REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"

#: The fractional part of the golden ratio.
GOLDEN = 0.6180339887498949
_CHUNK = 1 << 16
_CELLS = 4096


def _golden(k):
    """Slot number to a point in [0, 1); in two parts, so that large numbers keep their precision."""
    x = F.shiftright(k, 20) * F.lit(GOLDEN * (1 << 20) % 1.0) + (k % F.lit(1 << 20)) * F.lit(GOLDEN)
    return x - F.floor(x)


def document_sizes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keys: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, size, keys...): words of each document, 0 for a null text; columns that tell rows apart become key0, key1 and so on."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    return documents.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), *[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)])


def source_plan(sizes: DataFrame, block_words: int = BLOCK_WORDS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: its weight, target and blocks, and its interval [low, high) of the schedule.

    Targets share all words by weight, up to max_repeats times the source's
    size; the excess goes to the others by weight. With sources in order of
    cap / weight the capped ones come first, so prefix sums find the level.
    The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(by_name) - 1).withColumn("weight", F.col("sid") % 3 + 1).withColumn("cap", F.col("source_size") * max_repeats)
    s = s.withColumn("total", F.sum("source_size").over(every)).withColumn("n", F.count("*").over(every))
    spent = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("level", (F.col("total") - spent) / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level")))
    s = s.withColumn("level", F.max("level").over(every))
    s = s.withColumn("target", F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double")))
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("total") / (F.col("n") * SLOTS))))
    s = s.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block)))
    s = s.withColumn("quota", F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")), F.col("blocks") * max_repeats)).otherwise(0).cast("long"))
    # Points fall unevenly by a few times their logarithm; each source gets so many to spare and uses its quota.
    spare = F.ceil(F.log2(F.sum("quota").over(every) + 2)) + 4
    s = s.withColumn("points", F.when(F.col("quota") > 0, F.col("quota") + spare).otherwise(0))
    s = s.withColumn("upto", F.sum("points").over(Window.orderBy("sid")))
    s = s.withColumn("all_points", F.sum("points").over(every))
    s = s.withColumn("high", F.try_divide("upto", "all_points")).withColumn("low", F.try_divide(F.col("upto") - F.col("points"), F.col("all_points")))
    return s.select("sid", "source", "source_size", "weight", "target", "blocks", "quota", "low", "high", "all_points")


def block_pieces(sizes: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces): each document's key (sid, bucket, nth) and first word in its source's shuffled stream, and its parts by block."""
    d = sizes.join(plan.select("sid", "source", "source_size", "target", "blocks"), sizes["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    d = d.withColumn("hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("bucket", F.substring("hash", 1, 3))
    sums = d.groupBy("sid", "bucket").agg(F.sum("size").alias("size"))
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("size").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    keys = [c for c in sizes.columns if c.startswith("key")]
    order = Window.partitionBy("sid", "bucket").orderBy("hash", "doc_id", "size", *keys)
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("nth", F.row_number().over(order)).withColumn("before", before).join(sums, ["sid", "bucket"])
    d = d.withColumn("start", F.col("base") + F.col("before"))
    length, longer = F.expr("source_size div blocks"), F.col("source_size") % F.col("blocks")

    def block_of(word):
        return F.when(word < longer * (length + 1), F.floor(word / (length + 1))).otherwise(longer + F.floor((word - longer * (length + 1)) / F.greatest(length, F.lit(1)))).cast("long")

    p = d.where("size > 0").withColumn("block", F.explode(F.sequence(block_of(F.col("start")), block_of(F.col("start") + F.col("size") - 1))))
    begin = F.col("block") * length + F.least(F.col("block"), longer)
    end = (F.col("block") + 1) * length + F.least(F.col("block") + 1, longer)
    first, last = F.greatest(F.col("start"), begin), F.least(F.col("start") + F.col("size"), end)
    pieces = p.select("sid", "bucket", "nth", "doc_id", *keys, "block", (first - F.col("start")).alias("from_word"), (last - first).alias("words"))
    return d.select("sid", "bucket", "nth", "doc_id", *keys, "source", "size", "source_size", "target"), pieces


def schedule(plan: DataFrame) -> DataFrame:
    """(slot, sid, block, pass): the source and block of every slot of the mix."""
    spark = plan.sparkSession
    points = (plan.agg(F.max("all_points").alias("n")).first() or [0])[0] or 0
    slots = spark.range(int(points)).select(F.col("id").alias("slot"), _golden(F.col("id")).alias("at")).withColumn("cell", F.floor(F.col("at") * _CELLS).cast("int"))
    cells = plan.where("quota > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * _CELLS).cast("int"), F.least(F.floor(F.col("high") * _CELLS), F.lit(_CELLS - 1)).cast("int"))))
    served = slots.join(cells, "cell").where("at >= low and at < high").select("slot", "sid", "blocks", "quota", F.expr(f"slot div {_CHUNK}").alias("chunk"))
    sums = served.groupBy("sid", "chunk").count()
    sums = sums.select("sid", "chunk", F.coalesce(F.sum("count").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rank = F.col("base") + F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    served = served.join(sums, ["sid", "chunk"]).withColumn("rank", rank).where("rank < quota")
    return served.select("slot", "sid", (F.col("rank") % F.col("blocks")).alias("block"), F.expr("rank div blocks").alias("pass"))


def mix(documents: DataFrame, block_words: int = BLOCK_WORDS, max_repeats: int = MAX_REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Mix documents by source weights 1, 2, 3, repeating in order of the source's name, null last.

    Returns (documents, mixture). documents: one row per input row with its key
    (sid, bucket, nth), doc_id, source, size, source_size and target. mixture: a row
    per slot and document part, (slot, pass, sid, bucket, nth, doc_id, block,
    from_word, words), to be read by slot. Columns that tell rows apart may be
    given as keys; both tables then have them as key0, key1 and so on. Empty texts have size 0 and no part
    in the mixture, a source of none has target 0; repeated rows each count;
    ties in the shuffled order are between equal rows; an empty table gives
    empty results. Other columns are not read.
    """
    sizes = materialize(document_sizes(documents, id_col, text_col, source_col, keys), "sizes")
    plan = materialize(source_plan(sizes, block_words, max_repeats), "sources")
    rows, pieces = block_pieces(sizes, plan)
    return rows, schedule(plan).join(pieces, ["sid", "block"])


def taken_words(documents: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target and taken, the words that the mixture takes of it."""
    rows, mixture = mix(documents, **options)
    taken = mixture.groupBy("sid", "bucket", "nth").agg(F.sum("words").alias("taken"))
    out = rows.join(taken, ["sid", "bucket", "nth"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(documents: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mixture as rows of documents, with their columns: each row as often as it is taken, the last time cut to the words taken.

    A document whose blocks are all taken k times comes k times, whole. One of
    which some blocks are taken once more comes once more with those words,
    joined by blanks. n_chars, where there is such a column, follows the text.
    Null and empty texts have no words and do not come. Rows are told apart by
    their place in their files, so repeated rows each count and the shares of
    rows alike in id and size do not change between runs; a table that is not
    read from files is written once to number its rows. Other columns, of
    whatever names, are carried along; an empty table gives no rows. Texts move
    once, to meet what is taken of them.
    """
    keyed, keys = with_row_keys(documents)
    _, mixture = mix(keyed, text_col=text_col, keys=keys, **options)
    taken = mixture.groupBy("key0", "key1", "pass").agg(F.sum("words").alias("words"), F.min("from_word").cast("int").alias("from_word"))
    text, size = F.col(f"d.{text_col}"), F.regexp_count(F.col(f"d.{text_col}"), F.lit(WORD))
    joined = keyed.alias("d").join(taken.alias("t"), (F.col(f"d.{keys[0]}") == F.col("t.key0")) & (F.col(f"d.{keys[1]}") == F.col("t.key1")))
    cut = F.concat_ws(" ", F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.col("t.from_word") + 1, F.col("t.words").cast("int")))
    shown = F.when(F.col("t.words") == size, text).otherwise(cut)
    changed = {text_col: shown}
    if "n_chars" in documents.columns:
        changed["n_chars"] = F.length(shown).cast(documents.schema["n_chars"].dataType)
    return joined.select(*[changed.get(c, F.col(f"d.`{c}`")).alias(c) for c in documents.columns])
