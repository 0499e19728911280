"""Shared helpers: written tables in the cluster's shared folder and vectorised word hashing."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used in local mode where the session names no spark.checkpoint.dir, as in tests.
FALLBACK_DIR = "file:///tmp/checkpoints/folioflow"

_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)
_MIX1 = _U(0xBF58476D1CE4E5B9)
_MIX2 = _U(0x94D049BB133111EB)
_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, under spark.checkpoint.dir; it goes when the driver's JVM ends, spark.stop() or not.

    Without that setting a session on a cluster is refused, as no folder is known to be shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = (base or FALLBACK_DIR).rstrip("/") + "/" + spark.sparkContext.applicationId
    if base not in _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _made.add(base)
    return base


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, stem: str) -> str:
    """stem, with underscores in front until no column of df has that name."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def with_row_keys(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df and the names of added columns that tell its rows apart, the same whenever df is read.

    Rows of a plain file scan have their file's hash and their place in it,
    without a copy; any other df is written first, with a number for each row.
    """
    keys = [free_name(df, "row_file"), free_name(df, "row_place")]
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("SubqueryAlias", "Filter", "Project"):
        plan = plan.children().head()
    if plan.getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in df.columns:
        try:
            return df.select("*", F.xxhash64("_metadata.file_path").alias(keys[0]), F.col("_metadata.row_index").alias(keys[1])), keys
        except AnalysisException:
            pass
    return materialize(df.select("*", F.lit(0).cast("long").alias(keys[0]), F.monotonically_increasing_id().alias(keys[1])), "rows"), keys


def fit_in_task(sample: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """What ``fit`` makes of a bounded sample, run in one task, so that the driver holds the model alone; None for an empty sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(pa.Table.from_batches(got)))], pa.binary())], names=["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found["model"]) if found else None


_worker: dict[str, object] = {}


def worker_cache(key: str, make):
    """What a Python worker keeps between batches. Only one thing at a time, so that stages after each other don't add up."""
    if key not in _worker:
        _worker.clear()
        _worker[key] = make()
    return _worker[key]


def drop_worker_cache() -> None:
    """Free it, as after fitting on the driver."""
    _worker.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _MIX1
        x = (x ^ (x >> _U(27))) * _MIX2
        return x ^ (x >> _U(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Hashes to doubles in (0, 1)."""
    return ((x >> _U(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


_BYTES = mix(np.arange(1, 257, dtype=_U) * _MUL)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_CODE = _BYTES[_LOWER]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and the n + 1 offsets into them, without a copy per row."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


#: Bytes hashed together; the work takes some 40 times as much memory.
HASHED_BYTES = 1 << 21


def column_slices(column: pa.Array, most: int = 4 << 20):
    """The column in slices of at most so many bytes, or one text."""
    sizes = np.cumsum(np.diff(text_buffer(column)[1]))
    first = 0
    while first < len(column):
        done = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, done + most, "right")))
        yield column.slice(first, last - first)
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) of each text, and each text's word count.

    Long input is hashed in parts that end at white space, so memory beyond the
    words' hashes is bounded whatever the texts' lengths.
    """
    words, counts, at = [], np.zeros(len(offsets) - 1, np.int64), 0
    while at < len(data):
        end = min(at + HASHED_BYTES, len(data))
        while end < len(data):
            blank = np.flatnonzero(_SPACE[data[end : end + 4096]])
            if len(blank):
                end += int(blank[0])
                break
            end = min(end + 4096, len(data))
        first, last = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, end, "left")
        got, n = _word_hashes(data[at:end], np.clip(offsets[first : last + 1], at, end) - at)
        words.append(got)
        counts[first:last] += n
        at = end
    return np.concatenate(words) if words else np.zeros(0, _U), counts


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Works on bytes for all texts at once: a word's hash is a sum of its bytes' codes times powers by place."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, _U), np.zeros(n, np.int64)
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cut = offsets[:-1]
    before[cut[cut < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    if not len(starts):
        return np.zeros(0, _U), counts
    owner_end = np.repeat(offsets[1:], counts)
    spaces = np.flatnonzero(~inside)
    at = np.searchsorted(spaces, starts)
    ends = np.where(at < len(spaces), spaces[np.minimum(at, max(len(spaces) - 1, 0))] if len(spaces) else len(data), len(data))
    ends = np.minimum(ends, owner_end)
    lengths = ends - starts
    flat = np.arange(len(data), dtype=np.int64)[inside] if len(spaces) else np.arange(len(data), dtype=np.int64)
    with np.errstate(over="ignore"):
        place = flat - np.repeat(starts, lengths)
        powers = _powers(int(lengths.max()))
        terms = _CODE[data[flat]] * powers[place]
        sums = np.add.reduceat(terms, np.cumsum(lengths) - lengths)
        return mix(sums + lengths.astype(_U) * _MUL), counts


_power_table = np.ones(64, _U)


def _powers(n: int) -> np.ndarray:
    global _power_table
    if len(_power_table) < n or _power_table[1] == 1:
        with np.errstate(over="ignore"):
            _power_table = np.concatenate([np.ones(1, _U), np.cumprod(np.full(max(n, 64), _MUL | _U(1), _U), dtype=_U)])
    return _power_table


def sampled_rows(df: DataFrame, key: str, limit: int, seed: str) -> DataFrame:
    """At most limit rows, those of the smallest hash: the same rows on every run, whatever the partitions."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(limit)
