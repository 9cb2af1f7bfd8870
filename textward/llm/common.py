"""Shared pieces: the folder for intermediate tables, and tokenising whole Arrow batches at once."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expression of a word: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def work_dir(spark: SparkSession) -> str:
    """A new path below the shared checkpoint folder; a local one is set only where none is configured."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/tmp/textward-checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/t-{uuid.uuid4().hex}"


#: Tables that ``save`` has written and ``drop`` has not deleted, in this process.
WRITTEN: list[str] = []


def save(df: DataFrame) -> tuple[DataFrame, str]:
    """Writes a table to the shared folder and reads it back: lineage ends there."""
    path = work_dir(df.sparkSession)
    WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        if path in WRITTEN:
            WRITTEN.remove(path)
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def _set(spark: SparkSession, **values: str) -> Iterator[None]:
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def small_batches(spark: SparkSession, size: str = "8m"):
    """Arrow batches of few bytes for the plans that are run inside: columns of whole sets would fill large ones."""
    return _set(spark, spark__sql__execution__arrow__maxBytesPerBatch=size)


def merged_joins(spark: SparkSession):
    """Plans that are run inside sort and merge their joins at every size; nothing is collected by the driver to be broadcast."""
    return _set(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1")


def tidy(spark: SparkSession) -> None:
    """Lets the context cleaner remove the shuffle files of finished plans."""
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()


def id_crc(column: Column) -> Column:
    """crc32 of an id written as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


# ---------------------------------------------------------------- tokens of a batch

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORDY = np.ones(256, dtype=bool)
_WORDY[[9, 10, 11, 12, 13, 32]] = False
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPAN = 1 << 20
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for b in (_BASE, inverse):
            x = np.full(_SPAN, b, dtype=np.uint64)
            x[0] = 1
            _POWERS.append(np.cumprod(x))
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the rows' bounds; a null text is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word (A-Z lower-cased), and the index of each row's first word (rows + 1 entries)."""
    n = len(raw)
    wordy = np.empty(n + 2, dtype=bool)
    wordy[0] = wordy[-1] = False
    wordy[1:-1] = _WORDY[raw]
    edge = wordy[1:] != wordy[:-1]
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    inner = cut[wordy[cut] & wordy[cut + 1]]  # a word on both sides of a row's end
    at = np.flatnonzero(edge)
    starts, ends = at[::2], at[1::2]
    if len(inner):
        starts, ends = np.sort(np.concatenate([starts, np.unique(inner)])), np.sort(np.concatenate([ends, np.unique(inner)]))
    hashes = np.zeros(len(starts), dtype=np.uint64)
    power, inverse = _powers()
    low = _LOWER[raw]
    i = 0
    while i < len(starts):
        base = starts[i]
        j = int(np.searchsorted(ends, base + _SPAN, side="right"))
        if j == i:  # one word longer than the table of powers
            hashes[i] = _long_word(low[base : ends[i]])
            i += 1
            continue
        part = low[base : ends[j - 1]].astype(np.uint64)
        part += np.uint64(1)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * power[: len(part)], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        hashes[i:j] = (sums[e] - sums[s]) * inverse[s]
        i = j
    hashes = mix(hashes ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))
    return hashes, starts, ends, np.searchsorted(starts, bounds)


def _long_word(low: np.ndarray) -> np.uint64:
    power, _ = _powers()
    total, factor = np.uint64(0), np.uint64(1)
    step = np.uint64(pow(int(_BASE), _SPAN, 1 << 64))
    with np.errstate(over="ignore"):
        for k in range(0, len(low), _SPAN):
            x = low[k : k + _SPAN].astype(np.uint64) + np.uint64(1)
            total = total + np.sum(x * power[: len(x)], dtype=np.uint64) * factor
            factor = factor * step
    return total


def pieces(batch: pa.RecordBatch, text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows so that each piece holds about ``most`` bytes of text; a longer text stands alone."""
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
    n = len(column)
    if not n:
        return
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j
