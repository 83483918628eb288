"""What the operators of this subpackage share: tables, shared storage and batch slicing."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch between the JVM and Python; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """Bounds the session's Arrow batches by BATCH_BYTES, where it allows more: what both sides of a
    task hold then doesn't follow the length of the texts. Every operator calls it on its input."""
    conf = df.sparkSession.conf
    if int(conf.get(LIMIT).rstrip("bB")) > BATCH_BYTES:
        conf.set(LIMIT, str(BATCH_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def beside(df: DataFrame, keep: list[str], text: str, *more) -> tuple[DataFrame, int]:
    """The columns ``keep`` of ``df``, then those of ``more``, and its text as string, once: in its place
    if it is a string among ``keep``, else as the last column; and the place where it is."""
    columns = [F.col(f"`{c}`") for c in keep] + list(more)
    if text in keep and df.schema[text].dataType.simpleString() == "string":
        return small_batches(df).select(*columns), keep.index(text)
    return small_batches(df).select(*columns, F.col(f"`{text}`").cast("string").alias("__text")), len(columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a
    local master (tests) gets a temporary one; on a cluster such a folder isn't shared, so that's an error."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def deleted(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_written: dict[str, SparkSession] = {}


def _forget() -> None:
    for path, spark in _written.items():
        try:
            deleted(spark, path)
        except Exception:  # the session has ended: nothing is left to ask
            return


atexit.register(_forget)


def own_path(spark: SparkSession) -> str:
    """A new place in the shared folder that goes when the driver ends."""
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage, survives
    lost executors, and goes when the driver ends or ``drop_stored`` is called."""
    path = own_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables_stored() -> set[str]:
    return set(_written)


def drop_stored(paths: set[str]) -> None:
    """Delete tables of ``stored`` that nothing reads any more."""
    for path in paths & set(_written):
        deleted(_written.pop(path), path)


_kept: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]):
    """What a Python worker keeps between its tasks: one thing at most, so that a worker that serves
    one operator after another doesn't gather what all of them remember."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def tidy(run: Callable, keeps: bool = False) -> Callable:
    """``run`` over batches; before it whatever ``kept`` holds goes (unless ``keeps``), and after it
    memory that nothing uses goes back to the system, as workers live on."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            _kept.clear()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: sizes the number of buckets, so that a bucket's memory is bounded."""
    row = df.agg(F.sum(F.octet_length(F.col(text).cast("string"))).alias("n")).first()
    return int(row["n"] or 0)


def sliced(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` of ``column`` (a longer row stands alone)."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        size = np.asarray(pa.compute.binary_length(batch.column(at)).fill_null(0)).astype(np.int64)
        start, total = 0, 0
        for i, s in enumerate(size.tolist()):
            if i > start and total + s > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += s
        if batch.num_rows > start:
            yield batch.slice(start)


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column one after the other, and the n + 1 offsets; a null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return (whole[at[0] : at[-1]], at - at[0]) if len(at) else (whole[:0], np.zeros(1, np.int64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser over uint64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def folded(flat: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capitals U+00C0-U+00DE (0xC3, then 0x80-0x9E) in lower case."""
    out = flat.copy()
    out[(flat >= 0x41) & (flat <= 0x5A)] += 0x20
    after = np.zeros(len(flat), bool)
    after[1:] = flat[:-1] == 0xC3
    out[after & (flat >= 0x80) & (flat <= 0x9E) & (flat != 0x97)] += 0x20
    return out


def stretches(flat: np.ndarray, keep: np.ndarray, start: np.ndarray) -> pa.Array:
    """The bytes of ``flat`` under ``keep`` as binary values, one from each of ``start`` (places under
    ``keep``) to the next, dictionary-encoded: the different ones and which is where."""
    place = np.cumsum(keep) - 1
    ends = np.append(place[start], np.count_nonzero(keep)).astype(np.int64)
    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(flat[keep].tobytes())])
    return raw.dictionary_encode()


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n: the folds of the held-out rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


class Memory(dict):
    """What was found for short keys, in two generations of ``most_bytes`` each: when the newer one is
    full it becomes the older one, and that goes."""

    def __init__(self, most_bytes: int = 32 << 20, longest: int = 64):
        self.most_bytes, self.longest, self.used, self.older = most_bytes, longest, 0, {}

    def recall(self, key):
        found = self.get(key)
        if found is None and (found := self.older.get(key)) is not None:
            self.keep(key, found)
        return found

    def keep(self, key, value):
        if len(key) <= self.longest:
            size = 160 + len(key) + 8 * len(value)  # about what Python takes for the entry and both objects
            if self.used + size > self.most_bytes:
                self.older, self.used = dict(self), 0
                self.clear()
            self.used += size
            self[key] = value
        return value
