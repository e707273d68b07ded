"""Storage and text helpers that the operators of this package have in common."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20
#: Slices between two returns of memory, each of which costs page faults.
GIVE_BACK_AFTER = 8
_written: list[str] = []
_libc = ctypes.CDLL(None)


def shared_folder(spark: SparkSession) -> str:
    """A new folder (not yet made) below the one that all machines share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset, as in local
    tests, a temporary folder of this machine is taken; a cluster without one is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("a cluster needs a shared folder in spark.checkpoint.dir")
        base = f"file://{tempfile.mkdtemp(prefix='lithofig-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/lithofig-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder and the path in it."""
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


@atexit.register
def _remove_written() -> None:
    for uri in _written:
        try:
            store, path = open_store(uri)
            if store.get_file_info(path).type == pafs.FileType.Directory:
                store.delete_dir(path)
        except (OSError, pa.ArrowInvalid):
            continue


def materialize(df: DataFrame) -> DataFrame:
    """Write to the shared folder as Parquet and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read.written_to = path
    return read


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for tables that nothing reads any more."""
    for df in tables:
        uri = getattr(df, "written_to", None)
        if uri in _written:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(uri)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
            _written.remove(uri)


def bound_batches(spark: SparkSession) -> SparkSession:
    """Let Arrow batches of this session hold BATCH_BYTES at most, or less where it is set so.

    Spark's own bound lets tens of megabytes of text wait in direct memory for each task. The
    setting stays, as results are evaluated later.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return spark


def give_back() -> None:
    """Return freed memory to the system, as Python workers live on beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def in_slices(batches, column: int, most: int = 1 << 20):
    """Record batches cut so that the text of each has about ``most`` bytes, or is one row.

    Bounds what a Python worker holds, whatever the length of texts.
    """
    done = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            # copied, as some string kernels misread arrays that begin within their buffers
            parts = [pa.concat_arrays([c.slice(0, 0), c.slice(begin, end - begin)]) for c in batch.columns]
            yield pa.RecordBatch.from_arrays(parts, schema=batch.schema)
            del parts
            done += 1
            if done % GIVE_BACK_AFTER == 0:
                give_back()
    give_back()


def by_text(function: Callable[[pa.Array], pa.Array], kind: str) -> Callable[[Column], Column]:
    """A column function for ``function``, which maps a batch of texts to one value each.

    Only the text goes to Python, in slices, and only the value comes back; all other columns stay in the JVM.
    """

    @F.arrow_udf(kind)
    def mapped(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [function(b.column(0)) for b in in_slices([pa.RecordBatch.from_arrays([texts], names=["text"])], 0)]
            yield pa.concat_arrays(parts) if parts else function(texts)

    return mapped


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words (runs without ASCII white space) of a batch of texts; null counts as empty.

    Returns the index of each word in the distinct words, the offsets of the texts in these
    (one more than texts), and the distinct words.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    offsets = parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.not_equal(flat, "")
    keep = full.to_numpy(zero_copy_only=False)
    if not keep.all():
        before = np.concatenate([[0], np.cumsum(keep)])
        flat, offsets = flat.filter(full), before[offsets]
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), offsets, coded.dictionary


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate ``values[start:start + length]`` for every pair."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    kind = np.int32 if total < 1 << 31 and len(values) < 1 << 31 else np.int64
    at = np.repeat((starts - (np.cumsum(lengths) - lengths)).astype(kind), lengths)
    at += np.arange(total, dtype=kind)
    return values[at]


def sums_between(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values[offsets[i]:offsets[i + 1]]`` along the first axis; empty ranges give 0."""
    shape = (len(offsets) - 1, *values.shape[1:])
    out = np.zeros(shape, dtype=values.dtype)
    some = offsets[1:] > offsets[:-1]
    if some.any():
        out[some] = np.add.reduceat(values, offsets[:-1][some], axis=0)
    return out


def id_text(column: str):
    """The crc32 of an id's decimal text, for folds."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
