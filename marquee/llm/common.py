"""Helpers shared by the text operators."""

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.session import shipped

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Text handled at once inside a task, in bytes; a longer text is handled alone.
SLICE_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipped(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_bucket(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def only(rows: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, whatever else the input carries; workers of the session get this package."""
    shipped(rows.sparkSession)
    return rows.select(*[F.col(f"`{n}`") for n in names])


def unused(rows: DataFrame, name: str) -> str:
    """A column name like this one that the rows do not have."""
    taken = {c.lower() for c in rows.columns}
    while name in taken:
        name += "_"
    return name


def texts_of(column: pa.Array) -> pa.Array:
    """A text column with nulls as empty strings."""
    return pc.fill_null(column.cast(pa.string()), "")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of at most ``size`` bytes of text (or one row)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(lengths, dtype=np.int64), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch, lengths, ends
        trimmed()


def trimmed() -> None:
    """Give memory that is free to the system; workers wait for their next task beside the JVM's own memory."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc only
        trim(0)


def in_slices(work: Callable[[pa.RecordBatch], pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES):
    """A ``mapInArrow`` function that applies ``work`` to runs of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column, size):
            yield work(part)

    return run


def word_lists(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words of each text between ASCII white space: offsets of the texts, and all words in a row."""
    # A tab, newline, vertical tab, form feed, carriage return or space ends a word, and nothing else does.
    lists = pc.ascii_split_whitespace(texts)
    words, offsets = lists.flatten(), lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(words), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return kept[offsets], words.filter(full)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return shift + np.arange(total, dtype=np.int64)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the runs offsets[i]:offsets[i + 1]; an empty run sums to 0."""
    running = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return running[offsets[1:]] - running[offsets[:-1]]
