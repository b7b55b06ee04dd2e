"""Helpers the operators of this folder share: work tables, Arrow batches, words of whole texts."""

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from advisoryspark.session import materialize  # noqa: F401  every operator takes it from here

#: Bytes of text an operator looks at in one numpy step, where a word may take some hundred bytes; longer texts make
#: a step of their own.
STEP_BYTES = 4 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(name: str = "text") -> Column:
    """The column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def text_of(batch: pa.RecordBatch, path: str) -> pa.Array:
    """The column, or the field of a struct column, that `path` names ("text", "row.text")."""
    name, _, field = path.partition(".")
    column = batch.column(name)
    return (column.field(field) if field else column).cast(pa.binary()).fill_null(b"")


def each_step(batches: Iterator[pa.RecordBatch], path: str,
              fn: Callable[[pa.RecordBatch], pa.RecordBatch], size: int = 0) -> Iterator[pa.RecordBatch]:
    """Apply `fn` to runs of rows that hold about `size` bytes (STEP_BYTES) of the text at `path`."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.binary_length(text_of(batch, path)).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + (size or STEP_BYTES), side="right")))
            yield fn(batch.slice(start, end - start))
            start = end
    give_back()


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks and share their machine with the JVM."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def fold_table(lower: bool = True, blank: str = "") -> np.ndarray:
    """Byte table: A-Z to lower case if asked, the characters of `blank` to a space."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    for byte in blank.encode("latin-1"):
        table[byte] = 32
    return table


def word_table(column: pa.Array, table: np.ndarray | None = None):
    """Words (runs without ASCII white space) of every text.

    Returns the first word's place for each text (and the end), the number of
    each word in the list of distinct words, and that list as an Arrow array.
    """
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    ends = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    if table is not None:
        data = table[data]
    plain = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(np.ascontiguousarray(ends - ends[0])),
                                                         pa.py_buffer(np.ascontiguousarray(data))])
    split = pc.ascii_split_whitespace(plain)
    offsets = split.offsets.to_numpy()
    flat = split.flatten()
    kept = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(kept)])[offsets]
    coded = flat.filter(pa.array(kept)).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return starts, coded.indices.to_numpy().astype(np.int64), coded.dictionary


#: Byte table that lower-cases A-Z and makes everything that is no letter, digit or non-ASCII byte a space.
WORD_BYTES = fold_table(blank="".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61),
                                                *range(0x7B, 0x80)])))


def mixed(values: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit hash of 64-bit values."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def word_hashes(distinct: pa.Array) -> np.ndarray:
    """64-bit hash of each distinct word."""
    digest = xxhash.xxh64_intdigest
    words = distinct.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    return np.fromiter(map(digest, words.tolist()), np.uint64, len(distinct))


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
