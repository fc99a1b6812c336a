"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python stages cut their input into pieces of about this many bytes of text, whatever a batch holds.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns that text operators read, so scans prune the rest and no extra column can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def held_out(modulus: int, remainder: int, name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; a row without an id is never held out."""
    return F.coalesce(F.crc32(F.col(name).cast("string")) % modulus == remainder, F.lit(False))


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.binary()).to_pylist()


_PLAIN = bytes.maketrans(b"\t\n\v\f\r", b" " * 5)
_LOWER = bytes.maketrans(b"\t\n\v\f\rABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * 5 + b"abcdefghijklmnopqrstuvwxyz")


def word_array(found: list[bytes | None], lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The words of texts one after the other - what white space (space, tab to carriage return) parts, with A-Z in lower
    case if wanted - and how many each text has."""
    joined = b"\n".join([*[t or b"" for t in found], b""]).translate(_LOWER if lower else _PLAIN)
    stops = np.cumsum(np.fromiter((len(t or b"") + 1 for t in found), dtype=np.int64, count=len(found))) - 1
    return spaced(np.frombuffer(joined, dtype=np.uint8), stops)


def spaced(data: np.ndarray, stops: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """What spaces part in the bytes of texts that end at stops, each with a space there, and how many each text has."""
    space = data == 0x20
    fresh = ~space
    fresh[1:] &= space[:-1]
    starts = np.flatnonzero(fresh)
    values = data[~space]
    offsets = np.append(starts - np.cumsum(space, dtype=np.int64)[starts], len(values)).astype(np.int64)
    count = np.diff(np.searchsorted(starts, stops), prepend=0)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(values)]), count


def hashes(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes of byte strings."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.to_numpy(zero_copy_only=False)), dtype=np.uint64, count=len(distinct))


def ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (count[0] of them), begin[1], ..."""
    upto = np.cumsum(count, dtype=np.int64)
    return np.repeat(begin - (upto - count), count) + np.arange(int(upto[-1]) if len(upto) else 0)


def pieces(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = CHUNK_BYTES, keep: tuple | None = None) -> Iterator[pa.RecordBatch]:
    """Batches again, none with more than about ``limit`` bytes of text (a longer text goes alone). keep: what the slot
    of ``held`` may go on holding when the batches end."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(name)), 0), dtype=np.int64)
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    trim(keep)


_slot: dict = {}


def held(key: tuple, make: Callable[[], Any]) -> Any:
    """What one stage keeps in a worker from task to task. There is one slot: another stage's end empties it."""
    if key not in _slot:
        _slot.clear()
        _slot[key] = make()
    return _slot[key]


def trim(keep: tuple | None = None) -> None:
    """Give back what the stage has freed: Python workers live on, and idle ones would keep it from others."""
    if keep not in _slot:
        _slot.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def sample_rows(df: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """At most about ``limit`` rows, chosen by a hash of the id: all rows when there are fewer.

    The threshold comes from one exact count, so no global sort is needed and the choice does not depend on the order
    of rows. Binomial scatter may exceed the limit by a few per cent.
    """
    n = df.count()
    if n <= limit:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) < int((1 << 30) * limit / n))
