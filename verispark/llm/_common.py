"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import checkpointed  # noqa: F401
from ..storage import shared_path as new_path  # noqa: F401

#: Rows that a Python worker holds at once; long texts make the pieces smaller.
PIECE_ROWS = 10_000
PIECE_BYTES = 16 << 20


def posix_path(uri: str) -> str:
    """The path under which every worker sees a shared folder; raises if it isn't mounted."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{uri}: this operator memory-maps files and needs a shared folder mounted on every worker")
    return unquote(parts.path) if parts.scheme else uri


def unused(df: DataFrame, name: str) -> str:
    """A column name like name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_of(column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold_of(id_col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo modulus."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on after its task, beside the JVM and the workers of the next stage."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc only
        libc.malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that none has more than PIECE_ROWS rows or much over size bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        mean = max(1, batch.column(text).nbytes // batch.num_rows)
        step = max(1, min(PIECE_ROWS, size // mean))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
        del batch
        give_back()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the UTF-8 bytes of an array of texts without nulls, where each text begins and the last ends)."""
    texts = texts.cast(pa.large_binary())
    rows = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[rows[0] : rows[-1]], rows - rows[0]


def runs_of(data: np.ndarray, inside: np.ndarray, rows: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct runs of the bytes inside, each run's number among them, runs of each row); a run ends with its row."""
    edges = np.unique(rows)
    edges = edges[(edges > 0) & (edges < len(data))]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    runs = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    return runs.dictionary, runs.indices.to_numpy(zero_copy_only=False), np.diff(np.searchsorted(starts, rows))
