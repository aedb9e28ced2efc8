"""Numpy arrays as binary columns: what tasks send each other in place of rows.

An operator that must move a value for every word would shuffle far more bytes
as rows than its input has. Here a task sorts the values of a bounded piece of
text into buckets and sends one row for each bucket, whose payload holds the
packed arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa

_ZSTD = pa.Codec("zstd", compression_level=3)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays, compressed byte by byte of their values, with what :func:`unpack` needs to read them."""
    head, body = [len(arrays)], []
    for a in arrays:
        raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.reshape(-1)
        small = _ZSTD.compress(raw.tobytes(), asbytes=True) if raw.nbytes else b""
        stored = small if len(small) < raw.nbytes else raw.tobytes()
        head += [ord(a.dtype.kind), a.dtype.itemsize, len(a), len(stored)]
        body.append(stored)
    return np.array(head, np.int64).tobytes() + b"".join(body)


def unpack(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 1 + 4 * n)[1:].reshape(n, 4)
    at, out = 8 * (1 + 4 * n), []
    for kind, item, size, stored in head.tolist():
        raw = data[at : at + stored]
        if stored < item * size:
            raw = _ZSTD.decompress(raw, item * size, asbytes=True)
        planes = np.frombuffer(raw, np.uint8).reshape(item, size)
        out.append(np.ascontiguousarray(planes.T).view(np.dtype(f"{chr(kind)}{item}")).reshape(size))
        at += stored
    return out


def small(values: np.ndarray) -> np.ndarray:
    """Values of zero or more in the smallest unsigned type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def deltas(sorted_: np.ndarray) -> np.ndarray:
    """Differences of an array, in the smallest unsigned type that holds them; undone by cumsum."""
    return small(np.diff(sorted_, prepend=sorted_.dtype.type(0)))


def each_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that has values, with their places in order."""
    order = np.argsort(small(bucket), kind="stable")
    sorted_ = bucket[order]
    heads = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.empty(0, np.int64)
    for lo, hi in pairwise([*heads.tolist(), len(sorted_)]):
        yield int(sorted_[lo]), order[lo:hi]


def documents_of(batch: pa.RecordBatch, column: str, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch with a list column into runs of rows of about ``most`` values.

    Yields (first row, end row, values, offsets from 0); a longer row is a run of its own.
    """
    col = batch.column(column)
    offsets = col.offsets.to_numpy().astype(np.int64)
    values = col.values.to_numpy(zero_copy_only=False)
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, hi, values[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
