"""Words of whole texts as numpy arrays: A-Z lower-cased, runs of digits, letters and bytes above 0x7F."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
BASE, BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every bit of the result depends on every bit of x."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, BASE_INVERSE):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, for at least size places."""
    return _powers(1 << max(16, int(size - 1).bit_length()))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the len + 1 offsets; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("") if column.null_count else column
    large = pa.types.is_large_string(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about limit bytes; a longer document is a range of its own."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to
        at = to


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] = sum of value(byte k) * BASE**k over i <= k < j, modulo 2**64."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[raw] * powers(len(raw) + 1)[0][: len(raw)], out=out[1:])
    return out


class Words(NamedTuple):
    start: np.ndarray  # byte places within the chunk
    end: np.ndarray
    doc: np.ndarray  # index of the document within the chunk
    first: np.ndarray  # for each document, its first word; one more at the end
    hash: np.ndarray


def words(raw: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of a chunk of documents: raw bytes and offsets from 0."""
    n = len(raw)
    low = LOWER[raw]
    inside = WORD[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < n]
    begins[edge] = inside[edge]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    h = prefix_hash(low)
    hashes = mix((h[end] - h[start]) * powers(n + 1)[1][start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(start, end, doc, first, hashes)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each run of size words; a text of fewer words has one shingle of all its words."""
    count = np.diff(w.first)
    room = np.maximum(count - size + 1, 0)
    at = np.repeat(w.first[:-1] - np.concatenate([[0], np.cumsum(room)[:-1]]), room) + np.arange(room.sum())
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + w.hash[at + k]
    doc = np.repeat(np.arange(len(count)), room)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        tail = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = count[short] > k
            word = w.hash[np.where(has, w.first[short] + k, 0)]
            tail = np.where(has, tail * np.uint64(0xD6E8FEB86659FD93) + word, tail)
        out, doc = np.concatenate([out, tail]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        out, doc = out[order], doc[order]
    return doc, mix(out)
