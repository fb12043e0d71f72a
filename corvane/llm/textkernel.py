"""Vectorised word kernel over Arrow string arrays.

A *word* is a maximal run of ASCII letters and digits and of bytes of
non-ASCII characters; ASCII and Latin-1 letters are lower-cased. Words never
span two rows. A null row has no words, like an empty one. Everything below
works on whole arrays of bytes or words; the only Python loop is over slices
of about ``SLICE_BYTES`` of text, so memory is bounded by that or by the
longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=_U)
_M1, _M2, _M3 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53), _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x *= _M1
    x ^= x >> _U(33)
    x *= _M2
    x ^= x >> _U(33)
    return x


@dataclass
class Words:
    """Words of some rows: hashes and byte spans, and ``first[d]:first[d+1]`` for row d."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    byte0: np.ndarray
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(text))
    at = _offsets(col)
    i = 0
    while i < batch.num_rows:
        j = int(np.searchsorted(at, at[i] + most, side="right")) - 1
        j = min(max(j, i + 1), batch.num_rows)
        yield batch.slice(i, j - i)
        i = j


def _offsets(col: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    buf = col.buffers()[1]
    if buf is None or not len(buf):
        return np.zeros(len(col) + 1, dtype=np.int64)
    return np.frombuffer(buf, dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def raw_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and where each row begins; null rows are empty."""
    if col.null_count:
        col = col.fill_null("")
    at = _offsets(col)
    buf = col.buffers()[2]
    if buf is None:
        return np.zeros(0, dtype=np.uint8), at - at[0]
    return np.frombuffer(buf, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def words(col: pa.Array) -> Words:
    """Words of an Arrow string array, hashed 8 bytes at a time."""
    raw, byte0 = raw_bytes(col)
    n = len(raw)
    data = np.zeros(n + 8, dtype=np.uint8)
    np.take(_LOWER, raw, out=data[:n])
    lead = np.flatnonzero(raw[:-1] == 0xC3) if n else np.zeros(0, dtype=np.int64)
    if len(lead):
        nxt = raw[lead + 1]
        up = lead[(nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97)] + 1
        data[up] += 32
    is_word = _WORD[raw]
    inner = byte0[(byte0 > 0) & (byte0 < n)]
    before = np.zeros(n, dtype=bool)
    before[1:] = is_word[:-1]
    before[inner] = False
    after = np.zeros(n, dtype=bool)
    after[:-1] = is_word[1:]
    after[inner - 1] = False
    start = np.flatnonzero(is_word & ~before)
    end = np.flatnonzero(is_word & ~after) + 1
    size = end - start
    lanes = np.ndarray((n + 1,), dtype="<u8", buffer=data, strides=(1,))
    h = (lanes[start] & _KEEP[np.minimum(size, 8)]) + size.astype(_U) * _M3
    h = mix(h)
    more, done = np.flatnonzero(size > 8), 8
    while len(more):
        lane = lanes[start[more] + done] & _KEEP[np.minimum(size[more] - done, 8)]
        h[more] = mix(h[more] * _M3 + lane)
        done += 8
        more = more[size[more] > done]
    return Words(h, start, end, np.searchsorted(start, byte0), byte0, data)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words, and ``first`` for them.

    A row of 1 to n-1 words has one shingle, of all of them; a row without
    words has none.
    """
    total, counts = len(w.hash), w.counts
    padded = np.concatenate([w.hash, np.zeros(n, dtype=_U)])
    row_end = np.repeat(w.first[1:], counts)
    at = np.arange(total)
    keep = (at + n <= row_end) | np.isin(at, w.first[:-1][(counts > 0) & (counts < n)])
    at, row_end = at[keep], row_end[keep]
    g = np.zeros(len(at), dtype=_U)
    for k in range(n):
        g *= _M3
        part = padded[at + k]
        part[at + k >= row_end] = _U(0)
        g += part
    many = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    return mix(g), np.concatenate([[0], np.cumsum(many)])


def row_sums(values: np.ndarray, first: np.ndarray, ufunc: np.ufunc = np.add, empty: float = 0) -> np.ndarray:
    """``ufunc`` over ``values[first[d]:first[d+1]]`` for each d; ``empty`` where there are none."""
    out = np.full((len(first) - 1, *values.shape[1:]), empty, dtype=values.dtype)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = ufunc.reduceat(values, first[full], axis=0)
    return out


def sequence_keys(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row's sequence of words, as two int64."""
    place = (np.arange(len(w.hash)) - np.repeat(w.first[:-1], w.counts)).astype(_U)
    a = mix(w.hash + place * _M3)
    b = mix(a * _M1 + w.hash)
    n = w.counts.astype(_U)
    return mix(row_sums(a, w.first) + n).view(np.int64), mix(row_sums(b, w.first) + n * _M2).view(np.int64)


def py_words(text: str | None) -> list[str]:
    """The same words in plain Python, for tests and for small driver-side texts."""
    out, now = [], []
    for c in text or "":
        if c.isascii():
            c = c.lower() if c.isalnum() else ""
        elif "À" <= c <= "Þ" and c != "×":
            c = chr(ord(c) + 32)
        if c:
            now.append(c)
        elif now:
            out.append("".join(now))
            now = []
    return out + ["".join(now)] * bool(now)
