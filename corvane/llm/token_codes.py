"""Token ids as directly addressable codes.

Each document's ids are cut into chunks of 8 bits, least first. Level 0 holds
the first chunk of every id, level 1 the second chunk of those that have one,
and so on; a bitmap per level says which chunks go on, with a directory of the
number of ones before every 256 bits. To read id i: its chunk at level 0, and
while its bit is set, its place at the next level is the number of ones before
it. That touches a few bytes; nothing is decoded.

Layout of ``codes``, little-endian: uint8 number of levels; per level uint32
entries, the chunks (a byte each), and except at the last level the bitmap
(ceil(entries/8) bytes, least bit first) and the directory (uint32 for every 256 bits).

Tokens are those of a byte-level BPE vocabulary (a ``.tiktoken`` file, by path)
without special tokens. A text is cut before each single space between two
characters that aren't white space, where the vocabulary's own pattern always
cuts; only distinct pieces are tokenised.

Result: (doc_id, n_tokens, codes), a row per row. Defined cases: null doc_id:
row ignored; ids of any type. Null text: both null. Empty text: 0 tokens, one empty level.
Repeated rows: a row each. Other columns are ignored. Empty table: empty
result. Special tokens' strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .cluster import id_type, narrow

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pattern of byte-level BPE pre-tokens.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 256

#: Bytes of text tokenised at once: the more, the fewer distinct pieces there are to a piece.
SLICE_BYTES = 8_000_000

_loaded: dict = {}


def encoding(path: str):
    """The tokenizer of a vocabulary file, once per process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        _loaded[path] = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def _space() -> np.ndarray:
    s = np.zeros(256, dtype=bool)
    s[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
    return s


_SPACE = _space()


def _lengths(path: str) -> np.ndarray:
    """Bytes of each token."""
    if (path, "len") not in _loaded:
        enc = encoding(path)
        _loaded[path, "len"] = np.array([len(x) for x in (enc.decode_single_token_bytes(i) for i in range(enc.n_vocab))], dtype=np.int64)
    return _loaded[path, "len"]


def token_ids(col: pa.Array, path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows (uint32), and ``first`` of each row's."""
    raw, byte0 = tk.raw_bytes(col)
    n = len(raw)
    if not n:
        return np.zeros(0, dtype=np.uint32), np.zeros(len(col) + 1, dtype=np.int64)
    # Non-ASCII bytes may belong to a white space character: no cut beside those.
    plain = ~_SPACE[raw] & (raw < 128)
    cut = np.zeros(n, dtype=bool)
    cut[1:-1] = (raw[1:-1] == 32) & plain[:-2] & plain[2:]
    cut[byte0[:-1][byte0[:-1] < n]] = True
    at = np.flatnonzero(cut)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, n).astype(np.int64)), pa.py_buffer(raw)])
    full = np.diff(byte0) > 0
    edge = np.zeros(len(at), dtype=bool)
    edge[np.searchsorted(at, byte0[:-1][full])] = True
    edge[np.searchsorted(at, byte0[1:][full]) - 1] = True
    enc = encoding(path)
    # Pieces within a text begin with a space and end in none: one after another, each is tokenised as in its place.
    inner = pieces.filter(pa.array(~edge)).dictionary_encode()
    words = inner.dictionary
    bounds = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, dtype=np.int64)
    joined = bytes(words.buffers()[2])[bounds[0] : bounds[-1]] if len(words) else b""
    ids = np.array(enc.encode_ordinary(joined.decode()), dtype=np.uint32)
    ends = np.concatenate([[0], np.cumsum(_lengths(path)[ids])])
    begin = np.searchsorted(ends, bounds - bounds[0])
    special = [enc.encode_ordinary(x.decode()) for x in pieces.filter(pa.array(edge)).to_pylist()]
    extra = np.array([len(x) for x in special], dtype=np.int64)
    source = np.concatenate([ids, np.array([t for x in special for t in x], dtype=np.uint32)])
    place, many = np.empty(len(at), dtype=np.int64), np.empty(len(at), dtype=np.int64)
    which = inner.indices.to_numpy()
    place[~edge], many[~edge] = begin[which], np.diff(begin)[which]
    place[edge], many[edge] = len(ids) + np.cumsum(extra) - extra, extra
    upto = np.concatenate([[0], np.cumsum(many)])
    src = np.repeat(place - upto[:-1], many) + np.arange(upto[-1])
    return source[src], upto[np.searchsorted(at, byte0)]


def encode(ids: np.ndarray, first: np.ndarray) -> list[bytes]:
    """The codes of each row."""
    parts: list[list[bytes]] = [[] for _ in range(len(first) - 1)]
    levels = np.zeros(len(parts), dtype=np.int64)
    value, first = ids.astype(np.uint64), np.asarray(first, dtype=np.int64)
    live = np.arange(len(parts))
    while len(live):
        size = np.diff(first)
        chunk = (value & np.uint64(255)).astype(np.uint8)
        value = value >> np.uint64(8)
        more = value > 0
        upto = np.concatenate([[0], np.cumsum(more)])
        on = upto[first]
        goes = np.diff(on) > 0
        # Bitmaps and directories of all rows at once, each row from a whole block on.
        blocks = -(-size // BLOCK)
        block0 = np.concatenate([[0], np.cumsum(blocks)])
        place = np.arange(len(more)) - np.repeat(first[:-1], size) + np.repeat(block0[:-1] * BLOCK, size)
        bits = np.zeros(int(block0[-1]) * BLOCK, dtype=np.uint8)
        bits[place] = more
        maps = np.packbits(bits, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(bits.reshape(-1, BLOCK).sum(1, dtype=np.int64))])
        before = (ones[:-1] - np.repeat(ones[block0[:-1]], blocks)).astype("<u4")
        data = chunk.tobytes()
        for k, d in enumerate(live.tolist()):
            a, b = int(first[k]), int(first[k + 1])
            parts[d].append(int(b - a).to_bytes(4, "little") + data[a:b])
            levels[d] += 1
            if goes[k]:
                m = int(block0[k]) * (BLOCK // 8)
                parts[d].append(maps[m : m + (b - a + 7) // 8].tobytes() + before[block0[k] : block0[k + 1]].tobytes())
        value = value[more]
        first = np.concatenate([[0], np.cumsum(np.diff(on)[goes])])
        live = live[goes]
    return [bytes([int(n)]) + b"".join(p) for n, p in zip(levels, parts, strict=True)]


def _layout(codes: bytes) -> list[tuple[int, int, int, int]]:
    """(entries, where chunks, bitmap and directory begin) of each level."""
    out, at, levels = [], 1, codes[0]
    for k in range(levels):
        n = int.from_bytes(codes[at : at + 4], "little")
        chunks = at + 4
        maps = chunks + n
        directory = maps + (n + 7) // 8
        out.append((n, chunks, maps, directory))
        at = directory + 4 * -(-n // BLOCK) if k < levels - 1 else maps
    return out


def token_at(codes: bytes, i: int) -> int | None:
    """Token i of a document, by its chunks and ranks alone; None outside it."""
    levels, value = _layout(codes), 0
    if i < 0 or i >= levels[0][0]:
        return None
    for k, (_, chunks, maps, directory) in enumerate(levels):
        value |= codes[chunks + i] << (8 * k)
        if k == len(levels) - 1 or not codes[maps + i // 8] >> (i % 8) & 1:
            break
        block = i // BLOCK
        rank = int.from_bytes(codes[directory + 4 * block : directory + 4 * block + 4], "little")
        within = int.from_bytes(codes[maps + block * (BLOCK // 8) : maps + i // 8 + 1], "little") & ((1 << (i % BLOCK)) - 1)
        i = rank + within.bit_count()
    return value


def decode(codes: bytes) -> np.ndarray:
    """All ids, for round trips."""
    levels = _layout(codes)
    out, where = np.zeros(levels[0][0], dtype=np.uint64), np.arange(levels[0][0])
    for k, (n, chunks, maps, _) in enumerate(levels):
        out[where] |= np.frombuffer(codes, np.uint8, n, chunks).astype(np.uint64) << np.uint64(8 * k)
        if k < len(levels) - 1:
            where = where[np.unpackbits(np.frombuffer(codes, np.uint8, (n + 7) // 8, maps), bitorder="little")[:n].astype(bool)]
    return out.astype(np.uint32)


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, text_col, SLICE_BYTES):
                ids, first = token_ids(part.column(1), vocabulary)
                null = part.column(1).is_null().to_numpy(zero_copy_only=False)
                codes = [None if x else c for x, c in zip(null.tolist(), encode(ids, first), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first), mask=null), pa.array(codes, type=pa.binary())], ["doc_id", "n_tokens", "codes"])

    return narrow(docs, id_col, text_col).mapInArrow(make, f"doc_id {id_type(docs, id_col)}, n_tokens long, codes binary")


def token_column(codes: str, place: str) -> Column:
    """Column of the token at ``place`` of each row's codes; null outside, or where either is null."""

    @F.pandas_udf("long")
    def get(c: pd.Series, i: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or pd.isna(j) else token_at(x, int(j)) for x, j in zip(c, i, strict=True)], dtype="Int64")

    return get(codes, place)
