"""Benchmark items that occur in documents, within an edit distance.

A window of as many words as the item has matches it if their word edit
distance is at most k = floor(``ratio`` * words of the item). Of a document with
fewer words, but no more than k fewer, the whole text is the window. Result: one row
(doc_id, item_id, distance, start_word, n_words) for each document and item
that match, of the window of least distance, then least start; n_words are the
words of the window.

Search: a window within k edits of an item of L words shares with it a run of
floor(L / (k + 1)) words, by the pigeonhole principle. So a window of L words is
looked at only if it lies, at most k words shifted, on a run of some item of that length;
that loses none, and spares the embedding of all other windows of the corpus. (Of a text
shorter than the item, the whole is such a window.) Each window that is left is embedded by the CGK
random walk, under which edit distance becomes Hamming distance: step j copies the
word at the walk's place and moves on by a random bit that depends on j and the word.
Bit-sampling LSH then takes ``coordinates`` random places of the embedding (one, for
windows of ``LONG`` words and more), whose words are the key of a bucket, in R
repetitions with fresh walks; items in a window's buckets are its candidates. R is
set for each length, by trial: so many repetitions that of ``TRIALS`` windows k random edits away
from items of that length a share of ``recall`` and two standard errors was found. (Where a
benchmark has more than ``LENGTHS`` lengths, those between two tried ones take the greater R.)
Candidates are verified by the exact banded dynamic programme.

The benchmark is broadcast in parts of at most ``ITEM_WORDS`` words (some 100 MB with its tables), one
scan of the documents for each part. Defined cases: null doc_id or item_id: row
ignored; ids of any type. Null or empty texts, or texts without words, of either side: no match.
Documents more than k words shorter than the item: no match. Equal items: a row for each. Repeated
rows of one doc_id: one row for an item. Other columns are ignored, whatever
their names. Empty tables: empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .cluster import id_type, narrow, without

RATIO, RECALL, COORDINATES, LONG, ITEM_WORDS, SEED = 0.2, 0.98, 2, 100, 1_000_000, 7
TRIALS, LENGTHS = 400, 64
#: Bytes of text searched at once: windows are few, so that steps on larger arrays cost hardly more.
SLICE_BYTES = 8_000_000
_U = np.uint64
_PAD = _U(0x5851F42D4C957F2D)


def walk(text: np.ndarray, start: np.ndarray, size: np.ndarray, coords: np.ndarray, seed: int) -> np.ndarray:
    """Words at the sampled coordinates of the CGK embeddings of text[start:start+size].

    coords: (windows, m) sorted along the last axis, each below 3 * size.
    """
    n, m = coords.shape
    out = np.empty((n, m), dtype=_U)
    place, col = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    live = np.arange(n)
    for j in range(int(coords.max(initial=-1)) + 1):
        inside = place[live] < size[live]
        c = np.full(len(live), _PAD, dtype=_U)
        c[inside] = text[start[live[inside]] + place[live[inside]]]
        while True:
            hit = (col[live] < m) & (coords[live, np.minimum(col[live], m - 1)] == j)
            if not hit.any():
                break
            out[live[hit], col[live[hit]]] = c[hit]
            col[live[hit]] += 1
        place[live] += (tk.mix(c + _U((seed * 1_000_003 + j) * 2 + 1)) >> _U(63)).astype(np.int64)
        keep = col[live] < m
        live = live[keep]
    return out


def edit_distance(a: np.ndarray, b: np.ndarray, most: int, size: np.ndarray | None = None, wide: np.ndarray | None = None) -> np.ndarray:
    """Word edit distances of the rows of a to those of b (at most ``most`` words apart), most + 1 where greater.

    size, wide: words of each row of a and of b, where rows are padded.
    """
    n = len(a)
    size = np.full(n, a.shape[1]) if size is None else size
    wide = np.full(n, b.shape[1]) if wide is None else wide
    big, width = most + 1, 2 * most + 1
    out = np.full(n, big, dtype=np.int16)
    row = np.full((n, width), big, dtype=np.int16)
    for d in range(most, width):
        row[:, d] = min(d - most, big)
    for i in range(1, a.shape[1] + 1):
        new = np.full((n, width), big, dtype=np.int16)
        for d in range(max(0, most - i), min(width, b.shape[1] - i + most + 1)):
            j = i + d - most
            best = np.full(n, big, dtype=np.int16)
            if j:
                best = row[:, d] + (a[:, i - 1] != b[:, j - 1])
            if d + 1 < width:
                best = np.minimum(best, row[:, d + 1] + 1)
            if d and j:
                best = np.minimum(best, new[:, d - 1] + 1)
            new[:, d] = np.minimum(best, big)
        row = new
        end = np.flatnonzero(size == i)
        out[end] = row[end, most + wide[end] - i]
    return out.astype(np.int32)


class Items:
    """The benchmark in arrays: runs for the first selection, and the buckets of its embeddings."""

    def __init__(self, ids: pa.Array, texts: pa.Array, ratio: float, recall: float, coordinates: int, seed: int) -> None:
        w = tk.words(texts)
        keep = np.flatnonzero(w.counts > 0)
        self.id = ids.take(pa.array(keep))
        self.first, self.hash = w.first[:-1][keep], w.hash
        #: Lengths that occur, and the place of each item's among them.
        self.size, self.of = np.unique(w.counts[keep], return_inverse=True)
        self.most = np.floor(self.size * ratio + 1e-9).astype(np.int64)
        self.run = self.size // (self.most + 1)
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for q in np.unique(self.run).tolist():
            found = [np.zeros((0, 3), dtype=np.int64)]
            for i in np.flatnonzero(self.run[self.of] == q).tolist():
                g = grams(w.hash[self.first[i] : self.first[i] + self.size[self.of[i]]], q)
                found.append(np.stack([g.view(np.int64), np.full(len(g), self.of[i]), np.arange(len(g))], 1))
            rows = np.unique(np.concatenate(found), axis=0)
            rows = rows[np.argsort(rows[:, 0].view(_U), kind="stable")]
            self.runs[q] = rows[:, 0].copy().view(_U), rows[:, 1].copy(), rows[:, 2].copy()
        self.seed, self.coordinates = seed, coordinates
        self.many = self._repetitions(recall) if len(keep) else np.zeros(0, dtype=np.int64)
        self.buckets: list[tuple[np.ndarray, np.ndarray]] = []
        for r in range(int(self.many.max(initial=0))):
            on = np.flatnonzero(self.many[self.of] > r)
            key = self.keys(w.hash, self.first[on], self.size[self.of[on]], self.of[on], r)
            order = np.argsort(key, kind="stable")
            self.buckets.append((key[order], on[order]))

    def places(self, r: int) -> np.ndarray:
        """Coordinates of repetition r, for each length; walks end at about twice the length."""
        rng = np.random.default_rng([self.seed, r])
        at = (rng.random((len(self.size), self.coordinates)) * (2 * self.size)[:, None]).astype(np.int64)
        at[self.size >= LONG] = at[self.size >= LONG, :1]
        return np.sort(at, axis=1)

    def keys(self, text: np.ndarray, start: np.ndarray, size: np.ndarray, of: np.ndarray, r: int) -> np.ndarray:
        """Bucket of each window text[start:start+size] in repetition r, as one of the length ``of``."""
        got = walk(text, start, size, self.places(r)[of], self.seed * 1000 + r)
        h = of.astype(_U)
        for k in range(got.shape[1]):
            h = tk.mix(h * tk._M3 + got[:, k])
        return h

    def _repetitions(self, recall: float) -> np.ndarray:
        """Repetitions for each length; see the module."""
        rng = np.random.default_rng(self.seed)
        tried = np.arange(len(self.size))
        if len(tried) > LENGTHS:
            want = np.geomspace(self.size[0], self.size[-1], LENGTHS)
            tried = np.unique(np.minimum(np.searchsorted(self.size, want), len(self.size) - 1))
        rows, picks = [], []
        for s in tried.tolist():
            for i in rng.choice(np.flatnonzero(self.of == s), TRIALS).tolist():
                x = self.hash[self.first[i] : self.first[i] + self.size[s]].tolist()
                for _ in range(int(self.most[s])):
                    p, kind = int(rng.integers(0, len(x))), int(rng.integers(0, 3))
                    if kind == 0:
                        x[p] = int(rng.integers(1, 2**62))
                    elif kind == 1:
                        x.insert(p, int(rng.integers(1, 2**62)))
                        x.pop()
                    else:
                        x.pop(p)
                        x.append(int(rng.integers(1, 2**62)))
                rows += x
                picks.append(i)
        text, pick = np.array(rows, dtype=_U), np.array(picks)
        of = self.of[pick]
        first = np.concatenate([[0], np.cumsum(self.size[of])])[:-1]
        found = np.zeros(len(pick), dtype=bool)
        need = min(1.0, recall + 2 * (recall * (1 - recall) / TRIALS) ** 0.5)
        many, r = np.zeros(len(self.size), dtype=np.int64), 0
        open_ = np.arange(len(pick))
        while len(open_):
            a = self.keys(text, first[open_], self.size[of[open_]], of[open_], r)
            b = self.keys(self.hash, self.first[pick[open_]], self.size[of[open_]], of[open_], r)
            found[open_[a == b]] = True
            r += 1
            share = np.bincount(of, found, minlength=len(many)) / np.maximum(np.bincount(of, minlength=len(many)), 1)
            many[np.unique(of[open_])] = r
            open_ = open_[share[of[open_]] < need]
        after = tried[np.minimum(np.searchsorted(tried, np.arange(len(many))), len(tried) - 1)]
        before = tried[np.maximum(np.searchsorted(tried, np.arange(len(many)), side="right") - 1, 0)]
        return np.maximum(many[before], many[after])


def grams(h: np.ndarray, q: int) -> np.ndarray:
    n = len(h) - q + 1
    g = h[: max(n, 0)].copy()
    for k in range(1, q):
        g *= tk._M3
        g += h[k : n + k]
    return tk.mix(g)


def _match(shared):
    def windows(items: Items, tables: dict[int, np.ndarray], w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
        """(length, first word) of the windows that lie on a run of an item of that length."""
        wide = len(w.hash) + 1
        out = [np.zeros(0, dtype=np.int64)]
        row_end = np.repeat(w.first[1:], w.counts)
        row_first = np.repeat(w.first[:-1], w.counts)
        for q, (key, of, at) in items.runs.items():
            g = grams(w.hash, q)
            p = np.flatnonzero(tables[q][g >> _U(42)])
            lo, hi = np.searchsorted(key, g[p], side="left"), np.searchsorted(key, g[p], side="right")
            many = hi - lo
            p, lo = np.repeat(p, many), np.repeat(lo, many)
            nth = lo + np.arange(len(p)) - np.repeat(np.cumsum(many) - many, many)
            of_, start = of[nth], p - at[nth]
            k = items.most[of_]
            shifts = 2 * k + 1
            src = np.repeat(np.arange(len(of_)), shifts)
            start = start[src] + np.arange(len(src)) - np.repeat(np.cumsum(shifts) - shifts, shifts) - k[src]
            size = items.size[of_[src]]
            ok = (start >= row_first[p[src]]) & (start + size <= row_end[p[src]])
            out.append(np.unique(of_[src][ok] * wide + start[ok]))
            have = row_end[p] - row_first[p]
            ok = (have < items.size[of_]) & (have >= items.size[of_] - k)
            out.append(np.unique(of_[ok] * wide + row_first[p[ok]]))
        both = np.concatenate(out)
        return both // wide, both % wide

    def settle(items: Items, w: tk.Words, of: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
        """(item, first word, distance, words) of the windows that match."""
        row = np.searchsorted(w.first, start, side="right") - 1
        have = np.minimum(w.first[row + 1] - start, items.size[of])
        met = [np.zeros(0, dtype=np.int64)]
        for r, (bucket, item) in enumerate(items.buckets):
            at = np.flatnonzero(items.many[of] > r)
            key = items.keys(w.hash, start[at], have[at], of[at], r)
            lo, hi = np.searchsorted(bucket, key, side="left"), np.searchsorted(bucket, key, side="right")
            many = hi - lo
            nth = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            met.append(np.repeat(at, many) * len(items.of) + item[nth])
        pair = np.unique(np.concatenate(met))
        at, i = pair // max(len(items.of), 1), pair % max(len(items.of), 1)
        start, have, of = start[at], have[at], of[at]
        d = np.empty(len(i), dtype=np.int32)
        for most in np.unique(items.most[of]).tolist():
            m = np.flatnonzero(items.most[of] == most)
            size, n = items.size[of[m]], have[m]
            item = items.hash[np.minimum(items.first[i[m]][:, None] + np.arange(size.max()), len(items.hash) - 1)]
            d[m] = edit_distance(w.hash[np.minimum(start[m][:, None] + np.arange(n.max()), len(w.hash) - 1)], item, most, n, size)
        ok = d <= items.most[of]
        return i[ok], start[ok], d[ok], have[ok]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        tables = {}
        for q, (key, _, _) in items.runs.items():
            tables[q] = np.zeros(1 << 22, dtype=bool)
            tables[q][key >> _U(42)] = True
        for batch in batches:
            for part in tk.slices(batch, "text", SLICE_BYTES):
                w = tk.words(part.column(1))
                if not len(w.hash) or not len(items.of):
                    continue
                i, start, d, have = settle(items, w, *windows(items, tables, w))
                row = np.searchsorted(w.first, start, side="right") - 1
                order = np.lexsort((start, d, i, row))
                i, start, d, have, row = i[order], start[order], d[order], have[order], row[order]
                new = np.ones(len(i), dtype=bool)
                new[1:] = (i[1:] != i[:-1]) | (row[1:] != row[:-1])
                i, start, d, have, row = i[new], start[new], d[new], have[new], row[new]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), items.id.take(pa.array(i)), pa.array(d), pa.array(start - w.first[row]), pa.array(have.astype(np.int32))], ["doc_id", "item_id", "distance", "start_word", "n_words"])

    return find


def leaks(docs: DataFrame, benchmark: DataFrame, ratio: float = RATIO, recall: float = RECALL, coordinates: int = COORDINATES, item_words: int = ITEM_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    docs = narrow(docs, id_col, text_col).toDF("doc_id", "text")
    items = narrow(benchmark, item_col, item_text_col).toDF("item_id", "text").where("text is not null")
    # Items in parts of bounded size; each is one pass over the documents.
    total = items.agg(F.sum(F.greatest(F.length("text"), F.lit(1)))).first()[0] or 0
    parts = total // (6 * item_words) + 1
    schema = f"doc_id {id_type(docs)}, item_id {id_type(items, 'item_id')}, distance int, start_word long, n_words int"
    out = None
    for p in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p).orderBy("item_id", "text").toArrow().combine_chunks()
        ids, texts = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (rows.column(0), rows.column(1)))
        shared = docs.sparkSession.sparkContext.broadcast(Items(ids, texts, ratio, recall, coordinates, seed))
        found = docs.mapInArrow(_match(shared), schema)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "start_word", "n_words")).alias("best")).select("doc_id", "item_id", "best.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how: float) -> DataFrame:
    """docs without those in which an item occurs; rows with a null doc_id stay, and all columns."""
    return without(docs, leaks(docs, benchmark, id_col=id_col, **how), id_col)


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], ratio: float = RATIO) -> dict[tuple[int, int], tuple[int, int]]:
    """(doc_id, item_id) -> (distance, start) by plain dynamic programming over every window; for tests."""
    out: dict[tuple[int, int], tuple[int, int]] = {}
    for i, t in docs:
        w = tk.py_words(t)
        for j, u in items:
            v = tk.py_words(u)
            k = math.floor(len(v) * ratio + 1e-9)
            size = len(v) if len(w) >= len(v) else max(len(w), len(v) - k)
            for s in range(len(w) - size + 1 if v else 0):
                row = list(range(len(v) + 1))
                for a in range(1, size + 1):
                    last, row[0] = row[0], a
                    for b in range(1, len(v) + 1):
                        last, row[b] = row[b], min(row[b] + 1, row[b - 1] + 1, last + (w[s + a - 1] != v[b - 1]))
                if row[-1] <= k:
                    out[i, j] = min(out.get((i, j), (k + 1, 0)), (row[-1], s))
    return out
