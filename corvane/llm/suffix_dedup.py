"""Passages that repeat across documents, by suffix arrays of shards.

Result: one row (doc_id, start_word, end_word, n_words, first_doc_id) for each
longest run of words of a document all of whose windows of ``least`` words also
occur in the document first_doc_id, the least doc_id that has them. Rows are
given for the documents that repeat an earlier one; that one keeps its passage.

Which text a shard gets: every window of ``least`` words chooses the one of its
runs of ``k`` words that has the least hash (winnowing), and so does every copy
of the window. Windows whose chosen run occurs in one document only don't
repeat. The others go to a shard named by the set of documents that share the
run, so all copies of a window meet in one shard, and the windows of a longer
passage go together as one stretch. Each shard then sorts all suffixes by
induced sorting, computes permuted common prefixes, and reads repeated windows
off the runs of the suffix array. Nothing is sampled or capped.

Defined cases: null doc_id: row ignored. Null or empty text, or fewer than
``least`` words: no rows. Documents with equal words: all but the first are one
row over the whole text. Repeated rows of one doc_id count once. A passage that
repeats within one document only gives no row. Other columns are ignored. Empty
table: empty result. Words are compared by 64-bit hashes at selection and by
32-bit hashes in the arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkernel as tk
from .cluster import cut, narrow
from .suffix_array import permuted_lcp, suffix_array

LEAST, K, SHARD_WORDS = 50, 30, 400_000
_U = np.uint64


def winnow(w: tk.Words, least: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the chosen runs of k words, and the first and last start (among all words) of the windows that choose each.

    A window of ``least`` words of one row chooses the first of its runs of least hash.
    """
    n = len(w.hash)
    if n < least:
        none = np.zeros(0, dtype=np.int64)
        return none.view(_U), none, none
    # Hash of k words by doubling: k is written as a sum of powers of two.
    block, size, run, have = w.hash, 1, None, 0
    left = k
    while left:
        if left & 1:
            part = np.concatenate([block[have:], np.zeros(min(have, n), dtype=_U)])[:n]
            run = part if run is None else tk.mix(run * tk._M3 + part)
            have += size
        left >>= 1
        if left:
            block = tk.mix(block * tk._M3 + np.concatenate([block[size:], np.zeros(min(size, n), dtype=_U)])[:n])
            size *= 2
    at = np.arange(n)
    row_end = np.repeat(w.first[1:], w.counts)
    none = _U(2**64 - 1)
    run[at + k > row_end] = none
    width = least - k + 1
    # Least of each window by doubling; the leftmost among equals.
    best, reach = at.copy(), 1
    while reach < width:
        step = min(reach, width - reach)
        other = np.concatenate([best[step:], np.repeat(best[-1], min(step, n))])[:n]
        best = np.where(run[other] < run[best], other, best)
        reach += step
    start = np.flatnonzero(at + least <= row_end)
    turn = np.ones(len(start), dtype=bool)
    turn[1:] = (best[start[1:]] != best[start[:-1]]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(turn)
    tail = np.append(head[1:], len(start)) - 1
    return run[best[start[head]]], start[head], start[tail]


def _fingerprints(least: int, k: int, text: str):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, text):
                w = tk.words(part.column(1))
                k1, k2 = tk.sequence_keys(w)
                run, lo, hi = winnow(w, least, k)
                row = np.searchsorted(w.first, lo, side="right") - 1
                first = np.searchsorted(lo, w.first).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(first), pa.array(x)) for x in (run.view(np.int64), (lo - w.first[row]).astype(np.int32), (hi - lo).astype(np.int32))]
                out = pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(k1), pa.array(k2), pa.array(w.counts), *lists], ["doc_id", "k1", "k2", "n", "fp", "lo", "more"])
                yield out.filter(pa.array(w.counts >= least))

    return make


def _pieces(text: str):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, text):
                w = tk.words(part.column(1))
                ids = part.column(0).to_pylist()
                rows: list[list] = [[], [], [], []]
                small = (w.hash >> _U(32)).astype(np.uint32)
                for d, spans in enumerate(part.column(2).to_pylist()):
                    a, b = int(w.first[d]), int(w.first[d + 1])
                    for x in spans:
                        lo, hi = max(a, a + x["lo"]), min(b, a + x["hi"])
                        rows[0].append(x["shard"])
                        rows[1].append(ids[d])
                        rows[2].append(lo - a)
                        rows[3].append(small[lo:hi].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(r, type=t) for r, t in zip(rows, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["shard", "doc_id", "lo", "words"])

    return make


def repeats(words: np.ndarray, piece_first: np.ndarray, doc: np.ndarray, lo: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(doc, start, end, first doc) of the repeated passages among some pieces of documents."""
    n_pieces = len(doc)
    sizes = np.diff(piece_first)
    _, symbols = np.unique(words, return_inverse=True)
    t = np.empty(len(words) + n_pieces + 1, dtype=np.int64)
    owner = np.repeat(np.arange(n_pieces), sizes + 1)
    begin = piece_first[:-1] + np.arange(n_pieces)
    is_word = np.ones(len(t) - 1, dtype=bool)
    is_word[begin + sizes] = False
    t[:-1][is_word] = symbols + n_pieces + 1
    t[begin + sizes] = np.arange(1, n_pieces + 1)
    t[-1] = 0
    sa = suffix_array(t)
    lcp = permuted_lcp(t, sa)[sa]
    run = np.cumsum(lcp < least) - 1
    size = np.bincount(run)
    keep = size[run] > 1
    sa, run = sa[keep], run[keep]
    if not len(sa):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    heads = np.flatnonzero(np.diff(run, prepend=-1))
    docs = doc[owner[sa]]
    first = np.repeat(np.minimum.reduceat(docs, heads), np.diff(np.append(heads, len(run))))
    later = docs != first
    sa, docs, first = sa[later], docs[later], first[later]
    start = lo[owner[sa]] + sa - begin[owner[sa]]
    return merge(docs, start, start + least, first)


def merge(doc: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Joins spans of one document and one first document that overlap or touch."""
    if not len(doc):
        return doc, start, end, first
    order = np.lexsort((start, first, doc))
    doc, start, end, first = (x[order] for x in (doc, start, end, first))
    turn = np.ones(len(doc), dtype=bool)
    turn[1:] = (doc[1:] != doc[:-1]) | (first[1:] != first[:-1])
    group = np.cumsum(turn)
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * wide) - group * wide
    new = turn.copy()
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return doc[at], start[at], np.maximum.reduceat(end, at), first[at]


def _shard(least: int):
    def sort(pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by([("doc_id", "ascending"), ("lo", "ascending")])
        blobs = pieces.column("words").to_pylist()
        sizes = np.array([len(b) // 4 for b in blobs], dtype=np.int64)
        words = np.frombuffer(b"".join(blobs), dtype=np.uint32)
        got = repeats(words, np.concatenate([[0], np.cumsum(sizes)]), pieces.column("doc_id").to_numpy(), pieces.column("lo").to_numpy().astype(np.int64), least)
        return pa.table(dict(zip(("doc_id", "start_word", "end_word", "first_doc_id"), got, strict=True)))

    return sort


def repeated_passages(docs: DataFrame, least: int = LEAST, k: int = K, shard_words: int = SHARD_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    docs = narrow(docs, id_col, text_col).withColumnsRenamed({id_col: "doc_id", text_col: "text"})
    marks = cut(docs.mapInArrow(_fingerprints(least, k, "text"), "doc_id long, k1 long, k2 long, n long, fp array<long>, lo array<int>, more array<int>"))
    same = W.partitionBy("k1", "k2")
    ranked = marks.select("doc_id", "k1", "k2", "n").withColumn("rep", F.min("doc_id").over(same))
    copies = ranked.where("doc_id <> rep").select("doc_id", F.lit(0).cast("long").alias("start_word"), F.col("n").alias("end_word"), F.col("rep").alias("first_doc_id")).distinct()
    hits = marks.join(ranked.where("doc_id <> rep").select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.explode(F.arrays_zip("fp", "lo", "more")).alias("x")).select("doc_id", "x.*")
    among = W.partitionBy("fp")
    shared = (
        hits.withColumns({"low": F.min("doc_id").over(among), "high": F.max("doc_id").over(among), "docs": F.sum(F.xxhash64("doc_id").bitwiseAND(0xFFFFFFFFFF)).over(among)})
        .where("low <> high")
        .select("doc_id", "lo", (F.col("lo") + F.col("more")).alias("hi"), F.xxhash64("docs", "low", "high").alias("team"))
    )
    # Stretches of one document and team: windows that start side by side. No other window lies in a stretch.
    by = W.partitionBy("doc_id", "team").orderBy("lo")
    spans = cut(
        shared.withColumn("gap", F.coalesce(F.col("lo") > F.lag("hi").over(by) + 1, F.lit(True)).cast("int"))
        .withColumn("stretch", F.sum("gap").over(by))
        .groupBy("doc_id", "team", "stretch")
        .agg(F.min("lo").alias("lo"), (F.max("hi") + least).alias("hi"))
        .drop("stretch")
    )
    total = spans.agg(F.sum(F.col("hi") - F.col("lo"))).first()[0] or 0
    shards = total // shard_words + 1
    wanted = spans.groupBy("doc_id").agg(F.collect_list(F.struct(F.pmod(F.xxhash64("team"), F.lit(shards)).alias("shard"), "lo", "hi")).alias("spans"))
    once = docs.join(wanted, "doc_id").select("doc_id", "text", "spans")
    found = (
        once.mapInArrow(_pieces("text"), "shard long, doc_id long, lo int, words binary")
        .groupBy("shard")
        .applyInArrow(_shard(least), "doc_id long, start_word long, end_word long, first_doc_id long")
        .unionByName(copies)
    )
    # The stretches of one passage may have met in several shards.
    line = W.partitionBy("doc_id", "first_doc_id").orderBy("start_word", "end_word")
    before = line.rowsBetween(W.unboundedPreceding, -1)
    return (
        found.withColumn("new", F.coalesce(F.col("start_word") > F.max("end_word").over(before), F.lit(True)).cast("int"))
        .withColumn("part", F.sum("new").over(line))
        .groupBy("doc_id", "first_doc_id", "part")
        .agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"))
        .select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_doc_id")
    )


def brute_force(docs: list[tuple[int, str | None]], least: int = LEAST) -> set[tuple[int, int, int, int]]:
    """(doc_id, start, end, first doc) by a dictionary of all windows; for tests."""
    texts = {i: tk.py_words(t) for i, t in docs}
    whole: dict[tuple, int] = {}
    for i, w in texts.items():
        whole[tuple(w)] = min(whole.get(tuple(w), i), i)
    copies = {(i, 0, len(w), whole[tuple(w)]) for i, w in texts.items() if len(w) >= least and whole[tuple(w)] != i}
    texts = {i: w for i, w in texts.items() if whole[tuple(w)] == i}
    first: dict[tuple, int] = {}
    for i, w in texts.items():
        for p in range(len(w) - least + 1):
            x = tuple(w[p : p + least])
            first[x] = min(first.get(x, i), i)
    rows = [(i, p, p + least, f) for i, w in texts.items() for p in range(len(w) - least + 1) if (f := first[tuple(w[p : p + least])]) != i]
    if not rows:
        return copies
    got = merge(*(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)))
    return copies | set(zip(*(x.tolist() for x in got), strict=True))
