"""SimHash near-duplicate groups by the generalised pigeonhole principle.

A document's signature has 128 bits: SimHash over its set of words (64 bits,
searched) and over its set of word pairs (64 bits, which confirm a match). Two
documents match when the first halves differ in at most ``tau`` bits and the
whole signatures in at most ``tau_all``; groups are the components of that
relation, and the least doc_id of a group stays.

Search is exact. Bits are ordered so that correlated ones are neighbours, cut
into m partitions, and given thresholds t_i with sum(t_i) >= tau - m + 1: two
signatures within tau then differ by at most t_i in some partition i. A dynamic
programme picks the t_i (-1 leaves a partition out) of least cost, from the
number of candidate pairs at each distance, which is counted over all
signatures. Both sides of a match at distance t meet in a cell within t/2 of
each, so a signature is sent to the cells within ceil(t/2) of it only. A cell of more than
about ``CELL_ROWS`` signatures is split in blocks, and every two blocks are compared in a cell
of their own, so that no task holds more than two of them. (Which cells are that
large is told from one signature in 64 by hash; speed depends on it, the result doesn't.)

Defined cases: null doc_id: row ignored; ids of any type with an order. Null or empty text, or text without
words: belongs to no group. Equal texts, and repeated rows of one doc_id: equal
signatures, same group (repeated rows of one doc_id count as one document).
Other columns are ignored, whatever their names. Empty table: empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .cluster import components, cut, hot_join, id_type, narrow, without

BITS, TAU, TAU_ALL = 64, 10, 26
CELL_ROWS, SHARE = 8_192, 64
ROW_COST, PAIR_COST = 1.5e-6, 4e-9  # seconds for a row sent to a cell, for a pair compared

_U = np.uint64
_LANES = np.zeros(256, dtype=_U)
for _j in range(8):
    _LANES |= ((np.arange(256, dtype=_U) >> _U(_j)) & _U(1)) << _U(8 * _j)


def distinct_rows(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row of a ragged array."""
    v = values.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a > 1:
            v[a:b].sort()
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = v[1:] != v[:-1]
    heads = first[:-1][np.diff(first) > 0]
    keep[heads] = True
    return v[keep], np.concatenate([[0], np.cumsum(keep)])[first]


def simhash(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each row of distinct 64-bit hashes: a bit is 1 if most hashes have it.

    Ones are counted in 8 lanes of a 64-bit integer at a time, over at most 255 hashes.
    """
    counts = np.diff(first)
    blocks = -(-counts // 255)
    starts = np.repeat(first[:-1], blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    block_first = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros(len(counts), dtype=_U)
    if not len(starts):
        return out
    octets = values.view(np.uint8).reshape(-1, 8)
    for b in range(8):
        lanes = np.add.reduceat(_LANES[octets[:, b]], starts)
        ones = tk.row_sums(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), block_first)
        for j in range(8):
            out |= (2 * ones[:, j] > counts).astype(_U) << _U(8 * b + j)
    return out


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, s1, s2) for each document with words."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, text_col):
                w = tk.words(part.column(1))
                s1 = simhash(*distinct_rows(w.hash, w.first))
                s2 = simhash(*distinct_rows(*tk.shingles(w, 2)))
                full = w.counts > 0
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(full)), pa.array(s1[full].view(np.int64)), pa.array(s2[full].view(np.int64))], ["doc_id", "s1", "s2"])

    return narrow(docs, id_col, text_col).mapInArrow(make, f"doc_id {id_type(docs, id_col)}, s1 long, s2 long")


def _bits(s: np.ndarray) -> np.ndarray:
    return np.unpackbits(s.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_order(points: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Bits with correlated ones side by side, the probability that two signatures agree in each, and the number of signatures."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            b = _bits(batch.column(0).to_numpy()).astype(np.float32)
            both += b.T @ b
            n += len(b)
        if n:
            i, j = np.triu_indices(BITS)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(i, BITS)), pa.array(np.append(j, BITS)), pa.array(np.append(both[i, j], n).astype(np.int64))], ["i", "j", "n"])

    rows = points.select("s1").mapInArrow(count, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, n = np.zeros((BITS, BITS)), 0
    for r in rows:
        if r.i == BITS:
            n = r.n
        else:
            both[r.i, r.j] = both[r.j, r.i] = r.n
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    order = list(np.unravel_index(np.argmax(corr), corr.shape))
    while len(order) < BITS:
        near = corr[:, order[-8:]].sum(1)
        near[order] = -1
        order.append(int(np.argmax(near)))
    return np.array(order), (p * p + (1 - p) * (1 - p))[order], n


def _ball(width: int, radius: int) -> int:
    return sum(math.comb(width, r) for r in range(radius + 1))


def _meet(width: int, d: int, r: int) -> int:
    """Cells within r of both of two values at distance d."""
    return sum(math.comb(d, i) * math.comb(width - d, j) for i in range(d + 1) for j in range(width - d + 1) if i + j <= r and d - i + j <= r)


def allocate(widths: list[int], at_distance: list[np.ndarray], n: int, tau: int = TAU) -> tuple[list[int], float]:
    """Thresholds of least cost, by dynamic programming over partitions and what they still have to sum to.

    at_distance[i][d]: pairs of signatures whose partition i differs in d bits.
    """
    choices = [-1, 0, *range(2, tau + 2, 2)]
    need = tau - len(widths) + 1 + len(widths)  # thresholds count from -1
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(math.inf, [])] * need
    for width, pairs in zip(widths, at_distance, strict=True):
        nxt: list[tuple[float, list[int]]] = [(math.inf, [])] * (need + 1)
        for t in choices:
            r = (t + 1) // 2
            cost = 0.0
            if t >= 0:
                if r > width or _ball(width, r) > 5_000:
                    continue
                cost = ROW_COST * n * _ball(width, r) + PAIR_COST * sum(pairs[d] * _meet(width, d, r) for d in range(min(2 * r, width) + 1))
            for had, (spent, ts) in enumerate(best):
                to = min(need, had + t + 1)
                if spent + cost < nxt[to][0]:
                    nxt[to] = (spent + cost, [*ts, t])
        best = nxt
    return best[need][1], best[need][0]


def _widths(m: int) -> list[int]:
    return [BITS // m + (i < BITS % m) for i in range(m)]


def _independent(agree: np.ndarray, n: int) -> np.ndarray:
    pmf = np.ones(1)
    for a in agree:
        pmf = np.convolve(pmf, [a, 1 - a])
    return pmf * n * (n - 1) / 2


def _keys(s: np.ndarray, bits: np.ndarray) -> np.ndarray:
    out = np.zeros(len(s), dtype=_U)
    for k, b in enumerate(bits.tolist()):
        out |= ((s >> _U(b)) & _U(1)) << _U(k)
    return out


def _counted(points: DataFrame, chunks: list[np.ndarray], n: int) -> list[np.ndarray]:
    """Share of pairs at each distance in each chunk of at most 16 bits, from the counts of all its values."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column(0).to_numpy().view(_U)
            for c, bits in enumerate(chunks):
                v, k = np.unique(_keys(s, bits), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c)), pa.array(v.astype(np.int64)), pa.array(k.astype(np.int64))], ["c", "v", "k"])

    got = points.select("s1").mapInArrow(values, "c long, v long, k long").groupBy("c", "v").agg(F.sum("k").alias("k")).toArrow()
    c, v, k = (got.column(x).to_numpy() for x in ("c", "v", "k"))
    out = []
    for i, bits in enumerate(chunks):
        f = np.zeros(1 << len(bits))
        f[v[c == i]] = k[c == i]
        h = 1
        while h < len(f):  # Walsh-Hadamard transform; its square transforms back to the pairs by exclusive or
            g = f.reshape(-1, 2, h)
            f = np.stack([g[:, 0] + g[:, 1], g[:, 0] - g[:, 1]], axis=1).reshape(-1)
            h *= 2
        f = f * f
        h = 1
        while h < len(f):
            g = f.reshape(-1, 2, h)
            f = np.stack([g[:, 0] + g[:, 1], g[:, 0] - g[:, 1]], axis=1).reshape(-1)
            h *= 2
        f = np.maximum(f / len(f), 0)
        f[0] -= n
        d = np.bitwise_count(np.arange(len(f), dtype=_U)).astype(np.int64)
        out.append(np.bincount(d, weights=f, minlength=len(bits) + 1) / max(n * (n - 1), 1))
    return out


def plan(points: DataFrame, tau: int = TAU) -> list[tuple[np.ndarray, int]]:
    """(bits, threshold) of each partition that is searched."""
    order, agree, n = bit_order(points)
    best: tuple[float, int] = (math.inf, 4)
    for m in range(2, 11):
        at = np.cumsum([0, *_widths(m)])
        ts, cost = allocate(_widths(m), [_independent(agree[a:b], n) for a, b in zip(at, at[1:], strict=False)], n, tau)
        if ts:
            best = min(best, (cost, m))
    widths = _widths(best[1])
    at = np.cumsum([0, *widths])
    parts = [order[a:b] for a, b in zip(at, at[1:], strict=False)]
    chunks = [[p[i : i + 16] for i in range(0, len(p), 16)] for p in parts]
    shares = iter(_counted(points, [x for c in chunks for x in c], n))
    pairs = []
    for c in chunks:
        pmf = np.ones(1)
        for _ in c:
            pmf = np.convolve(pmf, next(shares))
        pairs.append(pmf * n * (n - 1) / 2)
    ts, _ = allocate(widths, pairs, n, tau)
    return [(p, t) for p, t in zip(parts, ts, strict=True) if t >= 0]


def _masks(width: int, radius: int) -> np.ndarray:
    masks = {0}
    for _ in range(radius):
        masks |= {x ^ (1 << k) for x in masks for k in range(width)}
    return np.array(sorted(masks), dtype=_U)


def _cells(parts: list[tuple[np.ndarray, int]], hot: np.ndarray | None = None, blocks: np.ndarray | None = None):
    """hot: sorted cells that are split, each in so many blocks; a row of one goes to the cells of its block and every other."""
    masks = [_masks(len(bits), (t + 1) // 2) for bits, t in parts]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                b = batch.slice(at, 2000)
                s1, s2 = (b.column(k).to_numpy().view(_U) for k in (0, 1))
                cell = np.concatenate([((_keys(s1, bits)[:, None] ^ m) * _U(16) + _U(i)).ravel() for i, ((bits, _), m) in enumerate(zip(parts, masks, strict=True))]).view(np.int64)
                row = np.concatenate([np.repeat(np.arange(len(s1)), len(m)) for m in masks])
                if hot is not None and len(hot):
                    near = np.minimum(np.searchsorted(hot, cell), len(hot) - 1)
                    many = np.where(hot[near] == cell, blocks[near], 1)
                    own = (tk.mix(s1 * tk._M3 + s2)[row] % many.astype(_U)).astype(np.int64)
                    src = np.repeat(np.arange(len(cell)), many)
                    other = np.arange(len(src)) - np.repeat(np.cumsum(many) - many, many)
                    lo, hi = np.minimum(own[src], other), np.maximum(own[src], other)
                    split = tk.mix((cell[src].view(_U) * tk._M3 + lo.astype(_U)) * tk._M3 + hi.astype(_U)).view(np.int64)
                    cell, row = np.where(many[src] > 1, split, cell[src]), row[src]
                rest = b.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(cell), *rest.columns], ["cell", "s1", "s2"])

    return send


def _linked(ids: np.ndarray, s1: np.ndarray, s2: np.ndarray, tau: int, tau_all: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what matches within one cell, at most one for each member."""
    n = len(ids)
    lab = np.arange(n)
    step = max(1, 4_000_000 // n)
    for at in range(0, n, step):
        d = np.bitwise_count(s1[at : at + step, None] ^ s1[None, :])
        i, j = np.nonzero(d <= tau)
        i = i + at
        keep = i < j
        i, j = i[keep], j[keep]
        if len(i):
            ok = np.bitwise_count(s1[i] ^ s1[j]) + np.bitwise_count(s2[i] ^ s2[j]) <= tau_all
            i, j = i[ok], j[ok]
        while len(i):
            low = np.minimum(lab[i], lab[j])
            np.minimum.at(lab, lab[i], low)
            np.minimum.at(lab, lab[j], low)
            lab = lab[lab]
            far = lab[i] != lab[j]
            i, j = i[far], j[far]
    while (lab[lab] != lab).any():
        lab = lab[lab]
    own = np.flatnonzero(lab != np.arange(n))
    return ids[own], ids[lab[own]]


def _search(tau: int, tau_all: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[list[np.ndarray]] = []

        def settle(cols: list[np.ndarray]) -> pa.RecordBatch:
            cell = cols[0]
            at = np.flatnonzero(np.diff(cell)) + 1
            at = np.concatenate([[0], at, [len(cell)]])
            a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if j - i > 1:
                    x, y = _linked(np.arange(i, j), cols[1][i:j].view(_U), cols[2][i:j].view(_U), tau, tau_all)
                    if len(x):
                        a.append(x)
                        b.append(y)
            x, y = np.concatenate(a), np.concatenate(b)
            edges = np.unique(np.stack([cols[1][x], cols[2][x], cols[1][y], cols[2][y]], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(edges[:, k].copy()) for k in range(4)], ["a1", "a2", "b1", "b2"])

        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if not len(cols[0]):
                continue
            turn = int(np.searchsorted(cols[0], cols[0][-1]))
            if turn:
                done = [np.concatenate([*(x[k] for x in left), cols[k][:turn]]) for k in range(3)]
                yield settle(done)
                left = []
            elif left and left[-1][0][-1] != cols[0][0]:
                yield settle([np.concatenate([x[k] for x in left]) for k in range(3)])
                left = []
            left.append([c[turn:] for c in cols])
        if left:
            yield settle([np.concatenate([x[k] for x in left]) for k in range(3)])

    return search


def _met(points: DataFrame, parts: list[tuple[np.ndarray, int]], tau: int, tau_all: int, cell_rows: int) -> DataFrame:
    """(a1, a2, b1, b2): signatures that match, enough pairs to connect those of each group."""
    schema = "cell long, s1 long, s2 long"
    some = points.select("s1", "s2").where(F.pmod(F.xxhash64("s1", "s2"), F.lit(SHARE)) == 0)
    # At most rows sent / cell_rows cells.
    hot = some.mapInArrow(_cells(parts), schema).groupBy("cell").agg((F.count(F.lit(1)) * SHARE).alias("n")).where(F.col("n") > cell_rows).orderBy("cell").toArrow()
    blocks = -(-hot.column("n").to_numpy() // cell_rows)
    sent = points.select("s1", "s2").mapInArrow(_cells(parts, hot.column("cell").to_numpy(), blocks), schema)
    return sent.repartition("cell").sortWithinPartitions("cell").mapInArrow(_search(tau, tau_all), "a1 long, a2 long, b1 long, b2 long")


def groups(docs: DataFrame, tau: int = TAU, tau_all: int = TAU_ALL, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, group_id, group_size, keep) for each document of a group of two or more.

    group_id is the least doc_id of the group, which is the one to keep.
    """
    sigs = cut(signatures(docs, id_col, text_col).groupBy("doc_id").agg(F.min(F.struct("s1", "s2")).alias("s")).select("doc_id", "s.s1", "s.s2"))
    points = cut(sigs.groupBy("s1", "s2").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")).select("id", "s1", "s2", "n"))
    parts = plan(points, tau)
    # Signatures are distinct, so they travel without ids, which the few edges get afterwards.
    named = [points.select(F.col("s1").alias(f"{x}1"), F.col("s2").alias(f"{x}2"), F.col("id").alias(x)) for x in "ab"]
    edges = _met(points, parts, tau, tau_all, cell_rows).join(named[0], ["a1", "a2"]).join(named[1], ["b1", "b2"]).select("a", "b")
    roots = components(edges)
    placed = cut(points.join(roots, "id", "left").select("id", "s1", "s2", F.col("n").alias("copies"), F.coalesce("root", "id").alias("group_id")))
    sizes = placed.groupBy("group_id").agg(F.sum("copies").alias("group_size"), F.count(F.lit(1)).alias("n")).where("group_size > 1")
    grouped = hot_join(placed, sizes, ["group_id"], "id").select("s1", "s2", "group_id", "group_size", F.col("copies").alias("n"))
    return hot_join(sigs, grouped, ["s1", "s2"], "doc_id").select("doc_id", "group_id", "group_size", F.expr("doc_id = group_id").alias("keep"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """docs without the documents that a group's kept one stands for; rows with a null doc_id stay, and all columns."""
    return without(docs, groups(docs, id_col=id_col, text_col=text_col, **how).where("not keep"), id_col)
