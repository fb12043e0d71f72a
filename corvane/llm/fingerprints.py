"""MinHash fingerprints of documents, and the near copies they find.

A fingerprint holds ``bands * rows`` minima, each of one universal hash
(a * x + b mod 2**64, high half) over all shingles of ``size`` words. Documents
of the same words form a class, named by its least doc_id, which stands for it
in what follows. Classes whose signatures agree in a band meet in a bucket, and
every two that meet are compared by the exact Jaccard similarity of their sets
of shingles: a link is a pair at ``least`` or above. With 20 bands of 5 rows a
pair at similarity 0.7 meets with probability 0.975, and more above.

Where they are compared: classes that buckets connect go to one cell, each with
its set once. What is too much for a cell (``CELL_ROWS``, ``CELL_SHINGLES``) goes to
its buckets instead, large buckets in blocks, every two of which are a cell; a
pair that shares several buckets counts in the first. So no task holds more
than two blocks, and no pair leaves its cell: a cell gives one row per class,
with its number of links and one member of its group.

Result: one row per document: doc_id, class_id, group_id (least doc_id of the
classes that links connect), n_links (number of other classes linked to its
own), n_shingles, and ``fingerprint`` (the minima, 4 bytes each, little-endian).
``links`` gives the linked pairs of classes themselves.

Defined cases: null doc_id: row ignored. doc_id of any type with an order, as text. Null
or empty text, or text without words: null fingerprint, a class of its own,
no links. Fewer than ``size`` words: one shingle of all. Repeated rows of one
doc_id: one result row, and of differing texts that of the least hash counts.
Other columns are ignored, whatever their names. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .cluster import components, cut, few, hot_join, id_type, narrow
from .simhash import distinct_rows

BANDS, ROWS, SIZE, JACCARD, SEED = 20, 5, 3, 0.7, 1
CELL_ROWS, CELL_SHINGLES = 2_000, 2_000_000
_U = np.uint64


def permutations(many: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, many, dtype=_U) * _U(2) + _U(1), rng.integers(0, 2**64, many, dtype=_U)


def minhash(values: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Signatures of the rows that have values, shape (rows, permutations), uint32."""
    heads = first[:-1][np.diff(first) > 0]
    out = np.empty((len(heads), len(a)), dtype=np.uint32)
    if not len(heads):
        return out
    x = np.empty_like(values)
    for k in range(len(a)):
        np.multiply(values, a[k], out=x)
        x += b[k]
        out[:, k] = np.minimum.reduceat(x, heads) >> _U(32)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit keys of the buckets of each signature, shape (signatures, bands)."""
    sig = sig.reshape(-1, bands, rows).astype(_U)
    h = np.broadcast_to(np.arange(bands, dtype=_U), sig.shape[:2]).copy()
    for k in range(rows):
        h = tk.mix(h * tk._M3 + sig[:, :, k])
    return h


def _sign(bands: int, rows: int, size: int, seed: int):
    a, b = permutations(bands * rows, seed)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                w = tk.words(part.column(1))
                g, first = tk.shingles(w, size)
                full = w.counts > 0
                sig = minhash(g, first, a, b)
                row = np.full(part.num_rows, -1)
                row[full] = np.arange(len(sig))
                k1, k2 = tk.sequence_keys(w)
                blobs = [sig[r].tobytes() if r >= 0 else None for r in row.tolist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(k1), pa.array(k2), pa.array(np.diff(first)), pa.array(blobs, type=pa.binary())], ["doc_id", "k1", "k2", "n_shingles", "fingerprint"])

    return make


def _buckets(bands: int, rows: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h = band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32), bands, rows)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(h)), bands)))
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(h))), ids], ["bucket", "band", "doc_id"])

    return make


def _sets(bands: int, rows: int, size: int, seed: int):
    a, b = permutations(bands * rows, seed)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                w = tk.words(part.column(1))
                k1, k2 = tk.sequence_keys(w)
                v, first = distinct_rows(*tk.shingles(w, size))
                full = np.flatnonzero(np.diff(first))
                keys = band_keys(minhash(v, first, a, b), bands, rows)
                blobs = [v[first[i] : first[i + 1]].tobytes() for i in full.tolist()]
                ids = part.column(0).take(pa.array(full))
                yield pa.RecordBatch.from_arrays([ids, pa.array(k1[full]), pa.array(k2[full]), pa.array([k.tobytes() for k in keys], type=pa.binary()), pa.array(blobs, type=pa.binary())], ["doc_id", "k1", "k2", "keys", "grams"])

    return make


def compare_cell(keys: np.ndarray, values: np.ndarray, first: np.ndarray, side: np.ndarray, band: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, jaccard) of the linked pairs of a cell, i before j.

    band: -1 for any two that share a bucket, else for those whose first shared
    bucket is of that band. Where side has two values, i is of the lesser one
    and j of the other.
    """
    n = len(keys)
    two = bool((side != side[0]).any())
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    _, code = np.unique(values, return_inverse=True)
    sizes = np.diff(first)
    mark = np.zeros(int(code.max(initial=0)) + 1, dtype=bool)
    step = max(1, 8_000_000 // (n * keys.shape[1]))
    for lo in range(0, n, step):
        same = keys[lo : lo + step, None, :] == keys[None, :, :]
        meet = same.any(2) if band < 0 else same[:, :, band] & ~same[:, :, :band].any(2)
        meet &= (side[lo : lo + step, None] < side[None, :]) if two else (np.arange(lo, min(lo + step, n))[:, None] < np.arange(n)[None, :])
        for r in np.flatnonzero(meet.any(1)).tolist():
            j = np.flatnonzero(meet[r])
            i = lo + r
            mark[code[first[i] : first[i + 1]]] = True
            upto = np.cumsum(sizes[j])
            at = np.repeat(first[j] - (upto - sizes[j]), sizes[j]) + np.arange(upto[-1])
            both = np.add.reduceat(mark[code[at]], upto - sizes[j], dtype=np.int64)
            mark[code[first[i] : first[i + 1]]] = False
            score = both / (sizes[i] + sizes[j] - both)
            ok = score >= least
            if ok.any():
                out.append((np.full(int(ok.sum()), i), j[ok], score[ok]))
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least member of each one's component."""
    lab = np.arange(n)
    while True:
        low = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, lab[i], low)
        np.minimum.at(new, lab[j], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def _compare(least: float, pairs: bool):
    """Cells arrive sorted; one is complete when the next begins."""

    def settle(rows: pa.Table) -> pa.RecordBatch | None:
        if rows.num_rows < 2:
            return None
        ids = rows.column("doc_id").combine_chunks()
        grams = rows.column("grams").to_pylist()
        first = np.concatenate([[0], np.cumsum([len(g) // 8 for g in grams])])
        keys = np.frombuffer(b"".join(rows.column("keys").to_pylist()), dtype=_U).reshape(len(grams), -1)
        i, j, score = compare_cell(keys, np.frombuffer(b"".join(grams), dtype=_U), first, rows.column("side").to_numpy(), rows.column("band")[0].as_py(), least)
        if not len(i):
            return None
        if pairs:
            return pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(score)], ["a", "b", "jaccard"])
        n = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
        on = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(on)), ids.take(pa.array(_labels(len(ids), i, j)[on])), pa.array(n[on])], ["a", "b", "n"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("cell", "band", "ci", "cj")], 1)
            turns = [0, *(np.flatnonzero((cell[1:] != cell[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(turns[:-1], turns[1:], strict=True):
                now = tuple(cell[lo].tolist())
                if now != last and left:
                    out = settle(pa.Table.from_batches(left))
                    if out is not None:
                        yield out
                    left = []
                left.append(batch.slice(lo, hi - lo))
                last = now
        if left:
            out = settle(pa.Table.from_batches(left))
            if out is not None:
                yield out

    return make


def _members(buckets: DataFrame, sized: DataFrame, cell_rows: int, cell_shingles: int) -> DataFrame:
    """(doc_id, k1, k2, cell, band, ci, cj, side): the cells that each class goes to. buckets has those of two or more only."""
    low = buckets.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    star = hot_join(buckets.select("bucket", "doc_id"), low, ["bucket"], "doc_id").where("low <> doc_id")
    root = components(star, "doc_id", "low")
    sized = cut(sized.join(root.withColumnRenamed("id", "doc_id"), "doc_id"))
    blocks = F.greatest(F.ceil(F.sum(F.lit(1)) / F.lit(cell_rows)), F.ceil(F.sum("n_shingles") / F.lit(cell_shingles))).cast("int").alias("blocks")
    connected = sized.groupBy("root").agg(F.count(F.lit(1)).alias("n"), blocks)
    each = cut(hot_join(sized, connected, ["root"], "doc_id"))
    one = each.where("blocks = 1").select("doc_id", "k1", "k2", F.xxhash64("root").alias("cell"), F.lit(-1).alias("band"), F.lit(0).alias("ci"), F.lit(0).alias("cj"), F.lit(0).alias("side"))
    spread = buckets.join(each.where("blocks > 1").drop("blocks", "root"), "doc_id")
    large = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), blocks)
    spread = hot_join(spread, large, ["bucket"], "doc_id").withColumn("block", F.pmod(F.xxhash64(F.lit(1), "doc_id"), "blocks").cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = spread.select("doc_id", "k1", "k2", F.col("bucket").alias("cell"), "band", F.least("block", "other").alias("ci"), F.greatest("block", "other").alias("cj"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    return one.unionByName(many)


def _classes(signed: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, n_shingles, class_id) for each document with words."""
    keys = cut(signed.where("fingerprint is not null").groupBy("doc_id").agg(F.min(F.struct("k1", "k2", "n_shingles")).alias("x")).select("doc_id", "x.*"))
    least = keys.groupBy("k1", "k2").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    return cut(hot_join(keys, least, ["k1", "k2"], "doc_id"))


def _linked(docs: DataFrame, signed: DataFrame, classes: DataFrame, bands: int, rows: int, size: int, least: float, seed: int, cell_rows: int, cell_shingles: int, pairs: bool) -> DataFrame:
    kind = id_type(docs)
    mine = classes.where("doc_id = class_id").select("doc_id", "k1", "k2", "n_shingles")
    # All rows of ``signed`` that don't stand for a class: copies, and further texts of one doc_id.
    rest = signed.where("fingerprint is not null").select("doc_id", "k1", "k2").distinct().join(mine, ["doc_id", "k1", "k2"], "left_anti")
    stand = signed.where("fingerprint is not null").join(few(cut(rest)), ["doc_id", "k1", "k2"], "left_anti")
    # Rows repeat only where a doc_id does, which two counts of small tables tell.
    repeated = signed.where("fingerprint is not null").count() > classes.count()
    stand = stand.dropDuplicates(["doc_id"]) if repeated else stand
    buckets = cut(stand.select("doc_id", "fingerprint").mapInArrow(_buckets(bands, rows), f"bucket long, band int, doc_id {kind}"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(_members(cut(hot_join(buckets, shared, ["bucket"], "doc_id")), mine, cell_rows, cell_shingles))
    sets = docs.join(few(members.select("doc_id").distinct()), "doc_id", "left_semi").mapInArrow(_sets(bands, rows, size, seed), f"doc_id {kind}, k1 long, k2 long, keys binary, grams binary")
    sets = sets.dropDuplicates(["doc_id", "k1", "k2"]) if repeated else sets
    cells = members.join(sets, ["doc_id", "k1", "k2"]).select("cell", "band", "ci", "cj", "side", "doc_id", "keys", "grams")
    at = ["cell", "band", "ci", "cj"]
    schema = f"a {kind}, b {kind}, jaccard double" if pairs else f"a {kind}, b {kind}, n long"
    return cut(cells.repartition(*at).sortWithinPartitions(*at).mapInArrow(_compare(least, pairs), schema))


def fingerprints(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SIZE, least: float = JACCARD, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = CELL_ROWS, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    docs = narrow(docs, id_col, text_col).toDF("doc_id", "text")
    signed = cut(docs.mapInArrow(_sign(bands, rows, size, seed), f"doc_id {id_type(docs)}, k1 long, k2 long, n_shingles long, fingerprint binary"))
    classes = _classes(signed)
    linked = _linked(docs, signed, classes, bands, rows, size, least, seed, cell_rows, cell_shingles, False)
    counts = linked.groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("n_links"))
    found = counts.join(components(linked).withColumnRenamed("id", "class_id"), "class_id")
    sizes = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).join(found, "class_id")
    named = hot_join(classes.select("doc_id", "class_id"), sizes, ["class_id"], "doc_id", "left")
    one = signed.groupBy("doc_id").agg(F.min(F.struct(F.col("fingerprint").isNull(), "k1", "k2", "n_shingles", "fingerprint")).alias("x"))
    own = F.coalesce("class_id", "doc_id")
    return one.join(named, "doc_id", "left").select("doc_id", own.alias("class_id"), F.coalesce("root", own).alias("group_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "x.n_shingles", "x.fingerprint")


def links(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SIZE, least: float = JACCARD, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = CELL_ROWS, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """(a, b, jaccard) of linked classes, a < b: as many rows as there are links."""
    docs = narrow(docs, id_col, text_col).toDF("doc_id", "text")
    signed = cut(docs.mapInArrow(_sign(bands, rows, size, seed), f"doc_id {id_type(docs)}, k1 long, k2 long, n_shingles long, fingerprint binary"))
    found = _linked(docs, signed, _classes(signed), bands, rows, size, least, seed, cell_rows, cell_shingles, True)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard")


def jaccard(a: str | None, b: str | None, size: int = SIZE) -> float:
    """Exact similarity in plain Python, for tests."""

    def grams(t: str | None) -> set[tuple]:
        w = tk.py_words(t)
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x and y else 0.0
