"""Quality by attention over passages: multiple-instance learning from document labels.

A document is a bag of passages of ``PASSAGE`` words, over its whole text. Each
passage x (shares of kinds of bytes, repetition, and the shares of its words in
``BUCKETS`` hashed buckets) is encoded as h = tanh(A x + a). Gated attention
weighs the passages: softmax of u.(tanh(V h) * sigmoid(U h)). The weighted mean
of the h gives the score sigmoid(c.z + c0). All parameters are learned together
from the labels of documents, by Adam on whole bags, with a fixed seed.

Result: one row per document (doc_id, score, keep, passages, top_passage,
top_weight); keep is score >= 0.5, top_passage the one of greatest weight (the
first among equals).

Defined cases: null doc_id: row ignored; ids of any type. Null or empty text, or text without
words: score 0, keep false, no passages, top columns null. Repeated rows: a row
each. Other columns are ignored. Empty table: empty result. No labels, or of
one kind only: the score is 0.5 or the share of that kind, by the bias alone.
Only fitting is bounded, by ``max_train`` labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkernel as tk
from .cluster import id_type, narrow
from .sampled_labels import labelled

PASSAGE, BUCKETS, HIDDEN, MAX_TRAIN, EPOCHS, SEED = 64, 64, 16, 4_000, 30, 3
_U = np.uint64


def _kinds() -> np.ndarray:
    """A class for each byte: 0 the rest, then what the features count."""
    k = np.zeros(256, dtype=np.uint8)
    k[65:91] = 1
    k[48:58] = 2
    k[[ord(c) for c in ".,;:"]] = 3
    k[[ord(c) for c in "!?"]] = 4
    k[[ord(c) for c in "#$%&*@^~+=<>{}[]\\_"]] = 5
    k[[10, 13]] = 6
    k[ord("|")] = 7
    k[128:] = 8
    k[97:123] = 9
    return k


_KIND, _N_KINDS = _kinds(), 10
WIDTH = (_N_KINDS - 1) + 5 + BUCKETS


def passages(w: tk.Words, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (float32), and ``first`` of each row's."""
    many = -(-w.counts // PASSAGE)
    first = np.concatenate([[0], np.cumsum(many)])
    row = np.repeat(np.arange(len(many)), many)
    nth = np.arange(len(row)) - first[:-1][row]
    lo = w.first[:-1][row] + nth * PASSAGE
    hi = np.minimum(lo + PASSAGE, w.first[1:][row])
    x = np.zeros((len(row), WIDTH), dtype=np.float32)
    if not len(row):
        return x, first
    n = (hi - lo).astype(np.float32)
    # Bytes from a row's start, or the passage's first word, to the next passage, or the row's end.
    b0 = np.where(nth == 0, w.byte0[:-1][row], w.start[lo])
    b1 = np.append(b0[1:], 0)
    last = nth == many[row] - 1
    b1[last] = w.byte0[1:][row[last]]
    kind = _KIND[raw]
    size = np.maximum(b1 - b0, 1)
    for k in range(1, _N_KINDS):
        upto = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int32)])
        x[:, k - 1] = (upto[b1] - upto[b0]) / size
    at = _N_KINDS - 1
    # Repetition: repeats of the word before, and within the passage.
    same = np.zeros(len(w.hash) + 1, dtype=np.int32)
    same[1:] = np.cumsum(np.concatenate([[False], w.hash[1:] == w.hash[:-1]]))
    x[:, at] = (same[hi] - same[lo + 1]) / n
    of = np.repeat(np.arange(len(row)), hi - lo)
    place = np.arange(len(of)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
    grid = np.tile(np.arange(1, PASSAGE + 1, dtype=_U), (len(row), 1))  # pads are distinct
    grid[of, place] = w.hash
    grid.sort(axis=1)
    x[:, at + 1] = (grid[:, 1:] == grid[:, :-1]).sum(1) / n
    x[:, at + 2] = np.add.reduceat(w.end - w.start, lo) / n / 10
    x[:, at + 3] = n / PASSAGE
    x[:, at + 4] = np.minimum(many[row], 64) / 64
    bucket = of * BUCKETS + (w.hash >> _U(58)).astype(np.int64)
    x[:, at + 5 :] = np.bincount(bucket, minlength=len(row) * BUCKETS).reshape(-1, BUCKETS) / n[:, None] * 4
    return x, first


Params = dict[str, np.ndarray]


def start(seed: int = SEED) -> Params:
    rng = np.random.default_rng(seed)
    g = lambda *s: (rng.standard_normal(s) / s[-1] ** 0.5).astype(np.float32)
    zero = lambda *s: np.zeros(s, dtype=np.float32)
    return {"A": g(HIDDEN, WIDTH), "a": zero(HIDDEN), "V": g(HIDDEN, HIDDEN), "U": g(HIDDEN, HIDDEN), "u": g(HIDDEN), "c": g(HIDDEN), "c0": zero(1), "mean": zero(WIDTH), "sd": np.ones(WIDTH, dtype=np.float32)}


def _sig(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def forward(p: Params, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """Every bag must have a passage."""
    n = np.diff(first)
    xs = (x - p["mean"]) / p["sd"]
    h = np.tanh(xs @ p["A"].T + p["a"])
    v, u = np.tanh(h @ p["V"].T), _sig(h @ p["U"].T)
    e = (v * u) @ p["u"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), n))
    w = e / np.repeat(np.add.reduceat(e, first[:-1]), n)
    z = np.add.reduceat(h * w[:, None], first[:-1])
    return {"xs": xs, "h": h, "v": v, "u": u, "w": w, "z": z, "score": _sig(z @ p["c"] + p["c0"])}


def gradient(p: Params, f: dict[str, np.ndarray], first: np.ndarray, y: np.ndarray) -> Params:
    n = np.diff(first)
    d = ((f["score"] - y) / len(y)).astype(np.float32)
    dz = np.repeat(d[:, None] * p["c"], n, axis=0)
    dw = (dz * f["h"]).sum(1)
    mean = np.repeat(np.add.reduceat(dw * f["w"], first[:-1]), n)
    de = f["w"] * (dw - mean)
    gate = de[:, None] * p["u"]
    dv, du = gate * f["u"] * (1 - f["v"] ** 2), gate * f["v"] * f["u"] * (1 - f["u"])
    dh = (dz * f["w"][:, None] + dv @ p["V"] + du @ p["U"]) * (1 - f["h"] ** 2)
    return {"c": f["z"].T @ d, "c0": d.sum(keepdims=True), "u": (f["v"] * f["u"]).T @ de, "V": dv.T @ f["h"], "U": du.T @ f["h"], "A": dh.T @ f["xs"], "a": dh.sum(0)}


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Params:
    p = start(seed)
    if not len(y) or len(np.unique(y)) < 2:
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        p["c"][:] = 0
        p["c0"][:] = np.log(share / (1 - share))
        return p
    p["mean"], p["sd"] = x.mean(0), np.maximum(x.std(0), 1e-3)
    rng, t = np.random.default_rng(seed), 0
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), 64):
            bags = order[i : i + 64]
            n = first[bags + 1] - first[bags]
            f0 = np.concatenate([[0], np.cumsum(n)])
            rows = np.repeat(first[bags] - f0[:-1], n) + np.arange(f0[-1])
            g = gradient(p, forward(p, x[rows], f0), f0, y[bags])
            t += 1
            for k, v in g.items():
                v = v + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.999 * s[k] + 0.001 * v * v
                p[k] = (p[k] - 0.005 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return p


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tk.slices(batch, "text"):
            w = tk.words(part.column(1))
            x, first = passages(w, tk.raw_bytes(part.column(1))[0])
            blobs = [x[i:j].tobytes() for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(blobs, type=pa.binary())], ["doc_id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN, epochs: int = EPOCHS, id_col: str = "doc_id", text_col: str = "text") -> Params:
    got = labelled(docs, labels, label, max_train, id_col, text_col).select("doc_id", "text", "y").mapInArrow(_bags, f"doc_id {id_type(docs, id_col)}, y double, x binary").toArrow().combine_chunks().sort_by("doc_id")
    blobs, y = got.column("x").to_pylist(), got.column("y").to_numpy()
    full = np.array([len(b) > 0 for b in blobs], dtype=bool)
    x = np.frombuffer(b"".join(blobs), dtype=np.float32).reshape(-1, WIDTH)
    sizes = np.array([len(b) // (4 * WIDTH) for b in blobs], dtype=np.int64)[full]
    return fit(x, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), y[full], epochs)


SCHEMA = "score double, keep boolean, passages int, top_passage int, top_weight double"


def score(docs: DataFrame, p: Params, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, text_col):
                w = tk.words(part.column(1))
                x, first = passages(w, tk.raw_bytes(part.column(1))[0])
                n = np.diff(first)
                full = np.flatnonzero(n)
                out, top, weight = np.zeros(len(n)), np.zeros(len(n), dtype=np.int32), np.zeros(len(n))
                if len(full):
                    f0 = np.append(first[:-1][full], first[-1])
                    f = forward(p, x, f0)
                    out[full] = f["score"]
                    best = np.repeat(np.maximum.reduceat(f["w"], f0[:-1]), n[full])
                    place = np.where(f["w"] == best, np.arange(len(best)), len(best))
                    top[full] = np.minimum.reduceat(place, f0[:-1]) - f0[:-1]
                    weight[full] = np.maximum.reduceat(f["w"], f0[:-1])
                empty = n == 0
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(out), pa.array(out >= 0.5), pa.array(n.astype(np.int32)), pa.array(top, mask=empty), pa.array(weight, mask=empty)],
                    ["doc_id", "score", "keep", "passages", "top_passage", "top_weight"],
                )

    return narrow(docs, id_col, text_col).mapInArrow(make, f"doc_id {id_type(docs, id_col)}, {SCHEMA}")
