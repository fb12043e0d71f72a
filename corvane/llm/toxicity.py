"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are words and their stems (first ``STEM`` bytes), hashed to 2**22
places, with the value log(1 + count). One
vector of weights w serves all grades: P(grade >= k) = sigmoid(w.x - cut_k), with
rising cuts. It is fitted by accelerated proximal gradient steps on the mean
log-likelihood with an L1 penalty of ``L1`` * sqrt(log(features) / rows), so
nearly all weights are zero and ordinary words of long texts add nothing. What
has a weight is fitted again with the much smaller penalty ``RELAXED``, since
the first one shrinks sure signs too. Where labels are only 0 and 1, ``grade_labels``
makes severity grades of them: a binary fit comes first, and the toxic documents
are split where the summed count of its positively weighted words passes the
thirds of that sum among them.

Result: one row per document (doc_id, expected_severity, grade, p_toxic,
toxic): sum over k of P(grade >= k), the likeliest grade, P(grade >= 1), and
whether that reaches the limit at which F1 is best on the labelled rows, each
judged by a model fitted on the other half of them.

Defined cases: null doc_id: row ignored; ids of any type. Null or empty text, or text without
words: scored by the cuts alone. Repeated rows: a row each. Other columns are
ignored. Empty table of documents: empty result. No labels, or of one kind
only: all weights zero and nothing toxic. Only fitting is bounded, by
``max_train`` labelled rows; every document is scored over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .cluster import id_type, narrow
from .sampled_labels import labelled

BITS, STEM, MAX_TRAIN, L1, STEPS, GRADES = 22, 6, 4_000, 0.04, 600, 3
RELAXED, SELECT_STEPS = 0.0003, 150
_U = np.uint64


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass
class OrdinalModel:
    places: np.ndarray  # sorted feature places with a weight
    weights: np.ndarray
    cuts: np.ndarray  # rising
    limit: float = 0.5  # P(grade >= 1) from which a document is toxic

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., one row per score."""
        return _sigmoid(score[:, None] - self.cuts[None, :])


def features(w: tk.Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(place, place of the stem) of every word; a stem is a word's first ``STEM`` bytes."""
    lanes = np.ndarray((len(w.data) - 7,), dtype="<u8", buffer=w.data, strides=(1,))
    stem = tk.mix((lanes[w.start] & tk._KEEP[np.minimum(w.end - w.start, STEM)]) + tk._M2)
    return (w.hash >> _U(64 - bits)).astype(np.int64), (stem >> _U(64 - bits)).astype(np.int64)


def word_counts(w: tk.Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, count) of the distinct words and stems of each row."""
    row = w.row_of().astype(_U) << _U(bits)
    key, n = np.unique(np.concatenate([row | x.astype(_U) for x in features(w, bits)]), return_counts=True)
    return (key >> _U(bits)).astype(np.int64), (key & _U((1 << bits) - 1)).astype(np.int64), n


def fit(row: np.ndarray, place: np.ndarray, value: np.ndarray, grade: np.ndarray, l1: float = L1, steps: int = STEPS, relaxed: float | None = RELAXED) -> OrdinalModel:
    """Weights shared by all grades, and one cut for each grade above the least that occurs.

    relaxed: the penalty of the second fit, of what the first one chose; None leaves it out.
    """
    if relaxed is not None:
        chosen = np.isin(place, fit(row, place, value, grade, l1, SELECT_STEPS, None).places)
        return fit(row[chosen], place[chosen], value[chosen], grade, relaxed, steps, None)
    top = int(grade.max(initial=0))
    none = np.zeros(0, dtype=np.int64)
    if top < 1 or len(np.unique(grade)) < 2:
        return OrdinalModel(none, np.zeros(0), np.full(max(top, 1), 1e3))
    # Words of a single document can't be told from chance.
    seen, col = np.unique(place, return_inverse=True)
    often = np.bincount(col) > 1
    keep = often[col]
    row, value, col = row[keep], value[keep], (np.cumsum(often) - 1)[col[keep]]
    seen = seen[often]
    n, f = len(grade), len(seen)
    at_least = (grade[:, None] >= np.arange(1, top + 1)[None, :]).astype(float)
    share = np.clip(at_least.mean(0), 1e-4, 1 - 1e-4)
    cuts = -np.log(share / (1 - share))
    penalty = l1 * (np.log(max(f, 2)) / n) ** 0.5
    w, old = np.zeros(f), np.zeros(f)
    rate = 4.0 / max(1e-9, _norm(row, col, value, n, f) / n * top)
    for step in range(steps):
        v = w + (step / (step + 3)) * (w - old)
        s = np.bincount(row, v[col] * value, minlength=n)
        # The mean of the binary log-losses of the cuts: convex in weights and cuts.
        off = _sigmoid(s[:, None] - cuts[None, :]) - at_least
        g = np.bincount(col, off.sum(1)[row] * value, minlength=f) / n
        old, w = w, v - rate * g
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
        curve = np.maximum((_sigmoid(s[:, None] - cuts) * (1 - _sigmoid(s[:, None] - cuts))).mean(0), 1e-3)
        cuts = np.maximum.accumulate(cuts + 0.5 * off.mean(0) / curve)
    used = w != 0
    return OrdinalModel(seen[used], w[used], cuts)


def _norm(row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int, f: int) -> float:
    """Largest eigenvalue of X'X, by power steps."""
    v = np.ones(f) / max(f, 1) ** 0.5
    size = 1.0
    for _ in range(20):
        u = np.bincount(col, np.bincount(row, v[col] * value, minlength=n)[row] * value, minlength=f)
        size = float(np.linalg.norm(u)) or 1.0
        v = u / size
    return size


def grade_labels(row: np.ndarray, place: np.ndarray, count: np.ndarray, toxic: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """Grades 0..grades from labels 0 and 1; see the module."""
    first = fit(row, place, np.log1p(count), toxic.astype(np.int64))
    marks = first.places[first.weights > 0]
    weight = np.bincount(row, np.isin(place, marks) * count, minlength=len(toxic))
    bad = toxic > 0
    if not bad.any() or not len(marks):
        return toxic.astype(np.int64)
    edges = np.unique(np.quantile(weight[bad], np.arange(1, grades) / grades))
    return np.where(bad, 1 + np.searchsorted(edges, weight, side="left"), 0)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tk.slices(batch, "text"):
            row, place, n = word_counts(tk.words(part.column(1)))
            first = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(first, pa.array(x.astype(np.int32))) for x in (place, n)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *lists], ["doc_id", "y", "place", "n"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_train: int = MAX_TRAIN, graded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """graded: the labels are grades already."""
    got = labelled(docs, labels, label, max_train, id_col, text_col).select("doc_id", "text", "y").mapInArrow(_features, f"doc_id {id_type(docs, id_col)}, y double, place array<int>, n array<int>").toArrow().combine_chunks().sort_by("doc_id")
    lists = got.column("place").combine_chunks()
    y = got.column("y").to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(y)), lists.value_lengths().to_numpy(zero_copy_only=False)) if len(y) else np.zeros(0, dtype=np.int64)
    place, n = (got.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("place", "n"))
    del got, lists
    grade = y if graded else grade_labels(row, place, n, y)
    value = np.log1p(n)
    del n
    p = held_out(row, place, value, grade)
    model = fit(row, place, value, grade)
    return OrdinalModel(model.places, model.weights, model.cuts, best_limit(p, y > 0) if len(y) else 0.5)


def held_out(row: np.ndarray, place: np.ndarray, value: np.ndarray, grade: np.ndarray) -> np.ndarray:
    """P(grade >= 1) of each row by the model fitted on the other half of the rows."""
    out, half = np.zeros(len(grade)), np.arange(len(grade)) % 2
    for k in (0, 1):
        mine, nth = half == k, np.cumsum(half == k) - 1
        own = mine[row]
        model = fit(nth[row[own]], place[own], value[own], grade[mine])
        at = np.flatnonzero(~own & np.isin(place, model.places))
        raw = np.bincount(row[at], value[at] * model.weights[np.searchsorted(model.places, place[at])], minlength=len(grade)) if len(at) else np.zeros(len(grade))
        out[~mine] = model.above(raw)[~mine, 0]
    return out


def best_limit(p: np.ndarray, toxic: np.ndarray) -> float:
    """Middle of the gap in p that gives the best F1, the widest such gap; 0.5 where there is nothing to tell apart."""
    if not toxic.any() or toxic.all():
        return 0.5
    order = np.argsort(-p, kind="stable")
    q, hits = p[order], np.cumsum(toxic[order])
    gap = np.append(q[:-1] - q[1:], 0)
    f1 = np.where(gap > 0, 2 * hits / (np.arange(1, len(q) + 1) + toxic.sum()), 0)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = best[np.argmax(gap[best])]
    return float((q[k] + q[k + 1]) / 2) if gap[k] > 0 else 0.5


def score_rows(w: tk.Words, model: OrdinalModel, bits: int = BITS) -> np.ndarray:
    """w.x of each row; only words that have a weight are counted."""
    out = np.zeros(len(w.first) - 1)
    if not len(model.places):
        return out
    table = np.zeros(1 << bits, dtype=bool)
    table[model.places] = True
    keys = []
    for place in features(w, bits):
        at = np.flatnonzero(table[place])
        row = np.searchsorted(w.first, at, side="right") - 1
        keys.append(row * len(model.places) + np.searchsorted(model.places, place[at]))
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    return np.bincount(key // len(model.places), np.log1p(n) * model.weights[key % len(model.places)], minlength=len(out))


SCHEMA = "expected_severity double, grade int, p_toxic double, toxic boolean"


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, text_col):
                p = model.above(score_rows(tk.words(part.column(1)), model))
                each = np.diff(np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], axis=1), axis=1)
                cols = [part.column(0), pa.array(p.sum(1)), pa.array(np.argmin(each, axis=1).astype(np.int32)), pa.array(p[:, 0].copy()), pa.array(p[:, 0] >= model.limit)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "expected_severity", "grade", "p_toxic", "toxic"])

    return narrow(docs, id_col, text_col).mapInArrow(make, f"doc_id {id_type(docs, id_col)}, {SCHEMA}")


def reject_by(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs that aren't toxic, with all columns; rows with a null id are judged like any other.

    The verdict is computed beside the row: there is no shuffle.
    """

    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        col = pa.array(text, type=pa.large_string(), from_pandas=True)
        out = []
        for part in tk.slices(pa.RecordBatch.from_arrays([col], ["text"]), "text"):
            out.append(model.above(score_rows(tk.words(part.column(0)), model))[:, 0] < model.limit)
        return pd.Series(np.concatenate(out) if out else np.zeros(0, dtype=bool))

    return docs.where(clean(F.col(text_col)))
