"""Uniform shuffle into shards of exact sizes, with one exchange.

The n rows lie in P partitions. How many rows each partition sends to each of
the K shards is a multivariate hypergeometric matrix with the partitions' sizes
as row sums and the shards' sizes as column sums; given the matrix, a random
permutation within each partition, and another within each shard after the
exchange, every order of all rows is equally likely. The matrix is never built:
the partitions are halved again and again, and each node of that tree draws
what its left half sends from what the whole sends, with a generator seeded by
(seed, node). A task walks from the root to its own partition, and all tasks agree.

What is exchanged are units of whole shards that follow one another: a uniform
permutation of a unit is cut into its shards. There are about as many units as
partitions, but no more than ``UNITS_MOST``, and of about ``UNIT_ROWS`` rows unless
that would be more than ``UNITS_MOST`` units; so a walk costs at most
``UNITS_MOST`` log P draws however large the table and however many its shards,
and only units that still get something are drawn for.

Only the row's running number goes to Python; the columns stay in the JVM.
Result: all columns, with ``shard`` and ``position`` (0, 1, ... in each shard;
shards differ in size by at most one).

Defined cases: nulls, empty texts, ties and repeated rows: rows like any other.
Columns called ``shard`` or ``position`` in the input are replaced; helper
columns have names that no column of the table begins with. Empty table: empty result.
More shards than rows: the last shards are empty. The order depends on the
seed and on how the table lies in its files, not on when tasks run or rerun.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a shard, unless the number of shards is given: shards don't grow with the table.
SHARD_ROWS, SEED = 8_192, 11
UNIT_ROWS, UNITS_MOST = 131_072, 65_536
_EXACT = 1_000_000_000  # numpy's own generator draws below this many rows


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Number of good ones among ``sample`` drawn of good + bad without replacement.

    Beyond numpy's range: rejection from a table-mountain hat over the density's
    mode, by logarithms of factorials.
    """
    if good + bad < _EXACT:
        return int(rng.hypergeometric(good, bad, sample))
    lo, hi = max(0, sample - bad), min(good, sample)
    if lo == hi:
        return lo
    n = good + bad
    mode = min(hi, max(lo, (sample + 1) * (good + 1) // (n + 2)))

    def log_p(k: int) -> float:
        return -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(sample - k + 1) + math.lgamma(bad - sample + k + 1))

    sd = math.sqrt(sample * (good / n) * (bad / n) * ((n - sample) / (n - 1)) + 0.5)
    a, b, peak = sample * good / n + 0.5, 2 * math.sqrt(2 / math.e) * sd + 3 - 2 * math.sqrt(3 / math.e), log_p(mode)
    while True:
        u, v = rng.random(), rng.random()
        if u == 0:
            continue
        x = a + b * (v - 0.5) / u
        if x < lo or x >= hi + 1:
            continue
        k = math.floor(x)
        if 2 * math.log(u) <= log_p(k) - peak:
            return k


def multivariate(rng: np.random.Generator, colors: np.ndarray, sample: int) -> np.ndarray:
    """How many of each color are among ``sample`` drawn without replacement.

    Colors are halved until numpy's generator can draw all of a part at once.
    """
    total = int(colors.sum())
    if total < _EXACT:
        return rng.multivariate_hypergeometric(colors, sample, method="marginals")
    if len(colors) == 1:
        return np.array([sample], dtype=np.int64)
    mid = len(colors) // 2
    left = int(colors[:mid].sum())
    first = hypergeometric(rng, left, total - left, sample)
    return np.concatenate([multivariate(rng, colors[:mid], first), multivariate(rng, colors[mid:], sample - first)])


def matrix_row(sizes: np.ndarray, units: np.ndarray, partition: int, seed: int) -> np.ndarray:
    """Row of the communication matrix: rows that ``partition`` sends to each unit.

    Units that nothing of the walk's subtree goes to any more are left behind.
    """
    upto = np.concatenate([[0], np.cumsum(sizes)])
    lo, hi, node = 0, len(sizes), 1
    live = np.flatnonzero(units)
    left = units[live]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        first = multivariate(np.random.default_rng([seed, node]), left, int(upto[mid] - upto[lo]))
        if partition < mid:
            hi, left, node = mid, first, 2 * node
        else:
            lo, left, node = mid, left - first, 2 * node + 1
        on = np.flatnonzero(left)
        live, left = live[on], left[on]
    out = np.zeros(len(units), dtype=np.int64)
    out[live] = left
    return out


def plan_units(n: int, partitions: int, shards: int) -> tuple[int, np.ndarray]:
    """(shards in a unit, rows of each unit): about as many units as partitions, within the bounds of the module."""
    most = min(shards, UNITS_MOST, max(partitions, -(-n // UNIT_ROWS), 1))
    per = -(-shards // most)
    edge = np.minimum(np.arange(0, -(-shards // per) + 1, dtype=np.int64) * per, shards)
    return per, np.diff(edge * (n // shards) + np.minimum(edge, n % shards))


def shuffle(df: DataFrame, shards: int | None = None, seed: int = SEED, shard_rows: int = SHARD_ROWS) -> DataFrame:
    names = [c for c in df.columns if c.lower() not in ("shard", "position")]
    made = "__corvane"
    while any(c.lower().startswith(made) for c in names):
        made += "_"
    at, to, nth = f"{made}at", f"{made}to", f"{made}nth"
    df = df.select(*[F.col(f"`{c}`") for c in names])
    numbered = df.withColumn(at, F.monotonically_increasing_id())
    # One number per partition: the only thing that comes to the driver.
    counted = numbered.groupBy(F.shiftright(at, 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = np.zeros(max((r.p for r in counted), default=-1) + 1, dtype=np.int64)
    for r in counted:
        sizes[r.p] = r.n
    n = int(sizes.sum())
    shards = max(1, -(-n // shard_rows)) if shards is None else shards
    per, units = plan_units(n, len(sizes), shards)

    @F.pandas_udf("struct<unit:int,key:long>")
    def assign(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for at in columns:
            p, i = (at.to_numpy() >> 33), (at.to_numpy() & ((1 << 33) - 1))
            unit, key = np.zeros(len(at), dtype=np.int32), np.zeros(len(at), dtype=np.int64)
            for q in np.unique(p).tolist():
                if q >= len(sizes) or i[p == q].max() >= sizes[q]:
                    raise RuntimeError("the table's partitions changed between two reads; write it to files first")
                if q not in known:
                    rng = np.random.default_rng([seed, 0, q])
                    goes = np.repeat(np.arange(len(units), dtype=np.int32), matrix_row(sizes, units, q, seed))
                    known[q] = rng.permutation(goes), rng.integers(-(2**63), 2**63 - 1, len(goes))
                unit[p == q], key[p == q] = known[q][0][i[p == q]], known[q][1][i[p == q]]
            yield pd.DataFrame({"unit": unit, "key": key})

    within = W.partitionBy(f"{to}.unit").orderBy(f"{to}.key", at)
    size, more = n // shards, n % shards
    # Place among all rows; the first ``more`` shards have a row more than the others.
    edge = F.col(f"{to}.unit").cast("long") * per
    place = edge * size + F.least(edge, F.lit(more)) + F.row_number().over(within) - 1
    long_ = F.col(nth) < more * (size + 1)
    rest = F.col(nth) - F.lit(more * (size + 1))
    shard = F.when(long_, F.floor(F.col(nth) / F.lit(size + 1))).otherwise(more + F.floor(rest / F.lit(max(size, 1))))
    position = F.when(long_, F.col(nth) % F.lit(size + 1)).otherwise(rest % F.lit(max(size, 1)))
    return numbered.withColumn(to, assign(at)).withColumn(nth, place).select(*[F.col(f"`{c}`") for c in names], shard.cast("int").alias("shard"), position.cast("long").alias("position"))
