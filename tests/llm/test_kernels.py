import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import decontam, sharding, simhash, suffix_array, suffix_dedup, token_codes
from corvane.llm import textkernel as tk


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1 éÉ×.\n世", max_size=40)), max_size=8))
def test_words_are_those_of_plain_python(texts):
    w = tk.words(pa.array(texts, type=pa.string()))
    for d, t in enumerate(texts):
        got = [bytes(w.data[a:b]).decode() for a, b in zip(w.start[w.first[d] : w.first[d + 1]], w.end[w.first[d] : w.first[d + 1]], strict=True)]
        assert got == tk.py_words(t)
    g, first = tk.shingles(w, 3)
    assert [max(min(len(tk.py_words(t)), 1), len(tk.py_words(t)) - 2) for t in texts] == np.diff(first).tolist()
    seen = {}
    for d, t in enumerate(texts):
        ws = tk.py_words(t)
        for k, h in enumerate(g[first[d] : first[d + 1]].tolist()):
            assert seen.setdefault(tuple(ws[k : k + 3]), h) == h
    assert len(set(seen.values())) == len(seen)


def test_a_slice_holds_at_least_one_row():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 100, "", "c"])], ["t"])
    assert sum(p.num_rows for p in tk.slices(batch, "t", 5)) == 5
    assert list(tk.slices(batch.slice(0, 0), "t")) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=40), st.integers(1, 3))
def test_suffix_array_and_common_prefixes(body, times):
    t = np.array(body * times + [0])
    sa = suffix_array.suffix_array(t)
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    lcp = suffix_array.permuted_lcp(t, sa)
    for a, b in zip(sa, sa[1:], strict=False):
        n = 0
        while t[a + n] == t[b + n]:
            n += 1
        assert lcp[b] == n


def test_winnowing_chooses_alike_in_every_copy():
    rng = random.Random(1)
    passage = " ".join(f"p{rng.randint(0, 99)}" for _ in range(50))
    texts = [" ".join([*(f"q{rng.random()}" for _ in range(rng.randint(0, 30))), passage, *(f"r{rng.random()}" for _ in range(rng.randint(0, 30)))]) for _ in range(20)]
    w = tk.words(pa.array(texts))
    run, lo, hi = suffix_dedup.winnow(w, 50, 30)
    row = np.searchsorted(w.first, lo, side="right") - 1
    assert (hi - lo + 1).sum() == np.maximum(w.counts - 49, 0).sum()
    assert set.intersection(*[set(run[row == d].tolist()) for d in range(20)])


def test_simhash_counts_bits():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (0, 1, 7, 254, 255, 256, 700)]
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    got = simhash.simhash(np.concatenate(rows), first)
    for r, s in zip(rows, got.tolist(), strict=True):
        assert s == sum(1 << k for k in range(64) if 2 * sum(int(x) >> k & 1 for x in r) > len(r))


def test_thresholds_cover_every_pair_within_tau():
    rng = random.Random(2)
    for m in range(2, 11):
        widths = simhash._widths(m)
        ts, _ = simhash.allocate(widths, [np.full(w + 1, 10.0 * rng.random()) for w in widths], 1000, 10)
        if not ts:  # halves would need too many cells
            assert m < 4
            continue
        assert sum(ts) >= 10 - m + 1
        at = np.cumsum([0, *widths])
        for _ in range(200):
            flips = rng.sample(range(64), rng.randint(0, 10))
            assert any(sum(a <= f < b for f in flips) <= t for a, b, t in zip(at, at[1:], ts, strict=False))


def test_codes_round_trip_and_random_access():
    rng = np.random.default_rng(4)
    sizes = [0, 1, 255, 256, 257, 3000]
    ids = np.concatenate([rng.choice([3, 255, 256, 65535, 65536, 2**31], n) for n in sizes]).astype(np.uint32)
    first = np.concatenate([[0], np.cumsum(sizes)])
    for d, codes in enumerate(token_codes.encode(ids, first)):
        want = ids[first[d] : first[d + 1]]
        assert (token_codes.decode(codes) == want).all()
        assert [token_codes.token_at(codes, i) for i in range(len(want))] == want.tolist()
        assert token_codes.token_at(codes, len(want)) is None and token_codes.token_at(codes, -1) is None


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab ' .\n é1<|>", max_size=30), min_size=1, max_size=5))
def test_tokens_are_those_of_the_whole_text(texts):
    ids, first = token_codes.token_ids(pa.array(texts, type=pa.string()))
    enc = token_codes.encoding(token_codes.VOCABULARY)
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == [enc.encode_ordinary(t) for t in texts]


def test_edit_distance_band():
    rng = random.Random(5)
    rows = [([rng.randint(0, 3) for _ in range(9)], [rng.randint(0, 3) for _ in range(9)]) for _ in range(200)]
    got = decontam.edit_distance(np.array([a for a, _ in rows], dtype=np.uint64), np.array([b for _, b in rows], dtype=np.uint64), 4)
    for (a, b), d in zip(rows, got.tolist(), strict=True):
        t = list(range(10))
        for i in range(1, 10):
            last, t[0] = t[0], i
            for j in range(1, 10):
                last, t[j] = t[j], min(t[j] + 1, t[j - 1] + 1, last + (a[i - 1] != b[j - 1]))
        assert d == min(t[9], 5)


def test_matrix_sums_and_moments():
    sizes, shards = np.array([5, 0, 700, 90, 205]), np.array([400, 300, 200, 100])
    rows = np.array([[sharding.matrix_row(sizes, shards, p, s) for p in range(5)] for s in range(300)])
    assert (rows.sum(1) == shards).all() and (rows.sum(2) == sizes).all()
    assert np.abs(rows.mean(0) - np.outer(sizes, shards) / 1000).max() < 2.5
    rng = np.random.default_rng(1)
    big = np.array([sharding.hypergeometric(rng, 2 * 10**9, 3 * 10**9, 1000) for _ in range(3000)])
    assert abs(big.mean() - 400) < 2 and abs(big.var() - 240) < 25
    assert sharding.multivariate(rng, np.array([10**9, 10**9, 0, 5]), 10**9).sum() == 10**9
