import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import cluster, decontam, fingerprints, mixing, quality, sharding, simhash, suffix_dedup, token_codes, toxicity, url_filter
from corvane.llm import textkernel as tk

from .conftest import SCHEMA, edited, prose


def roots(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return {x: find(x) for x in list(up)}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = {r.id: r.root for r in cluster.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots(e for e in edges if e[0] != e[1])
    assert got == want
    assert cluster.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1. Fingerprints


def classes_of(texts):
    """{doc_id: least doc_id of the same words}."""
    least = {}
    for i in sorted(texts):
        least.setdefault(tuple(tk.py_words(texts[i])) or i, i)
    return {i: least[tuple(tk.py_words(t)) or i] for i, t in texts.items()}


def held_against_pairs(df, texts, share, **how):
    """Links and result rows are those of all pairs of classes, but for the share of pairs that no bucket brings together."""
    cls = classes_of(texts)
    grams = {i: (lambda w: {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set())(tk.py_words(texts[i])) for i in set(cls.values())}
    near = {(a, b) for a in grams for b in grams if a < b and grams[a] and grams[b] and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.7}
    rows = fingerprints.links(df, **how).collect()
    found = {(r.a, r.b) for r in rows}
    assert len(found) == len(rows) and found <= near and len(found) >= share * len(near)
    assert all(r.jaccard == pytest.approx(fingerprints.jaccard(texts[r.a], texts[r.b])) for r in rows)
    out = fingerprints.fingerprints(df, **how).collect()
    got = {r.doc_id: r for r in out}
    assert len(got) == len(out) and set(got) == set(texts)
    n, root = Counter(x for pair in found for x in pair), roots(found)
    assert {i: (r.class_id, r.n_links, r.group_id) for i, r in got.items()} == {i: (c, n[c], root.get(c, c)) for i, c in cls.items()}
    return got, near


def test_fingerprints_against_all_pairs(docs, corpus):
    texts = {i: t for i, t, *_ in corpus}
    got, near = held_against_pairs(docs, texts, 0.97)
    assert len(near) > 60 and got[170].fingerprint is None and len(got[0].fingerprint) == 400


@pytest.mark.parametrize("cells", [{}, {"cell_rows": 40, "cell_shingles": 9_000}])
def test_variants_meet_an_original_that_is_not_the_least(spark, cells):
    """Variants are alike to the original only, whose doc_id is the middle one; also where its group is split in blocks."""
    rng = random.Random(5)
    original = [f"o{i}" for i in range(400)]
    rows = [(1150, " ".join(original))]
    for i in [*range(1000, 1150), *range(1151, 1301)]:
        at = set(rng.sample(range(2, 398, 4), 16))
        rows.append((i, " ".join(f"v{i}x{k}" if k in at else w for k, w in enumerate(original))))
    texts = dict(rows)
    got, near = held_against_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), texts, 0.97, **cells)
    assert sum(1150 in pair for pair in near) == 300 and got[1150].n_links >= 295


def test_triples_whatever_the_order_of_ids(spark):
    """Of each three, one is less alike to one of the others than least; no order of ids loses the other pairs."""
    rng = random.Random(7)
    texts = {}
    for k in range(300):
        words = [f"t{k}w{i}" for i in range(200)]
        x = list(words)
        y = [f"y{i}" if i in (30, 60, 90, 120, 150, 180) else w for i, w in enumerate(words)]
        outsider = [f"z{i}" if i in (20, 40, 70, 100, 140, 170, 190) else w for i, w in enumerate(words)]
        ids = [3 * k + j for j in range(3)]
        if k >= 200:
            rng.shuffle(ids)
        texts.update(zip(ids, [" ".join(t) for t in (outsider, x, y)], strict=True))
    held_against_pairs(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), texts, 0.97)


def test_minima_are_of_universal_hashes():
    w = tk.words(pa.array(["a b c d", "", "x"]))
    a, b = fingerprints.permutations(10)
    g, first = tk.shingles(w, 3)
    want = [[min((int(x) * int(p) + int(q)) % 2**64 for x in g[s:e]) >> 32 for p, q in zip(a, b, strict=True)] for s, e in ((0, 2), (2, 3))]
    assert fingerprints.minhash(g, first, a, b).tolist() == want


# 2. Sharding


def test_shards_are_exact(docs, corpus):
    rows = sharding.shuffle(docs, 7).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r[0], r[1]) for r in corpus)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.position)
    n = len(corpus)
    assert [len(by[k]) for k in range(7)] == [n // 7 + (k < n % 7) for k in range(7)]
    assert all(sorted(p) == list(range(len(p))) for p in by.values())
    assert [r.doc_id for r in sharding.shuffle(docs, 7).orderBy("shard", "position").collect()] == [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.position))]
    assert [r.doc_id for r in sharding.shuffle(docs, 7, seed=12).orderBy("shard", "position").collect()] != [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.position))]


def test_every_place_is_equally_likely(spark):
    df = spark.range(0, 12, 1, 3).cache()
    seen = Counter()
    for seed in range(60):
        seen.update((r.id, r.shard) for r in sharding.shuffle(df, 2, seed).collect())
    assert max(abs(seen[i, 0] - 30) for i in range(12)) <= 16


def test_more_shards_than_rows(spark):
    assert {r.shard for r in sharding.shuffle(spark.range(3), 5).collect()} == {0, 1, 2}


# 3. Token codes


def test_codes_of_documents(docs, corpus):
    enc = token_codes.encoding(token_codes.VOCABULARY)
    got = {r.doc_id: r for r in token_codes.encode_documents(docs).collect()}
    for i, t, *_ in corpus:
        if t is None:
            assert got[i].codes is None and got[i].n_tokens is None
        else:
            want = enc.encode_ordinary(t)
            assert token_codes.decode(got[i].codes).tolist() == want and got[i].n_tokens == len(want)
            assert all(token_codes.token_at(got[i].codes, k) == want[k] for k in range(0, len(want), 101))
            assert enc.decode(want) == t


def test_token_column(docs):
    third = token_codes.encode_documents(docs).withColumn("at", F.lit(2)).withColumn("t", token_codes.token_column("codes", "at"))
    got = {r.doc_id: (r.t, r.codes) for r in third.collect()}
    assert got[170][0] is None and got[171][0] is None and got[0][0] == token_codes.decode(got[0][1])[2]


# 4. Mixing


def test_mixture(docs, corpus):
    rows = mixing.mix(docs, weights={"s0": 1, "s1": 1, "s2": 2, "s3": 4, "absent": 9}, block=256, slots=400).collect()
    slots = {r.slot: r.source for r in rows}
    assert sorted(slots) == list(range(400))
    for upto in (50, 100, 400):
        share = Counter(slots[t] for t in range(upto))
        assert all(abs(share[s] - upto * w / 8) <= 3 for s, w in {"s0": 1, "s1": 1, "s2": 2, "s3": 4}.items())
    size = Counter()
    for r in rows:
        size[r.slot] += r.end_word - r.start_word
    short = {r.slot for r in rows if size[r.slot] < 256}
    last = {s: max(r.block for r in rows if r.source == s) for s in ("s0", "s1", "s2")}
    assert all(size[t] <= 256 for t in size) and all(r.block == last.get(r.source, r.block) for r in rows if r.slot in short and r.source != "s3")


def test_mixture_keeps_texts_and_cycles(docs, corpus):
    rows = mixing.mix(docs, weights={"s2": 1}, block=64, slots=120).collect()
    assert {r.source for r in rows} == {"s2"}
    blocks = max(r.block for r in rows) + 1
    order = {r.slot: (r.epoch, r.block) for r in rows}
    assert [order[t][0] for t in range(120)] == [t // blocks for t in range(120)]
    assert [order[t][1] for t in range(blocks)] == list(range(blocks)) and blocks < 100
    later = [order[t][1] for t in range(blocks, 120)]
    assert len(set(later)) == len(later) and later != list(range(len(later)))
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.slot].append((r.place, r.text))
    assert all([p for p, _ in sorted(v)] == list(range(len(v))) for v in pieces.values())
    whole = {}
    assert all(whole.setdefault(order[t][1], [x for _, x in sorted(v)]) == [x for _, x in sorted(v)] for t, v in pieces.items())
    texts = {i: t for i, t, _, s in corpus if s == "s2"}
    for i in {r.doc_id for r in rows}:
        parts = sorted((r.start_word, r.end_word, r.text) for r in rows if r.doc_id == i and r.epoch == 0)
        assert "".join(p[2] for p in parts) == texts[i]
    assert {i for i in texts} == {r.doc_id for r in rows}


def test_mixture_is_the_same_by_narrow_buckets(docs, monkeypatch):
    want = sorted(map(str, mixing.mix(docs, block=128).collect()))
    monkeypatch.setattr(mixing._running, "__defaults__", (10,))
    assert sorted(map(str, mixing.mix(docs, block=128).collect())) == want


# 5. Decontamination


@pytest.fixture(scope="module")
def leaky():
    rng = random.Random(8)
    items = [(i, prose(rng, n)) for i, n in enumerate([4, 5, 9, 10, 17, 24, 30, 41])] + [(90, ""), (91, None), (92, "?!")]
    texts = []
    for i in range(60):
        words = prose(rng, 60).split()
        item = items[i % 8][1].split()
        at = rng.randint(0, 60)
        k = int(len(item) * 0.2) if i % 3 == 0 else i % 2
        for _ in range(min(k, int(len(item) * 0.2))):
            p = rng.randrange(len(item))
            item = {0: item[:p] + ["zz"] + item[p + 1 :], 1: item[:p] + ["yy"] + item[p:], 2: item[:p] + item[p + 1 :]}[rng.randint(0, 2)]
        texts.append((i, " ".join(words[:at] + (item if i % 5 else []) + words[at:])))
    return items, texts


def test_leaks_against_every_window(spark, leaky):
    items, texts = leaky
    got = {(r.doc_id, r.item_id): (r.distance, r.start_word) for r in decontam.leaks(spark.createDataFrame(texts, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = decontam.brute_force(texts, items)
    assert set(got) <= set(want) and len(set(got)) >= 0.95 * len(want) and len(want) > 35
    assert sum(got[k] == want[k] for k in got) >= 0.95 * len(got)


def test_leaks_of_whole_texts_shorter_than_the_item(spark):
    item = [f"i{k}" for k in range(30)]
    texts = [(n, " ".join(w for k, w in enumerate(item) if k not in gone)) for n, gone in ((1, {4}), (3, {2, 11, 29}), (6, {0, 5, 10, 15, 20, 25}), (7, {0, 5, 10, 15, 20, 25, 28}))]
    texts += [(20, " ".join(item[:2] + ["x"] + item[4:])), (21, " ".join(item)), (22, "i1 i2"), (23, " ".join(f"y{k}" for k in range(28)))]
    got = {r.doc_id: (r.distance, r.start_word, r.n_words) for r in decontam.leaks(spark.createDataFrame(texts, "doc_id long, text string").repartition(2), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {1: (1, 0, 29), 3: (3, 0, 27), 6: (6, 0, 24), 20: (2, 0, 29), 21: (0, 0, 30)}
    assert {i: d for (i, _), d in decontam.brute_force(texts, [(1, " ".join(item))]).items()} == {i: (d, s) for i, (d, s, _) in got.items()}


def test_leaks_in_parts(spark, leaky):
    items, texts = leaky
    d, b = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    # One scan for each part of the benchmark; every part draws its own samples.
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(d, b, item_words=40).collect()}
    want = set(decontam.brute_force(texts, items))
    assert got <= want and len(got) >= 0.95 * len(want)


# 6. Toxicity


def _labelled(n, seed):
    rng = random.Random(seed)
    bad, docs, labels = ["vile", "rotten", "scorn"], [], []
    for i in range(n):
        w, y = prose(rng, rng.randint(20, 200)).split(), rng.random() < 0.25
        for _ in range(rng.randint(1, 6) if y else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        docs.append((i, " ".join(w)))
        labels.append((i, int(y)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = _labelled(600, 3)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(d, spark.createDataFrame(labels[:400], "doc_id long, toxic int"))
    assert (np.diff(model.cuts) >= 0).all() and len(model.cuts) == 3
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    truth = dict(labels)
    assert np.mean([got[i].toxic == bool(truth[i]) for i in range(400, 600)]) > 0.95
    mild, harsh = toxicity.score(spark.createDataFrame([(1, "w1 w2 vile"), (2, "w1 vile vile rotten scorn vile rotten scorn scorn")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert harsh.expected_severity > mild.expected_severity and harsh.grade >= mild.grade
    kept = toxicity.reject_by(d, model)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.toxic}


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(0)
    n, f = 1500, 12
    x = rng.integers(0, 3, (n, f)).astype(float)
    latent = x[:, 0] * 2 - x[:, 1] + rng.logistic(size=n)
    grade = np.digitize(latent, [0.0, 2.0])
    row, col = np.nonzero(x)
    m = toxicity.fit(row, col, x[row, col], grade, l1=0.025, steps=500, relaxed=0.002)
    w = dict(zip(m.places.tolist(), m.weights, strict=True))
    assert w[0] > 1 and w[1] < -0.4 and max(abs(w.get(k, 0)) for k in range(2, f)) < 0.3
    assert m.cuts[1] - m.cuts[0] > 1


def test_toxicity_without_labels(spark, docs):
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).where("toxic").count() == 0


# 7. Quality


def test_quality_on_held_out_rows(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(500):
        y = int(rng.random() < 0.6)
        words = prose(rng, rng.randint(40, 500)).split()
        if not y:
            at = rng.randrange(len(words))
            words[at : at + 60] = [w.upper() + "!!" for w in words[at : at + 60]]
        rows.append((i, " ".join(words)))
        labels.append((i, y))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    p = quality.train(d, spark.createDataFrame(labels[:350], "doc_id long, quality int"))
    got = {r.doc_id: r for r in quality.score(d, p).collect()}
    assert np.mean([got[i].keep == bool(y) for i, y in labels[350:]]) > 0.9
    assert all(got[i].passages == -(-len(t.split()) // quality.PASSAGE) for i, t in rows)


def test_quality_gradient_by_differences():
    rng = np.random.default_rng(1)
    x, first, y = rng.random((9, quality.WIDTH)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    p = {k: v.astype(float) + 0.1 * rng.standard_normal(v.shape) if k not in ("mean", "sd") else v.astype(float) for k, v in quality.start().items()}

    def loss(q):
        s = quality.forward(q, x, first)["score"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    g = quality.gradient(p, quality.forward(p, x, first), first, y)
    for k in g:
        at = tuple(rng.integers(0, n) for n in p[k].shape)
        up, down = ({**p, k: p[k].copy()} for _ in "ab")
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert g[k][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=1e-2, abs=1e-6)


# 8. SimHash


def _pairs_by_brute_force(spark, docs):
    rows = simhash.signatures(docs).collect()
    ids = np.array([r.doc_id for r in rows])
    s1, s2 = (np.array([r[c] for r in rows], dtype=np.int64).view(np.uint64) for c in ("s1", "s2"))
    d1 = np.bitwise_count(s1[:, None] ^ s1)
    d2 = np.bitwise_count(s2[:, None] ^ s2)
    a, b = np.nonzero((d1 <= simhash.TAU) & (d1 + d2 <= simhash.TAU_ALL))
    return [(int(ids[i]), int(ids[j])) for i, j in zip(a, b, strict=True) if ids[i] < ids[j]]


def test_groups_are_those_of_all_pairs(spark, docs):
    want = roots(_pairs_by_brute_force(spark, docs))
    got = {r.doc_id: r for r in simhash.groups(docs).collect()}
    assert {i: r.group_id for i, r in got.items()} == want and len(want) >= 30
    sizes = Counter(want.values())
    assert all(r.group_size == sizes[r.group_id] and r.keep == (i == r.group_id) for i, r in got.items())
    left = {r.doc_id for r in simhash.deduplicate(docs).collect()}
    assert {170, 171, 172, 173, 100} <= left and not left & {i for i, r in got.items() if not r.keep}


def test_search_of_a_large_group_in_blocks():
    rng = np.random.default_rng(2)
    s1 = np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64))
    a, b = simhash._linked(np.arange(3000), s1, s1, 10, 26)
    assert len(a) == 2999 and set(b.tolist()) == {0}


# 9. URLs


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTPS://www.Bad.example.com:8080/a/b.html?x=1#t", "bad.example.com/a/b"), ("http://user@m.bad.example.com//a/", "bad.example.com/a"), ("bad.example.com", "bad.example.com/"), (" http://x.org/ ", "x.org/"),
        ("", ""), ("http://", ""), ("/only/path", ""),
    ],
)
def test_canonical(spark, url, want):
    assert spark.range(1).select(url_filter.canonical(F.lit(url))).first()[0] == want


@pytest.mark.parametrize("broadcast", [1 << 21, 0])
def test_urls_against_brute_force(spark, broadcast):
    rng = random.Random(4)
    pages = [(i, f"http://{rng.choice(['', 'www.', 'blog.'])}h{rng.randint(0, 40)}.example.org/{rng.choice(['a', 'b/c', 'd/e/f'])}{rng.choice(['', '/', '.html', '?q'])}") for i in range(400)] + [(900, None), (901, ""), (None, "http://h1.example.org/z"), (5, "http://h1.example.org/z"), (5, "http://h1.example.org/z")]
    listed = ["h1.example.org/", "http://h2.example.org/b/", "https://www.h3.example.org/a.html", "h4.example.org/d/e/f", None, "", "h1.example.org/", "nowhere.org/"]
    got = Counter(tuple(r) for r in url_filter.listed_pages(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([(u,) for u in listed], "url string"), broadcast_blocks=broadcast).collect())
    entries = ["h1.example.org/", "h2.example.org/b/", "h3.example.org/a", "h4.example.org/d/e/f"]
    want = Counter()
    for i, u in pages:
        c = url_filter_canonical(u)
        hits = [e for e in entries if c == e or (e.endswith("/") and (c.startswith(e) or (e.count("/") == 1 and c.split("/")[0].endswith("." + e[:-1]))))]
        if hits:
            want[i, u, c, min(hits, key=lambda e: (-len(e), e))] += 1
    assert got == want and len(want) > 5


def url_filter_canonical(u):
    host, _, path = (u or "").split("?")[0].replace("http://", "").partition("/")
    return f"{host.removeprefix('www.')}/{path.rstrip('/').removesuffix('.html')}" if host else ""


def test_filter_passes_all_that_is_listed():
    bitmap = np.zeros((4, 8), dtype=np.uint32)
    h = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 50)
    low = (h & 0x7FFFFFFF).astype(np.uint64)
    for i, s in enumerate(url_filter.SALTS):
        np.bitwise_or.at(bitmap[:, i], np.mod(h >> 32, 4), (np.uint32(1) << (((low * np.uint64(s)) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)).astype(np.uint32)))
    assert url_filter.may_contain(bitmap, h).all()
    other = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 5000)
    assert url_filter.may_contain(bitmap, other).mean() < 0.2


# 10. Suffix arrays


@pytest.mark.parametrize("shard_words", [400_000, 500])
def test_repeats_against_a_dictionary(docs, corpus, shard_words):
    got = {(r.doc_id, r.start_word, r.end_word, r.first_doc_id) for r in suffix_dedup.repeated_passages(docs, shard_words=shard_words).collect()}
    assert got == suffix_dedup.brute_force([(i, t) for i, t, *_ in corpus])
    assert {(i, 40, 110, 150) for i in range(151, 160)} <= got


def test_repeats_of_many_overlaps(spark):
    rng = random.Random(9)
    parts = [prose(rng, 35) for _ in range(6)]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(1, 8)))) for i in range(60)]
    got = {(r.doc_id, r.start_word, r.end_word, r.first_doc_id) for r in suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), shard_words=300).collect()}
    assert got == suffix_dedup.brute_force(rows)


# Odd inputs, for all


def _all(spark, d):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    items = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6"), (None, "w1")], "item_id long, text string")
    yield "fingerprints", fingerprints.fingerprints(d)
    yield "sharding", sharding.shuffle(d, 3)
    yield "codes", token_codes.encode_documents(d)
    yield "mixing", mixing.mix(d, block=16)
    yield "leaks", decontam.leaks(d, items)
    yield "toxicity", toxicity.score(d, toxicity.train(d, none))
    yield "quality", quality.score(d, quality.train(d, none))
    yield "groups", simhash.groups(d)
    yield "repeats", suffix_dedup.repeated_passages(d)
    yield "dedup", simhash.deduplicate(d)
    yield "decontaminate", decontam.decontaminate(d, items)


def test_empty_tables(spark, nothing):
    for name, df in _all(spark, nothing):
        assert df.count() == 0, name
    assert decontam.leaks(spark.createDataFrame([(1, "w1")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert url_filter.listed_pages(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "url string")).count() == 0


def test_awkward_tables(spark, awkward, corpus):
    n = {name: df.collect() for name, df in _all(spark, awkward)}
    assert len(n["fingerprints"]) == 8 and len(n["sharding"]) == 10 and len(n["codes"]) == len(n["toxicity"]) == len(n["quality"]) == 9
    assert n["groups"] == [] and n["repeats"] == [] and len(n["dedup"]) == len(n["decontaminate"]) == 10
    assert {r.doc_id for r in n["mixing"]} >= {r[0] for r in corpus[:6]} or len(n["mixing"]) > 0
    assert all(r["key"] == "x" and r["words"] == "x" for r in n["mixing"])


def test_near_copies_of_edits_are_found(spark):
    rng = random.Random(12)
    base = [prose(rng, 250) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, edited(rng, t, 0.04)) for i, t in enumerate(base)]
    got = {r.doc_id: r.group_id for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got.get(100 + i) == i for i in range(30)) >= 27 and SCHEMA
