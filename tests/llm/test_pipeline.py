from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from corvane.llm import decontam, simhash, suffix_dedup, toxicity
from corvane.llm import queries as llm
from corvane.llm import textkernel as tk
from tests.test_queries import agree


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    agree(spark, sf_dir, name)


def test_suffix_query_by_dictionary(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {(r.doc_id, r.start_word, r.end_word, r.first_doc_id) for r in llm.op10_suffix_dedup(spark, sf_dir).collect()}
    assert got == suffix_dedup.brute_force(rows)


def every_window(texts, items):
    """Documents with a window within the distance of an item, by the edit distance of every window."""
    w = tk.words(pa.array(list(texts.values())))
    owner, out = np.array(list(texts)), set()
    row = w.row_of()
    for _, t in items:
        item = tk.words(pa.array([t])).hash
        n, most = len(item), int(len(item) * decontam.RATIO + 1e-9)
        at = np.flatnonzero(np.arange(len(w.hash)) + n <= w.first[1:][row]) if n else np.zeros(0, dtype=np.int64)
        if len(at):
            d = decontam.edit_distance(w.hash[at[:, None] + np.arange(n)], np.broadcast_to(item, (len(at), n)), most)
            out |= set(owner[row[at[d <= most]]].tolist())
    return out


def test_stages_take_effect(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    read = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in read.collect()}
        out = stage(spark, read, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert tuple(after.columns) == corpus_pipeline.COLUMNS and after.dtypes == docs.dtypes, name
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.score(read, model).where("toxic").collect()}
            assert ids == set(before) - bad
        if name == "simhash_near_dedup":
            assert ids == set(before) - {r.doc_id for r in simhash.groups(read).where("not keep").collect()}
        if name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            short = {i: t for i, t in before.items() if len(t) < 3000}
            leaked = every_window(short, items)
            assert leaked and len(ids & leaked) <= 0.1 * len(leaked) and ids >= set(short) - leaked
        if name == "sharding":
            assert Counter(r.text for r in after.collect()) == Counter(r.text for r in read.collect())
        read = after


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == [*corpus_pipeline.COLUMNS, "shard", "position"] and out.count() > 100
