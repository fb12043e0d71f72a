"""The bounded sample of labelled documents that the classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, y) of at most ``most`` labelled documents, the first by a hash of doc_id.

    Null labels and null doc_ids are left out; of several labels of a document
    the greatest counts, of several rows of one doc_id one.
    """
    chosen = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label}`").cast("double").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    text = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    # ``most`` rows of two numbers: of bounded size, whatever the corpus.
    return text.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
