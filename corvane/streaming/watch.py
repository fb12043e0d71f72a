"""Rules over a folder that files keep arriving in: each micro-batch replaces the results of its files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lines import explode_lines, suppressed
from ..operators.violations import normalize, with_fields


def watch(spark: SparkSession, source: DataFrame, rule: Callable[[DataFrame], DataFrame], check_id: str, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """source: a stream of (path, source). Violations of batch b go to out/batch=b, written once per batch number, so a replay repeats nothing."""

    def each(batch: DataFrame, number: int) -> None:
        found = normalize(with_fields(rule(suppressed(explode_lines(batch)))), check_id=check_id)
        found.write.mode("overwrite").parquet(f"{out}/violations/batch={number}")
        batch.select("path").distinct().write.mode("overwrite").parquet(f"{out}/files/batch={number}")

    writer = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """Violations of the last batch of each file."""
    last = spark.read.parquet(f"{out}/files").groupBy("path").agg(F.max("batch").alias("batch"))
    v = spark.read.parquet(f"{out}/violations")
    return v.join(last, (v["file"] == last["path"]) & (v["batch"] == last["batch"]), "left_semi")
