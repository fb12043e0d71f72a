"""Stored results of rules: hashes of checked files and their violations, by rule and fingerprint."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class State:
    """Folder check_id/fingerprint/version-*/{files,violations}, on storage that all executors share.

    A version is complete when its marker is written, so a run that ends early leaves the one before.
    """

    def __init__(self, root: str) -> None:
        self.root = root.rstrip("/")

    def _fs(self, spark: SparkSession):
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path

    def _versions(self, spark: SparkSession, folder: str) -> list[str]:
        fs, path = self._fs(spark)
        if not fs.exists(path(folder)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(folder))]
        return sorted(n for n in names if fs.exists(path(f"{folder}/{n}/_COMPLETE")))

    def load(self, spark: SparkSession, check_id: str, fingerprint: str) -> tuple[DataFrame, DataFrame] | None:
        """(files, violations) last stored; None if there are none."""
        folder = f"{self.root}/{check_id}/{fingerprint}"
        versions = self._versions(spark, folder)
        if not versions:
            return None
        return tuple(spark.read.parquet(f"{folder}/{versions[-1]}/{t}") for t in ("files", "violations"))

    def save(self, spark: SparkSession, check_id: str, fingerprint: str, head: str, files: DataFrame, violations: DataFrame) -> DataFrame:
        """Writes a new version and returns its violations, read again; versions before the last two go."""
        folder = f"{self.root}/{check_id}/{fingerprint}"
        old = self._versions(spark, folder)
        version = f"{datetime.now(UTC).strftime('%Y%m%dT%H%M%S%f')}-{uuid.uuid4().hex[:8]}"
        files.withColumn("head", F.lit(head)).write.parquet(f"{folder}/{version}/files")
        violations.write.parquet(f"{folder}/{version}/violations")
        fs, path = self._fs(spark)
        fs.create(path(f"{folder}/{version}/_COMPLETE")).close()
        for v in old[:-1]:
            fs.delete(path(f"{folder}/{v}"), True)
        return spark.read.parquet(f"{folder}/{version}/violations")

    def prune(self, spark: SparkSession, check_id: str) -> bool:
        """Forgets a rule; whether there was something to forget."""
        fs, path = self._fs(spark)
        return fs.delete(path(f"{self.root}/{check_id}"), True)

    def clear(self, spark: SparkSession) -> bool:
        fs, path = self._fs(spark)
        return fs.delete(path(self.root), True)
