"""What to check again, and what to keep, from stored content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def partition(files: DataFrame, cached: DataFrame, modified: DataFrame, live: DataFrame) -> DataFrame:
    """files (path) with ``decision``: check or skip.

    No stored hash: check. Modified: skip only if the live hash equals the
    stored one. Not modified: check only if a live hash is known and differs.
    """
    c = cached.select("path", F.col("sha256").alias("stored"))
    m = modified.select("path").distinct().withColumn("dirty", F.lit(True))
    now = live.select("path", F.col("sha256").alias("live"))
    joined = files.join(c, "path", "left").join(m, "path", "left").join(now, "path", "left")
    stored = F.nullif("stored", F.lit(""))
    check = stored.isNull() | (F.col("dirty").isNotNull() & ~stored.eqNullSafe(F.col("live"))) | (F.col("dirty").isNull() & F.col("live").isNotNull() & (F.col("live") != stored))
    return joined.select(*files.columns, F.when(check, "check").otherwise("skip").alias("decision"))


def needs_whole_check(decided: DataFrame) -> bool:
    """Whether a rule over the whole corpus has to run again."""
    return not decided.where("decision = 'check'").isEmpty()


def restore(violations: DataFrame, skipped: DataFrame, id_col: str = "id", default_own_file: bool = True) -> DataFrame:
    """Stored violations all of whose files were skipped; without files, its own counts, or it is dropped."""
    none = F.coalesce(F.size("dep_files"), F.lit(0)) < 1
    deps = F.when(none, F.array("file")).otherwise(F.col("dep_files")) if default_own_file else F.col("dep_files")
    spread = violations.select(id_col, F.explode(deps).alias("path")).where("path is not null").distinct()
    clean = spread.join(skipped.select("path").distinct().withColumn("ok", F.lit(True)), "path", "left").groupBy(id_col).agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok"))
    return violations.join(clean.where("ok"), id_col, "left_semi")


def files_to_store(scoped: DataFrame, checked: DataFrame, cached: DataFrame) -> DataFrame:
    """(path, sha256) to keep: of a checked file its own, else the stored one; without either none."""
    a = checked.select("path", F.sha2("source", 256).alias("fresh"))
    b = cached.select("path", F.col("sha256").alias("stored"))
    return scoped.select("path").join(a, "path", "left").join(b, "path", "left").select("path", F.coalesce("fresh", "stored").alias("sha256")).where("sha256 is not null")


def changed(diff: DataFrame, untracked: DataFrame, exempt: tuple[str, ...] = ()) -> DataFrame:
    out = diff.select("path").union(untracked.select("path")).where("path <> ''").distinct()
    for prefix in exempt:
        out = out.where(~F.col("path").startswith(prefix))
    return out


def largest_entry(entries: DataFrame) -> DataFrame:
    """The stored entry of each rule with most files; of equals the first directory."""
    order = W.partitionBy("check_id").orderBy(F.desc("n_files"), "dir")
    return entries.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def largest_then_latest(entries: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("dir", "n_files", "saved_at"), F.struct("n_files", "saved_at", "dir"))
    return entries.groupBy("check_id").agg(best.alias("e")).select("check_id", "e.*")


def latest_entry(entries: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("check_id", "dir", "n_files"), F.struct("saved_at", "check_id", "dir"))
    return entries.agg(best.alias("e"), F.max("saved_at").alias("saved_at")).select("e.*", "saved_at")
