"""Violations: rules on lines, normal form, groups, and results of steps."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegralType, StringType, StructType

from ..model import LOCATION, RAW_VIOLATION


def line_rule(lines: DataFrame, rule: str, when: Column, message: str, severity: str = "error", skip_comments: bool = False) -> DataFrame:
    """One raw violation for each line outside suppression blocks where ``when`` holds."""
    if skip_comments:
        when = when & ~F.ltrim("text").rlike(r"^(//|\*|/\*)")
    hits = lines.where(~F.col("is_ignored") & when) if "is_ignored" in lines.columns else lines.where(when)
    return with_fields(hits.select(F.lit(message).alias("message"), F.lit(severity).alias("severity"), F.col("path").alias("file"), "line", "text", F.lit(rule).alias("check_id"))).dropDuplicates(["file", "line", "check_id"])


def with_fields(df: DataFrame) -> DataFrame:
    """df with every field of a raw violation, null where it has none."""
    fields = [f.strip().split(" ", 1) for f in _split(RAW_VIOLATION)]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def from_result(spark: SparkSession, made: Any) -> DataFrame:
    """Raw violations of what a rule returned: a table, a mapping, a list of mappings, or a mapping that holds such a list
    under ``violations``. All else, and members that aren't mappings, are left out, as are fields that a violation doesn't have."""
    if isinstance(made, DataFrame):
        return with_fields(made)
    if isinstance(made, dict) and "violations" in made:
        made = made["violations"]
    made = [made] if isinstance(made, dict) else made if isinstance(made, list) else []
    schema = DataType.fromDDL(RAW_VIOLATION)
    return spark.createDataFrame([_fitted(v, schema) for v in made if isinstance(v, dict)], schema)


def _fitted(value: Any, kind: DataType) -> Any:
    """value as kind asks, field by field; null where it is of another kind."""
    if isinstance(kind, StructType):
        return tuple(_fitted(value.get(f.name), f.dataType) for f in kind) if isinstance(value, dict) else None
    if isinstance(kind, ArrayType):
        return [_fitted(v, kind.elementType) for v in value] if isinstance(value, list) else None
    if isinstance(kind, StringType):
        return value if isinstance(value, str) else None
    if isinstance(kind, IntegralType):
        return value if isinstance(value, int) and not isinstance(value, bool) and abs(value) < 1 << 31 else None
    return value if isinstance(value, dict) and all(isinstance(x, str) for x in [*value, *value.values()]) else None


def _split(schema: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


def _text(name: str) -> Column:
    return F.when(F.col(name) != "", F.col(name))


def normalize(raw: DataFrame, file: str | None = None, check_id: str | None = None, step: int | None = None) -> DataFrame:
    """Fills what a rule left out: message, severity, locations, logical id, file, rule and step.

    Locations are made before the file is filled in, so a violation without a
    file of its own has no primary location.
    """
    occurrences = F.transform(
        F.coalesce(F.col("occurrences"), F.array().cast("array<struct<file:string,line:int,column:int,text:string,context:string>>")),
        lambda o: F.struct(o.file.alias("file"), o.line.alias("line"), o.column.alias("column"), o.text.alias("text"), F.coalesce(F.when(o.context != "", o.context), F.lit("involved")).alias("label")),
    )
    own = F.struct("file", "line", "column", "text", F.lit("primary").alias("label"))
    none = F.array().cast(f"array<{LOCATION}>")
    made = F.when(_text("file").isNotNull() | F.col("occurrences").isNotNull(), F.concat(F.when(_text("file").isNotNull(), F.array(own)).otherwise(none), occurrences).cast(f"array<{LOCATION}>"))
    return (
        raw.withColumn("locations", F.coalesce("locations", made))
        .withColumn("message", F.coalesce(_text("message"), _text("summary"), _text("title"), F.lit("Violation")))
        .withColumn("severity", F.coalesce("severity", F.lit("error")))
        .withColumn("logical_id", F.coalesce("logical_id", _text("code")))
        .withColumn("file", F.coalesce(_text("file"), F.lit(file)))
        .withColumn("check_id", F.coalesce("check_id", F.lit(check_id)))
        .withColumn("step", F.coalesce("step", F.lit(step).cast("int")))
        .withColumn("dep_files", F.coalesce("dep_files", F.when(F.col("file").isNotNull(), F.array("file"))))
    )


def group(violations: DataFrame, order: list[str]) -> DataFrame:
    """One row per logical id, or else per rule and message, or else per violation, in the order given.

    The first of a group gives its fields; locations are those of all, without
    repeats of (file, line, label), or of (file, line) for a violation that had
    no locations.
    """
    key = F.coalesce(_text("logical_id"), F.when(_text("check_id").isNotNull() & _text("message").isNotNull(), F.concat_ws(":", "check_id", "message")))
    v = violations.withColumn("ord", F.struct(*order)).withColumn("key", F.coalesce(F.concat(F.lit("g:"), key), F.concat(F.lit("u:"), F.to_json("ord"))))
    first = v.groupBy("key").agg(F.min_by(F.struct("check_id", "severity", "message", "logical_id", "impact"), "ord").alias("head"), F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n_violations"))
    own = F.array(F.struct("file", "line", "column", "text", F.lit("primary").alias("label"))).cast(f"array<{LOCATION}>")
    bare = F.col("locations").isNull() & _text("file").isNotNull()
    spread = v.select("key", "ord", bare.alias("bare"), F.posexplode(F.coalesce("locations", F.when(bare, own))).alias("nth", "loc"))
    same = W.partitionBy("key", "loc.file", "loc.line")
    by_label = same.partitionBy("key", "loc.file", "loc.line", "loc.label").orderBy("ord", "nth")
    spread = spread.withColumn("rank", F.row_number().over(by_label)).withColumn("before", F.count(F.lit(1)).over(same.orderBy("ord", "nth").rowsBetween(W.unboundedPreceding, -1)))
    kept = spread.where(F.when(F.col("bare"), F.col("before") == 0).otherwise(F.col("rank") == 1))
    locations = kept.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "nth", "loc"))), lambda x: x.loc).alias("locations"))
    return first.join(locations, "key", "left").select("ord", F.col("head.check_id").alias("rule"), "head.severity", "head.message", "head.logical_id", "head.impact", "n_violations", F.coalesce("locations", F.array().cast(f"array<{LOCATION}>")).alias("locations"))


def step_results(steps: DataFrame, violations: DataFrame) -> DataFrame:
    """steps (id, step) with status and n_violations; severity doesn't matter."""
    n = violations.groupBy(F.col("check_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return steps.join(n, "id", "left").select("id", "step", F.when(F.coalesce("n", F.lit(0)) > 0, "fail").otherwise("pass").alias("status"), F.coalesce("n", F.lit(0)).alias("n_violations"))


def passed(results: DataFrame) -> DataFrame:
    """(passed): every step passes; true for none."""
    return results.agg(F.coalesce(F.bool_and(F.col("status") == "pass"), F.lit(True)).alias("passed"))


def summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if(F.col("status") == "fail").alias("failed"), F.count_if(F.col("status") == "pass").alias("passed"), F.coalesce(F.sum("n_violations"), F.lit(0)).alias("total"))


def compact(results: DataFrame) -> DataFrame:
    """(step, line): one line per step for the short report."""
    return results.select("step", F.format_string("%s %d. %s (%d)", F.when(F.col("status") == "pass", "P").otherwise("F"), "step", "id", "n_violations").alias("line"))


def number_steps(steps: DataFrame) -> DataFrame:
    """Explicit step numbers win; else the place among the steps."""
    return steps.withColumn("step", F.coalesce("step", F.row_number().over(W.orderBy("pos"))))


def bail(results: DataFrame) -> DataFrame:
    """Results up to the first failed step that bails, by ``pos``; steps are few, so one ordered window does."""
    stops = F.sum((F.col("status").eqNullSafe("fail") & F.coalesce(F.col("bail"), F.lit(True))).cast("int"))
    before = stops.over(W.orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    return results.withColumn("__stops", F.coalesce(before, F.lit(0))).where("__stops = 0").drop("__stops")


def import_boundary(files: DataFrame, forbidden: str = "apps/", rule: str = "check_dependency_boundary") -> DataFrame:
    """Violations for imports whose quoted part holds ``forbidden``; the part runs to the last quote of its line."""
    lines = files.select(F.col("path").alias("file"), F.posexplode(F.split("source", "\n", -1)).alias("at", "text"))
    quoted = F.explode(F.regexp_extract_all("text", F.lit(r"""(?:from|import)\s+['"](.*)['"]"""), F.lit(1)))
    hits = lines.where(F.col("text").contains(forbidden)).select("file", (F.col("at") + 1).alias("line"), quoted.alias("text"))
    return with_fields(hits.where(F.col("text").contains(forbidden)).select(F.concat(F.lit("Forbidden import: "), "text").alias("message"), "file", "line", "text", F.lit(rule).alias("check_id")))
