"""Rules, their order, and a run over files: one lazy plan per step, states kept between runs."""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import derive_extensions
from ..operators import incremental
from ..operators.lines import explode_lines, suppressed
from ..operators.violations import from_result, normalize, with_fields
from ..sources.files import scan
from .config import step_config
from .state import State

#: A rule makes raw violations of lines (path, line, text, is_ignored) or of files (path, source).
Rule = Callable[..., DataFrame]


@dataclass
class Check:
    id: str
    fn: Rule
    kind: str = "lines"  # lines, files, or corpus: a rule over all files at once
    step: int | None = None
    description: str = ""
    config: dict[str, Any] = field(default_factory=dict)

    def fingerprint(self) -> str:
        """Of the rule's source: a changed rule finds no stored results."""
        try:
            text = inspect.getsource(self.fn)
        except (OSError, TypeError):
            text = repr(self.fn)
        return hashlib.sha256(f"{self.id}\n{text}".encode()).hexdigest()[:16]


class Registry:
    def __init__(self) -> None:
        self.checks: dict[str, Check] = {}

    def check(self, id: str, kind: str = "lines", **rest: Any) -> Callable[[Rule], Rule]:
        """Decorator; ids begin with check_ and occur once."""
        if not id.startswith("check_"):
            raise ValueError(f"{id}: a check's id begins with check_")
        if id in self.checks:
            raise ValueError(f"{id}: is registered already")
        if kind not in ("lines", "files", "corpus"):
            raise ValueError(f"{id}: no such kind: {kind}")

        def add(fn: Rule) -> Rule:
            self.checks[id] = Check(id, fn, kind, **rest)
            return fn

        return add

    def listing(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c.id, c.kind, c.step, c.description) for c in sorted(self.checks.values(), key=lambda c: c.id)], "id string, kind string, step int, description string")


def order(checks: list[Check], config: dict[str, Any]) -> list[Check]:
    """only, else step_order, else the steps given (a list of what may run), else by id; then who is switched off goes."""
    by_id = {c.id: c for c in sorted(checks, key=lambda c: c.id)}
    settings = {s["id"]: s for s in config.get("steps") or []}
    for id, s in settings.items():
        if id in by_id:
            by_id[id].step, by_id[id].config = s.get("step"), s
    ids = config.get("only") or config.get("step_order") or list(settings) or list(by_id)
    on, off, skip = (set(config.get(k) or []) for k in ("enable", "disable", "skip"))
    runs = lambda c: c.id in on or not (c.id in off or c.id in skip or c.config.get("enabled") is False)
    return [by_id[i] for i in ids if i in by_id and runs(by_id[i])]


@dataclass
class Result:
    passed: bool
    violations: DataFrame
    steps: DataFrame
    meta: dict[str, Any]


def _raw(check: Check, files: DataFrame, marker: str) -> DataFrame:
    made = check.fn(suppressed(explode_lines(files), marker)) if check.kind == "lines" else check.fn(files)
    return from_result(files.sparkSession, made)


def run(spark: SparkSession, checks: list[Check], files: DataFrame, config: dict[str, Any], changed: DataFrame | None = None, state: State | None = None, head: str = "none", ignore: list[str] | None = None) -> Result:
    """Runs the steps in order, each as one job, up to the first failure that bails.

    Files are those of the step's extensions, by default of scripts and of what
    its globs name, without what ``ignore`` (lines of an ignore file) ignores,
    unless the setting ``gitignore`` is null.

    With a state, files whose content was checked by the same rule keep their
    stored violations: those of a rule per file, if all files they depend on are
    unchanged. A rule over the corpus runs again if any file changed.
    """
    results, found = [], []
    for pos, check in enumerate(order(checks, config)):
        own = step_config(config, check.config)
        scoped = scan(files, own["include"], own["exclude"], derive_extensions(own["include"], own["extensions"]), own["scope"], ignore if own["gitignore"] else None, changed)
        hashed = scoped.select("path", F.sha2("source", 256).alias("sha256"))
        stored = state.load(spark, check.id, check.fingerprint()) if state else None
        todo, kept = scoped, None
        if stored is not None:
            cached, old = stored
            # Content decides; what git calls changed is no more than a hint.
            decided = incremental.partition(scoped.select("path"), cached, scoped.select("path"), hashed)
            again = decided.where("decision = 'check'")
            skipped = decided.where("decision = 'skip'")
            if check.kind == "corpus":
                if not incremental.needs_whole_check(decided) and cached.join(scoped.select("path"), "path", "left_anti").isEmpty():
                    todo, kept = scoped.limit(0), old
            else:
                todo = scoped.join(again, "path", "left_semi")
                kept = incremental.restore(old.withColumn("id", F.monotonically_increasing_id()), skipped).drop("id")
        fresh = normalize(_raw(check, todo, own["ignore_marker"]), check_id=check.id, step=check.step or pos + 1)
        if check.kind != "corpus":
            fresh = fresh.withColumn("dep_files", F.coalesce("dep_files", F.array("file")))
        out = fresh if kept is None else fresh.unionByName(kept.withColumn("step", F.lit(check.step or pos + 1)))
        if state:
            out = state.save(spark, check.id, check.fingerprint(), head, hashed, out)
        n = out.count()
        found.append(out)
        results.append((check.id, check.step or pos + 1, "fail" if n else "pass", n))
        if n and own.get("bail") is not False:
            break
    violations = found[0] if found else with_fields(spark.createDataFrame([], "message string"))
    for v in found[1:]:
        violations = violations.unionByName(v)
    steps = spark.createDataFrame(results, "id string, step int, status string, n_violations long")
    return Result(all(r[2] == "pass" for r in results), violations, steps, {"timestamp": datetime.now(UTC).isoformat(), "head": head, "steps": len(results)})
