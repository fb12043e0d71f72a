"""State of a working copy, from the output of git, as tables of paths."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import porcelain_path


@dataclass(frozen=True)
class Context:
    branch: str
    head: str
    status: str


def _git(cwd: str, *args: str) -> str | None:
    try:
        got = subprocess.run(["git", "-C", cwd, *args], capture_output=True, text=True, timeout=60)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return got.stdout if got.returncode == 0 else None


def is_repository(cwd: str) -> bool:
    return (_git(cwd, "rev-parse", "--is-inside-work-tree") or "").strip() == "true"


def context(cwd: str) -> Context | None:
    """None outside a repository."""
    if not is_repository(cwd):
        return None
    return Context((_git(cwd, "rev-parse", "--abbrev-ref", "HEAD") or "").strip(), (_git(cwd, "rev-parse", "HEAD") or "").strip(), _git(cwd, "status", "--porcelain") or "")


def _paths(spark: SparkSession, text: str | None) -> DataFrame:
    return spark.createDataFrame([(x.strip(),) for x in (text or "").splitlines() if x.strip()], "path string")


def changed_paths(spark: SparkSession, cwd: str) -> DataFrame:
    """Unstaged and untracked; what is only staged is not in it."""
    return _paths(spark, _git(cwd, "diff", "--name-only")).union(_paths(spark, _git(cwd, "ls-files", "--others", "--exclude-standard"))).distinct()


def staged_paths(spark: SparkSession, cwd: str) -> DataFrame:
    return _paths(spark, _git(cwd, "diff", "--name-only", "--cached"))


def between(spark: SparkSession, cwd: str, a: str, b: str) -> DataFrame | None:
    """Paths that differ between two commits; None if git can't tell, so that all is checked."""
    got = _git(cwd, "diff", "--name-only", a, b)
    return None if got is None else _paths(spark, got)


def status_paths(lines: DataFrame, exempt: tuple[str, ...] = ()) -> DataFrame:
    """(path) of status lines (status_line), without blanks and exempt prefixes."""
    out = lines.select(porcelain_path(F.col("status_line")).alias("path")).where("path is not null and path <> ''")
    for prefix in exempt:
        out = out.where(~F.col("path").startswith(prefix))
    return out.distinct()
