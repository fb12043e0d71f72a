"""python -m corvane FOLDER --rule PATTERN [settings]: checks the lines of a folder's files against a pattern."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.violations import line_rule
from .plans.config import flags, resolve
from .plans.report import REPORTERS, write
from .plans.steps import Check, run
from .sources.files import ignore_patterns, read_text
from .sources.status import changed_paths, staged_paths


def main(argv: list[str]) -> int:
    if not argv or argv[0].startswith("-"):
        print(__doc__)
        return 2
    given = flags(argv[1:])
    pattern, report = given.pop("rule", "TODO|FIXME"), given.pop("report_file", None)
    config = resolve(None, given)
    spark = SparkSession.builder.appName("corvane").getOrCreate()
    rule = Check("check_pattern", lambda lines: line_rule(lines, "check_pattern", F.col("text").rlike(pattern), f"matches {pattern}"))
    changed = {"all": lambda *_: None, "changed": changed_paths, "staged": staged_paths}[config["scan_mode"]](spark, argv[0])
    result = run(spark, [rule], read_text(spark, argv[0]), config, changed, ignore=ignore_patterns(argv[0], config["gitignore"]))
    if report:
        write(result, report)
    if not (report or "").endswith(".json"):
        print(REPORTERS[config["reporter"]](result))
    return 0 if result.passed or (report or "").endswith(".json") else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
