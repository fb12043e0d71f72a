"""Reports of a run. Grouping runs in Spark; only the grouped rows of a report come to the driver."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators.violations import compact, group, summary
from .steps import Result


def as_json(result: Result) -> str:
    groups = group(result.violations, ["step", "file", "line", "message"]).orderBy("ord").drop("ord")
    rows = [json.loads(x[0]) for x in groups.select(F.to_json(F.struct("*"))).toLocalIterator()]
    steps = [r.asDict() for r in result.steps.orderBy("step").collect()]
    return json.dumps({"passed": result.passed, "steps": steps, "violations": rows, "meta": result.meta}, indent=2, ensure_ascii=False)


def as_compact(result: Result) -> str:
    lines = [r.line for r in compact(result.steps).orderBy("step").collect()]
    return "\n".join([*lines, f"total {summary(result.steps).first().total}"])


def as_text(result: Result) -> str:
    """One block per violation, by step, file and line, with its other fields."""
    out = [as_compact(result), ""]
    for r in result.violations.orderBy("step", "file", "line", "message").toLocalIterator():
        out.append(f"[{r.severity}] {r.check_id} {r.file or '-'}:{r.line or '-'} {r.message}")
        out += [f"    {k}: {getattr(r, k)}" for k in ("text", "code", "impact", "fix") if getattr(r, k)]
        out += [f"    {k}: {v}" for k, v in sorted((r.extras or {}).items())]
    return "\n".join(out) + "\n"


REPORTERS = {"json": as_json, "compact": as_compact, "default": as_text}


def write(result: Result, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(as_json(result) if path.endswith(".json") else as_text(result))
