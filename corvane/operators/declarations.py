"""Interfaces and object types of typed scripts, read by a small scanner of flat declarations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DECLARATION
from .lines import explode_lines, suppressed
from .pairs import duplicate_declarations, type_hint
from .violations import with_fields

_HEAD = re.compile(r"^[ \t]*(?:export\s+)?(?:declare\s+)?(?:(interface)\s+(\w+)[^{=;]*|(type)\s+(\w+)[^={;]*=\s*)\{", re.MULTILINE)
_PROP = re.compile(r"^(readonly\s+)?([\w$]+|'[^']*'|\"[^\"]*\")\s*(\?)?\s*:\s*([\s\S]+)$")


def members(text: str) -> list[str]:
    """Parts of a body between semicolons, commas or line ends outside brackets."""
    out, now, depth = [], "", 0
    for c in re.sub(r"//[^\n]*|/\*[\s\S]*?\*/", "", text):
        depth += (c in "{[(<") - (c in "}])>")
        if c in ";,\n" and depth <= 0:
            out.append(now)
            now, depth = "", 0
        else:
            now += c
    return [x.strip() for x in [*out, now] if x.strip()]


def declarations(source: str) -> list[dict]:
    out = []
    for m in _HEAD.finditer(source):
        depth, i = 1, m.end()
        while i < len(source) and depth:
            depth += (source[i] == "{") - (source[i] == "}")
            i += 1
        props = []
        for part in members(source[m.end() : i - 1]):
            if p := _PROP.match(part):
                props.append({"name": p[2].strip("'\""), "type": " ".join(p[4].split()), "optional": bool(p[3]), "readonly": bool(p[1])})
        head = source[: m.start()] + m[0][: len(m[0]) - len(m[0].lstrip())]
        out.append({"kind": m[1] or m[3], "name": m[2] or m[4], "line": head.count("\n") + 1, "props": props})
    return out


def extract(files: DataFrame) -> DataFrame:
    """Declarations of files (path, source), without those that begin on a suppressed line."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d["kind"], d["name"], p.replace("\\", "/"), d["line"], d["props"]) for p, s in zip(pdf["path"], pdf["source"], strict=True) if p and s for d in declarations(s)]
            yield pd.DataFrame(rows, columns=["kind", "name", "file_path", "line", "props"])

    found = files.select("path", "source").mapInPandas(find, DECLARATION)
    bad = suppressed(explode_lines(files)).where("is_ignored").select(F.col("path").alias("file_path"), "line")
    return found.join(bad, ["file_path", "line"], "left_anti").select(*[x.split()[0] for x in ("kind", "name", "file_path", "line", "props")])


_ADVICE = {
    "EXACT_DUPLICATE": "declared twice alike; keep one in",
    "SAME_STRUCTURE": "of one structure under two names; merge in",
    "SAME_NAME_DIFF_TYPES": "one name, property types differ; rename or align. Home:",
    "SAME_NAME_DIFF_STRUCT": "one name for different shapes; rename one. Home:",
}


def check(files: DataFrame, rule: str = "check_duplicate_interfaces") -> DataFrame:
    """Raw violations for reported pairs; the code is the logical id, so a code is one group of a report."""
    pairs = duplicate_declarations(extract(files))
    advice = F.create_map(*[F.lit(x) for kv in _ADVICE.items() for x in kv])
    there = F.struct(F.col("primary.file_path").alias("file"), F.col("primary.line").alias("line"), F.lit(None).cast("int").alias("column"), F.concat_ws(" ", "primary.kind", "primary.name").alias("text"), F.lit("primary declaration").alias("context"))
    message = F.concat_ws(" ", F.col("primary.name"), advice[F.col("code")], type_hint(F.col("primary.file_path"), F.col("duplicate.file_path")))
    return with_fields(pairs.select(message.alias("message"), F.col("duplicate.file_path").alias("file"), F.col("duplicate.line").alias("line"), F.concat_ws(" ", "duplicate.kind", "duplicate.name").alias("text"), "code", F.array(there).alias("occurrences"), F.lit(rule).alias("check_id")))
