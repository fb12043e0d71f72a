"""Globs and path scopes, compiled on the driver to Java regular expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_META = set(".+^${}()|[]\\")
DEFAULT_EXTENSIONS = (".js", ".jsx", ".ts", ".tsx")


def java_escape(text: str) -> str:
    """text as a literal in a Java (or RE2, or Python) pattern."""
    return "".join("\\" + c if c in _META or c in "*?" else c for c in text)


def expand_braces(glob: str) -> list[str]:
    """All patterns that the brace groups of a glob stand for, the left-most group first."""
    found = re.search(r"\{([^}]+)\}", glob)
    if not found:
        return [glob]
    head, tail = glob[: found.start()], glob[found.end() :]
    return [p for one in found[1].split(",") for p in expand_braces(head + one.strip() + tail)]


_TOKEN = re.compile(r"\*\*/|\*\*|\*|\?|.", re.DOTALL)
_WILD = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def glob_regex(glob: str, end: str = r"\z") -> str:
    """Anchored regular expression of one glob without braces. ``end``: what the dialect calls the end of text."""
    return "^" + "".join(_WILD.get(t) or ("\\" + t if t in _META else t) for t in _TOKEN.findall(glob)) + end


def matches_glob(path: str, glob: str) -> bool:
    return any(re.search(glob_regex(g, r"\Z"), path.replace("\\", "/")) for g in expand_braces(glob))


def any_glob(path: Column, globs: list[str] | None) -> Column:
    """True where a glob matches; true everywhere if there are none."""
    if not globs:
        return F.lit(True)
    return posix(path).rlike("|".join(glob_regex(p) for g in globs for p in expand_braces(g)))


def posix(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def in_scopes(path: Column, scopes: list[str] | None) -> Column:
    """Plain prefixes: ``packages/ui`` also holds ``packages/ui-kit``."""
    return reduce(lambda a, s: a | path.startswith(s), scopes, F.lit(False)) if scopes else F.lit(True)


def rule_scope(path: Column, scopes: list[str]) -> Column:
    """Scope of a rule: a glob where it holds ``**`` (``?`` is literal there), else a prefix."""
    path, out = posix(path), F.lit(False)
    for s in scopes:
        if "**" in s:
            wild = dict(_WILD) | {"?": r"\?"}
            out |= path.rlike("^" + "".join(wild.get(t) or ("\\" + t if t in _META else t) for t in _TOKEN.findall(s)) + r"\z")
        else:
            out |= path.startswith(s)
    return out


def inside(path: Column, folder: str) -> Column:
    return (path == folder) | path.startswith(folder.rstrip("/") + "/")


def derive_extensions(include: list[str] | None, extensions: list[str] | None = None) -> list[str]:
    """Given ones with dots; else the defaults, the first brace group of each glob, and plain suffixes of globs."""
    dot = lambda e: e if e.startswith(".") else "." + e
    if extensions:
        return [dot(e) for e in extensions]
    out = list(DEFAULT_EXTENSIONS)
    for g in include or ():
        found = re.search(r"\{([^}]+)\}", g)
        out += [dot(e.strip()) for e in found[1].split(",")] if found else re.findall(r"\*(\.\w+)$", g)
    return list(dict.fromkeys(out))


def ignore_column(path: Column, patterns: list[str]) -> Column:
    """Whether the last pattern of an ignore file that matches ignores the path.

    Comments and blank lines are left out; ``!`` takes back; a slash at the end
    is for directories only; a slash elsewhere anchors at the root.
    """
    out = F.lit(False)
    for raw in patterns:
        line = raw.rstrip("\r\n").rstrip()
        if not line or line.startswith("#"):
            continue
        keep, line = line.startswith("!"), line.lstrip("!") if line.startswith("!") else line
        folder, line = line.endswith("/"), line.rstrip("/")
        anchored, line = "/" in line, line.lstrip("/")
        body = glob_regex(line, "")[1:]
        hit = path.rlike(("^" if anchored else "(?:^|/)") + body + ("/" if folder else r"(?:/|\z)"))
        out = F.when(hit, F.lit(not keep)).otherwise(out)
    return out
