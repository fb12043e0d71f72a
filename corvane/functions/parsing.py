"""Parsers and mergers of settings that run on the driver."""

from __future__ import annotations

import re
from typing import Any

ABSENT = object()


def quoted_list(text: str) -> list[str]:
    """Comma-separated items, trimmed; inside double quotes commas are text, "" is a quote and a backslash takes the next sign as it is."""
    out: list[str] = []
    for item in _scan(text):
        item = item.strip()
        if item:
            out.append(item)
    return out


def _scan(text: str):
    i, now, quoted = 0, [], False
    while i < len(text):
        c, nxt = text[i], text[i + 1 : i + 2]
        if quoted and c == "\\" and nxt:
            now.append(nxt)
            i += 1
        elif quoted and c == '"' and nxt == '"':
            now.append('"')
            i += 1
        elif c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            yield "".join(now)
            now = []
        else:
            now.append(c)
        i += 1
    yield "".join(now)


def snake_to_camel(name: str) -> str:
    return re.sub(r"_([a-z0-9])", lambda m: m[1].upper(), name)


def defined(patch: dict[str, Any]) -> dict[str, Any]:
    """Without absent values; None stays, as it overrides."""
    return {k: v for k, v in patch.items() if v is not ABSENT}


def merge(base: dict[str, Any], patch: dict[str, Any]) -> dict[str, Any]:
    """Dictionaries merge by key, all else is replaced, lists too."""
    out = dict(base)
    for k, v in defined(patch).items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def chunk(items: list, size: int) -> list[list]:
    if size < 1:
        raise ValueError("size must be positive")
    return [items[i : i + size] for i in range(0, len(items), size)]


def unique(items: list) -> list:
    return list(dict.fromkeys(items))
