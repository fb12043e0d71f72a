"""Components in script sources: where they begin and end, and the markup they return."""

from __future__ import annotations

import re

from .markup import WRAPPERS

_NAME = r"([A-Za-z_$][A-Za-z0-9_$]*)"
_FUNCTION = re.compile(rf"(?:export\s+(?:default\s+)?)?function\s+{_NAME}\s*[(<]")
_ASSIGNED = re.compile(rf"(?:export\s+)?(?:const|let|var)\s+{_NAME}\s*(?::\s*React\.[A-Z][A-Za-z]*(?:<[^>]*>)?\s*)?=")
_CLASS = re.compile(rf"(?:export\s+(?:default\s+)?)?class\s+{_NAME}\s+extends\s+(?:React\.)?(?:Component|PureComponent)")
_ANONYMOUS = re.compile(r"export\s+default\s+function\s*\(")
_NESTED = re.compile(rf"\s+function\s+{_NAME}\s*[(<]")
_MARKUP = re.compile(r"</?[A-Z][A-Za-z0-9.]*[\s/>]|<[a-z][a-z0-9-]*[\s/>]|<>|</>|React\.createElement")


def has_markup(lines: list[str]) -> bool:
    return any(_MARKUP.search(x) for x in lines)


def body(lines: list[str], at: int) -> list[str]:
    """Lines of the function whose head is line ``at``, by braces, or parentheses where there are none."""
    braces = parens = 0
    brace_seen = paren_seen = False
    quote = ""
    for i in range(at, len(lines)):
        line = lines[i]
        for k, c in enumerate(line):
            if quote:
                if c == quote and not (k and line[k - 1] == "\\"):
                    quote = ""
            elif c in "\"'`":
                quote = c
            elif c == "/" and line[k + 1 : k + 2] == "/":
                break
            elif c in "{}":
                braces += 1 if c == "{" else -1
                brace_seen |= c == "{"
            elif c in "()":
                parens += 1 if c == "(" else -1
                paren_seen |= c == "("
        closed = braces == 0 if brace_seen else parens == 0 if paren_seen else i > at
        if closed:
            return lines[at : i + 1]
    return lines[at:]


def count_loc(lines: list[str]) -> int:
    inside, n = False, 0
    for raw in lines:
        line = raw.strip()
        if inside or line.startswith("/*"):
            inside = "*/" not in line
        elif line and not line.startswith("//"):
            n += 1
    return n


def _peeled(text: str) -> str | None:
    text = text.strip()
    found = re.match(rf"{_NAME}\s*\(", text)
    if found and found[1] in WRAPPERS:
        depth = 0
        for i in range(found.end() - 1, len(text)):
            depth += (text[i] == "(") - (text[i] == ")")
            if text[i] == ")" and not depth:
                inner = text[found.end() : i].strip()
                return _peeled(inner) or inner
    return text if re.search(r"=>|\bfunction\b", text) else None


def detect(source: str, least: int = 1) -> list[dict]:
    """name, start_line, end_line, lines and loc of each component, by start."""
    lines, out, used = source.split("\n"), [], set()

    def add(name: str, at: int, own: list[str], checked: bool = True, floor: int = least) -> None:
        if checked and (not re.fullmatch(r"[A-Z][A-Za-z0-9]*", name) or not has_markup(own)):
            return
        span = (at + 1, at + len(own))
        if span in used:
            return
        used.add(span)
        loc = count_loc(own)
        if loc >= floor:
            out.append({"name": name, "start_line": span[0], "end_line": span[1], "lines": own, "loc": loc})

    for i, raw in enumerate(lines):
        line = raw.strip()
        if m := _FUNCTION.match(line):
            add(m[1], i, body(lines, i))
        if m := _ASSIGNED.match(line):
            right = re.sub(r"^.*?=\s*", "", raw, count=1).strip()
            word = re.match(rf"{_NAME}\s*\(", right)
            if word and word[1] in WRAPPERS:
                own = body(lines, i)
                inner = _peeled(re.sub(r"^[^=]*=\s*", "", "\n".join(own), count=1))
                if inner and has_markup(inner.split("\n")) and re.fullmatch(r"[A-Z][A-Za-z0-9]*", m[1]):
                    add(m[1], i, own, False, min(least, 1))
            else:
                add(m[1], i, body(lines, i))
        if m := _CLASS.match(line):
            add(m[1], i, body(lines, i))
        if _ANONYMOUS.match(line):
            own = body(lines, i)
            if has_markup(own):
                add("<default>", i, own, False)
        if m := _NESTED.match(raw):
            add(m[1], i, body(lines, i))
    return sorted(out, key=lambda c: c["start_line"])


def returned_markup(lines: list[str]) -> str:
    """What is between the parentheses of the first ``return (``; all lines where there is none."""
    text = "\n".join(lines)
    found = re.search(r"\breturn\s*\(", text)
    depth, start = 0, -1
    for i in range(found.start() if found else len(text), len(text)):
        if text[i] == "(":
            depth += 1
            start = i + 1 if depth == 1 else start
        elif text[i] == ")":
            depth -= 1
            if start >= 0 and not depth:
                return text[start:i].strip()
    return text
