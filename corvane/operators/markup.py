"""Similarity of markup blocks: trees of tags, their tokens, and a greedy match of nodes.

Plain Python without Spark; ``blocks`` runs it in Arrow batches. Scores are not
bounded by 100: a node counts by the harmonic mean of the matched subtrees.
The described measure samples signatures of more than ``LCS_CAP`` signs and cuts
them at ``DEPTH_CAP`` levels; with ``Config.whole``, as Spark's side has it, every
sign and level counts.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from functools import cache, lru_cache
from math import fsum

import numpy as np

LCS_CAP, SUBSTRING_CAP, DEPTH_CAP = 800, 1200, 50
STYLE_CONFIDENCE = 0.4
WEIGHTS = {"structure": 0.5, "style": 0.3, "attr": 0.15, "text": 0.05}
WRAPPERS = frozenset("memo forwardRef lazy observer connect inject withRouter withTheme styled withStyles withTranslation".split())


@dataclass(frozen=True)
class Config:
    style_as: str = "S"
    level: int = 2
    match_mode: str = "key-and-value"
    whitespace: bool = True
    case: bool = True
    identifiers: bool = True
    styles: bool = True
    threshold: float = 0.5
    whole: bool = False


WHOLE = Config(whole=True)


@dataclass(eq=False)
class Node:
    tag: str
    styles: list[tuple[str, str, str | None]] = field(default_factory=list)  # source, key, value
    attrs: list[tuple[str, str | None]] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)

    def size(self) -> int:
        n, todo = 0, [self]
        while todo:
            n += 1
            todo += todo.pop().children
        return n


_NOISE = [re.compile(p) for p in (r"\{/\*[\s\S]*?\*/\}", r"<!--[\s\S]*?-->", r"""\{['"`]\s*['"`]\}""", r"\{\s*\\n\s*\}")]


def clean(src: str) -> str:
    for p in _NOISE:
        src = p.sub("", src)
    return src


def tokens(src: str) -> list[tuple[str, str]]:
    """(kind, raw): open, close, single, text. A tag ends at the first ``>`` outside braces and strings."""
    out, i = [], 0
    while i < len(src):
        if src[i] != "<":
            j = src.find("<", i)
            j = len(src) if j < 0 else j
            if src[i:j].strip():
                out.append(("text", src[i:j]))
        elif src.startswith("<>", i):
            out.append(("open", "<fragment>"))
            j = i + 2
        elif src.startswith("</>", i):
            out.append(("close", "</fragment>"))
            j = i + 3
        else:
            j = _tag_end(src, i)
            raw = src[i:j]
            out.append(("close" if src.startswith("</", i) else "single" if raw.rstrip().endswith("/>") else "open", raw))
        i = j
    return out


def _tag_end(src: str, i: int) -> int:
    depth, quote = 0, ""
    for j in range(i + 1, len(src)):
        c = src[j]
        if quote:
            if c == quote and not (j - 1 > i and src[j - 1] == "\\"):
                quote = ""
        elif c in "\"'`":
            quote = c
        elif c in "{}":
            depth += 1 if c == "{" else -1
        elif c == ">" and not depth:
            return j + 1
    return len(src)


def attributes(text: str) -> list[tuple[str, str | None]]:
    """(key, value) of each attribute; a value in quotes or braces may hold spaces."""
    parts, now, mode, depth = [], "", "", 0
    for i, c in enumerate(text):
        if not mode and c in " \n\t\r":
            parts.append(now)
            now = ""
            continue
        now += c
        if not mode:
            if c in "\"'`{":
                mode, depth = c, 1
        elif mode == "{":
            depth += (c == "{") - (c == "}")
            mode = mode if depth else ""
        elif c == mode and (c == "`" or text[i - 1] != "\\"):
            mode = ""
    out: list[tuple[str, str | None]] = []
    for p in (x.strip() for x in [*parts, now]):
        if p:
            key, eq, value = p.partition("=")
            if any(len(value) > 0 and value.startswith(q) and value.endswith(q) for q in "\"'"):
                value = value[1:-1]
            out.append((key, value if eq else None))
    return out


def _inline(value: str) -> list[tuple[str, str, str | None]]:
    inner = re.sub(r"\s*\}+$", "", re.sub(r"^\{+\s*", "", value))
    out: list[tuple[str, str, str | None]] = []
    for part in inner.split(","):
        key, colon, v = part.partition(":")
        key = re.sub("['\"]", "", key.strip())
        if colon and key:
            out.append(("S", key, re.sub("[;,}]", "", re.sub("['\"]", "", v.strip()))))
    return out


def _order(key: str) -> tuple:
    """Near the order of a dictionary: letters before case."""
    return (key.casefold(), key.swapcase())


def parse_tag(raw: str, style_as: str) -> Node:
    inner = re.sub(r"\s*/?>$", "", re.sub(r"^</?", "", raw))
    found = re.search(r"\s", inner)
    node = Node(inner[: found.start()] if found else inner)
    for key, value in attributes(inner[found.start() + 1 :] if found else ""):
        if key == "style" and "S" in style_as:
            node.styles += _inline(value or "")
        elif key == "className" and "CS" in style_as:
            node.styles += [("CS", c, None) for c in (value or "").split()]
        elif key == "class" and "C" in style_as:
            node.styles += [("C", c, None) for c in (value or "").split()]
        else:
            node.attrs.append((key, value))
    node.styles.sort(key=lambda s: _order(s[1]))
    node.attrs.sort(key=lambda a: _order(a[0]))
    return node


def first_argument(text: str, at: int) -> str | None:
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if text[i] == ")" and not depth:
            return text[at + 1 : i]
    return None


def peel(text: str) -> str | None:
    """The function inside known wrappers; None if there is none."""
    found = re.match(r"(\w+)\s*\(", text)
    if found and found[1] in WRAPPERS:
        inner = first_argument(text, text.index("("))
        return None if inner is None else peel(inner.strip()) or inner.strip()
    return text if "=>" in text or "function" in text else None


def unwrap(src: str) -> str:
    """Body of a component that is assigned through a wrapper; other sources as they are."""
    found = re.match(r"(?:export\s+)?(?:const|let|var)\s+\w+\s*=\s*([\s\S]+)", src)
    right = found[1].strip() if found else ""
    word = re.match(r"\w+", right)
    inner = peel(right) if word and word[0] in WRAPPERS else None
    if not inner:
        return src
    return re.sub(r"^function[^{]*\{([\s\S]*)\}\s*$", r"\1", re.sub(r"^[\s\S]*?=>\s*", "", inner, count=1), count=1)


def tree(src: str, style_as: str = "S") -> Node:
    """Root of a block; a close tag without its open tag is left out."""
    root = Node("root")
    stack = [root]
    for kind, raw in tokens(clean(unwrap(src))):
        if kind == "text":
            stack[-1].text.append(raw.strip())
        elif kind == "close":
            name = re.sub(r"\s*>$", "", re.sub(r"</\s*", "", raw, count=1)).lower()
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag.lower() == name), 0)
            if at:
                del stack[at:]
        else:
            node = parse_tag(raw, style_as)
            stack[-1].children.append(node)
            if kind == "open":
                stack.append(node)
    return root


def _value(v: str | None, c: Config) -> str | None:
    if v is None:
        return None
    v = re.sub(r"\{[^}]*\}", "{EXPR}", v) if c.identifiers else v
    v = re.sub(r"\s+", " ", v).strip() if c.whitespace else v
    return v.lower() if c.case else v


def _key(k: str, c: Config, attr: bool = False) -> str:
    k = k.strip() if c.whitespace else k
    if attr and c.identifiers:
        if re.match("on[A-Z]", k):
            return "HANDLER"
        if k in ("className", "class"):
            return "CLASS"
    return k.lower() if c.case else k


def normal(n: Node, c: Config) -> Node:
    """A copy in normal form; without recursion, as whole pages can nest as deep as they are long."""

    def one(x: Node) -> Node:
        return Node(
            x.tag.lower() if c.case else x.tag,
            [(s, _key(k, c), _value(v, c)) for s, k, v in x.styles],
            [(_key(k, c, True), _value(v, c)) for k, v in x.attrs],
            [t for t in (_value(t, c) for t in x.text) if t],
        )

    out = one(n)
    todo = [(n, out)]
    while todo:
        x, y = todo.pop()
        y.children = [one(k) for k in x.children]
        todo += zip(x.children, y.children, strict=True)
    return out


def _style_token(styles: list[tuple[str, str, str | None]], mode: str) -> str:
    def one(source: str, key: str, value: str | None) -> str:
        if source != "S":
            return "" if mode == "value-only" else f".{key}"
        if mode == "key-only":
            return f"[{key}]"
        return (f"[{value}]" if value else "") if mode == "value-only" else f"[{key}:{value or ''}]"

    return "".join(one(*s) for s in styles)


def _attr_token(attrs: list[tuple[str, str | None]], mode: str) -> str:
    def one(key: str, value: str | None) -> str:
        if mode == "key-only" or (value is None and mode != "value-only"):
            return f"({key})"
        return "" if value is None else f"({value})" if mode == "value-only" else f"({key}={value})"

    return "".join(one(*a) for a in attrs)


def _token(n: Node, level: int, mode: str) -> str:
    return n.tag + (_style_token(n.styles, mode) if level >= 1 else "") + (_attr_token(n.attrs, mode) if level >= 2 else "")


def _joined(n: Node, below: list[str], level: int, mode: str) -> str:
    below = below + ["'" + t.replace("'", "\\'") + "'" for t in n.text] if level == 3 else below
    return f"{_token(n, level, mode)} > {' + '.join(below)}" if below else _token(n, level, mode)


def serial(n: Node, level: int = 2, mode: str = "key-and-value", depth: int = 0) -> str:
    if depth > DEPTH_CAP:
        return n.tag + " > …"
    return _joined(n, [serial(x, level, mode, depth + 1) for x in n.children], level, mode)


def signature(src: str, c: Config = Config()) -> str:
    return " + ".join(serial(x, c.level, c.match_mode) for x in tree(src, c.style_as).children)


def _sampled(s: str) -> str:
    return s if len(s) <= LCS_CAP else s[:: -(-len(s) // LCS_CAP)]


@lru_cache(maxsize=1 << 12)
def _places(a: str) -> dict[str, int]:
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    return where


def _common_prefix(a: str, b: str) -> int:
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        n = (lo + hi + 1) // 2
        lo, hi = (n, hi) if a[lo:n] == b[lo:n] else (lo, n - 1)
    return lo


@lru_cache(maxsize=1 << 15)
def lcs_length(a: str, b: str, whole: bool = False) -> int:
    """Longest common subsequence, by bits of one integer for the rows of the table; what both begin and end with is in it."""
    if not whole:
        a, b = _sampled(a), _sampled(b)
    if a == b:
        return len(a)
    p = _common_prefix(a, b)
    q = _common_prefix(a[p:][::-1], b[p:][::-1])
    n = len(a) - p - q
    full = (1 << n) - 1
    where = {ch: m >> p & full for ch, m in _places(a).items()}
    row = full
    for ch in b[p : len(b) - q]:
        u = row & where.get(ch, 0)
        row = ((row + u) | (row - u)) & full
    return p + q + n - row.bit_count()


def lcs_similarity(a: str, b: str, whole: bool = False) -> float:
    return 2 * lcs_length(a, b, whole) / (len(a) + len(b)) if a or b else 1.0


def substring_length(a: str, b: str) -> int:
    """Longest common substring of the first ``SUBSTRING_CAP`` signs, or of the shorter length, by halving on the length."""
    cap = min(len(a), len(b), SUBSTRING_CAP)
    a, b, lo, hi = a[:cap], b[:cap], 0, cap
    while lo < hi:
        n = (lo + hi + 1) // 2
        seen = {a[i : i + n] for i in range(cap - n + 1)}
        if any(b[i : i + n] in seen for i in range(cap - n + 1)):
            lo = n
        else:
            hi = n - 1
    return lo


def substring_similarity(a: str, b: str) -> float:
    return 2 * substring_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def _share(a: set, b: set) -> float:
    return len(a & b) / max(len(a), len(b))


def attr_similarity(a: list, b: list) -> float:
    return _share(set(a), set(b)) if a or b else 0.0


def style_similarity(a: list, b: list) -> tuple[float, bool]:
    """Mean over the sources of styles, weighted by size, and whether it is sure enough to count."""
    sources = dict.fromkeys(s[0] for s in [*a, *b])
    if not sources:
        return 1.0, False
    total, size = 0.0, 0
    for s in sources:
        x, y = [e[1:] for e in a if e[0] == s], [e[1:] for e in b if e[0] == s]
        size += max(len(x), len(y))
        total += _share(set(x), set(y)) * max(len(x), len(y))
    return total / size, total / size >= STYLE_CONFIDENCE


@cache
def weights(level: int) -> dict[str, float]:
    names = ["structure"] + ["style"] * (level >= 1) + ["attr"] * (level >= 2) + ["text"] * (level == 3)
    total = sum(WEIGHTS[n] for n in names)
    return {n: WEIGHTS[n] / total for n in names}


def structure_similarity(a: str, b: str, whole: bool = False) -> float:
    """The greater of both; a common substring is a common subsequence, so only sampled texts need the former."""
    out = lcs_similarity(a, b, whole)
    return out if whole or max(len(a), len(b)) <= LCS_CAP else max(out, substring_similarity(a, b))


def node_score(a: Node, b: Node, sig_a: str, sig_b: str, c: Config, least: float = 0.0) -> float:
    """Score of two nodes; 0 if the lengths of their signatures already keep it below ``least``."""
    w = weights(c.level)
    style, sure = style_similarity(a.styles, b.styles) if c.styles else (0.0, False)
    parts = [w.get("style", 0) * (style if sure else 0.0)]
    parts.append(w["attr"] * attr_similarity(a.attrs, b.attrs) if "attr" in w else 0.0)
    parts.append(w["text"] * lcs_similarity(" ".join(a.text), " ".join(b.text), c.whole) if "text" in w else 0.0)
    most = 2 * min(len(sig_a), len(sig_b)) / (len(sig_a) + len(sig_b)) if sig_a or sig_b else 1.0
    if w["structure"] * most + sum(parts) < least - 1e-9:
        return 0.0
    out = w["structure"] * structure_similarity(sig_a, sig_b, c.whole)
    for p in parts:
        out += p
    return out


def nodes(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.tag != "root":
            out.append(n)
        todo += reversed(n.children)
    return out


Prepared = tuple[list[int], list[int], list[tuple[str, tuple, tuple, str]]]


def prepared(src: str, c: Config = Config()) -> Prepared:
    """Of each node its subtree's size and the number of its kind; and the kinds: signature, styles, attributes, text.

    Nodes of one kind agree in all that node_score looks at, so blocks that are
    equal here have equal scores with any third.
    """
    all_, known, kinds = nodes(normal(tree(src, c.style_as), c)), {}, []
    size, whole, kind = {}, {}, []
    for n in reversed(all_):  # children come before their parents
        size[id(n)] = 1 + sum(size[id(x)] for x in n.children)
        if c.whole:
            whole[id(n)] = _joined(n, [whole[id(x)] for x in n.children], c.level, c.match_mode)
    for n in all_:
        sig = whole[id(n)] if c.whole else serial(n, c.level, c.match_mode)
        key = (sig, tuple(n.styles), tuple(n.attrs), " ".join(n.text) if c.level == 3 else "")
        if key not in known:
            known[key] = len(kinds)
            kinds.append(key)
        kind.append(known[key])
    return [size[id(n)] for n in all_], kind, kinds


_prepared = lru_cache(maxsize=256)(prepared)
_BINS = 64


def _bag(kinds: list[tuple]) -> np.ndarray:
    return np.array([np.bincount(np.frombuffer(k[0].encode("utf-32-le"), "<u4") % _BINS, minlength=_BINS) for k in kinds], "int32").reshape(-1, _BINS)


def near_kinds(a: list[tuple], b: list[tuple], c: Config = Config()) -> list[dict[int, float]]:
    """For each kind of a, the kinds of b that reach the threshold, and their scores.

    Two signatures have no longer subsequence in common than the signs that they
    share, in any order. Kinds without a common style or attribute have to reach
    the threshold by that alone, so few are compared in full.
    """
    w = weights(c.level)
    if not a or not b:
        return [{} for _ in a]
    as_node = lambda k: Node("", list(k[1]), list(k[2]), [k[3]] if k[3] else [])
    nodes_a, nodes_b = [as_node(k) for k in a], [as_node(k) for k in b]
    sharing: dict[tuple, list[int]] = defaultdict(list)
    for y, k in enumerate(b):
        for e in {*k[1], *k[2]}:
            sharing[e].append(y)
    bag_a, bag_b = _bag(a), _bag(b)
    length = bag_b.sum(1)
    order = np.argsort(length, kind="stable")
    ordered, bags = length[order], bag_b[order]
    # A sampled text may have a longer common substring than the sample's subsequence; both are bounded by the signs of the whole texts.
    alone = (c.threshold - w.get("text", 0.0) - 1e-9) / w["structure"]
    helped = alone - (w.get("style", 0.0) + w.get("attr", 0.0)) / w["structure"]
    out = []
    for x, k in enumerate(a):
        n = int(bag_a[x].sum())
        # 2 * min / (n + m) is least at the ends of the range of lengths.
        lo, hi = (0, len(b)) if alone <= 0 or not n else (np.searchsorted(ordered, int(n * alone / 2)), np.searchsorted(ordered, int(n * 2 / alone) + 1, "right"))
        common = np.minimum(bag_a[x], bags[lo:hi]).sum(1)
        found = set(order[lo:hi][2 * common >= alone * (n + ordered[lo:hi])].tolist())
        if shared := {y for e in {*k[1], *k[2]} for y in sharing.get(e, ())} - found:
            ys = np.fromiter(shared, "int64", len(shared))
            found.update(ys[2 * np.minimum(bag_a[x], bag_b[ys]).sum(1) >= helped * (n + length[ys])].tolist())
        row = {}
        for y in found:
            if (s := node_score(nodes_a[x], nodes_b[y], k[0], b[y][0], c, c.threshold)) >= c.threshold:
                row[y] = s
        out.append(row)
    return out


def places(kind: list[int]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, k in enumerate(kind):
        out.setdefault(k, []).append(i)
    return out


def match(size_a: list[int], at_a: dict[int, list[int]], size_b: list[int], at_b: dict[int, list[int]], near: list[dict[int, float]]) -> int:
    """Scores of greedily matched nodes, weighted by their subtrees, over all nodes. The same for a and b exchanged."""
    scored = []
    for x, ii in at_a.items():
        row = near[x]
        for y in row.keys() & at_b.keys():
            s, jj = -row[y], at_b[y]
            scored += [(s, i, j) for i in ii for j in jj]
    scored.sort()
    used_a, used_b, terms = set(), set(), []
    for s, i, j in scored:
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            m, n = size_a[i], size_b[j]
            terms.append(-s * (2 * m * n / (m + n)))
    return int(fsum(terms) / max(len(size_a) + len(size_b), 1) * 100 + 0.5)


def compare(src_a: str, src_b: str, c: Config = Config()) -> int:
    """Confidence of two blocks."""
    (size_a, kind_a, a), (size_b, kind_b, b) = _prepared(src_a, c), _prepared(src_b, c)
    return match(size_a, places(kind_a), size_b, places(kind_b), near_kinds(a, b, c))
