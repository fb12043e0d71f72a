"""Scalar functions on text, with the white space and end-of-text rules of the rule language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space beyond ASCII counts too.
SPACE = r"[\s\x{00A0}\x{FEFF}\x{2028}\x{2029}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
#: The same white space, sign by sign.
SPACES = " \t\n\x0b\f\r\u00a0\ufeff\u2028\u2029\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def fingerprint(head: Column, status: Column) -> Column:
    """First 16 hex digits of the hash of head, newline and status."""
    return F.substring(F.sha2(F.concat_ws("\n", head, status), 256), 1, 16)


def safe_branch(name: Column) -> Column:
    bare = F.coalesce(trim(name), F.lit(""))
    return F.when(bare == "", "unknown").otherwise(F.regexp_replace(bare, r"[^A-Za-z0-9._-]+", "_"))


def short_head(head: Column) -> Column:
    return F.when(F.coalesce(head, F.lit("")) == "", "unknown").otherwise(F.substring(head, 1, 7))


def collapse(text: Column) -> Column:
    """Every run of white space one space, none at the ends."""
    return trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def csv_items(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), trim), lambda x: x != "")


def flag(text: Column) -> Column:
    """true, 1 and yes in any case are true; all else, null too, is false."""
    return F.coalesce(F.lower(trim(text)).isin("true", "1", "yes"), F.lit(False))


def key_value(text: Column) -> Column:
    """(key, value) at the first equals sign; null without one."""
    at = F.instr(text, "=")
    return F.when(at > 0, F.struct(trim(F.substring(text, F.lit(1), at - 1)).alias("key"), F.substring(text, at + 1, F.length(text)).alias("value")))


def positive_int(text: Column, fallback: int) -> Column:
    """Whole numbers above zero, in decimal, exponent or hexadecimal notation; else the fallback."""
    bare = trim(text)
    number = F.when(bare.rlike(r"^0[xX][0-9a-fA-F]{1,8}\z"), F.conv(F.substring(bare, F.lit(3), F.length(bare)), 16, 10).try_cast("double")).otherwise(bare.try_cast("double"))
    return F.when((number > 0) & (number == F.floor(number)), number.cast("long")).otherwise(F.lit(fallback).cast("long"))


def length_ratio(a: Column, b: Column) -> Column:
    """Shorter over longer; null for two empty texts."""
    return F.try_divide(F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b)))


def root_segment(path: Column) -> Column:
    return F.substring_index(F.translate(path, "\\", "/"), "/", 1)


def line_of(source: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    head = F.substring(source, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"))) + 1


def camel(name: Column) -> Column:
    parts = F.split(name, "_")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p))))
    return F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))


def common_folder(a: Column, b: Column, otherwise: str) -> Column:
    """The folder ``shared`` under the paths' common segments, if there are two or more."""
    x, y = F.split(F.translate(a, "\\", "/"), "/"), F.split(F.translate(b, "\\", "/"), "/")
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.lit(True).alias("same"))
    step = lambda acc, p: F.when(acc.same & p.x.eqNullSafe(p.y), F.struct(F.array_append(acc.seen, p.x).alias("seen"), F.lit(True).alias("same"))).otherwise(F.struct(acc.seen.alias("seen"), F.lit(False).alias("same")))
    pairs = F.zip_with(x, y, lambda p, q: F.struct(p.alias("x"), q.alias("y")))
    seen = F.aggregate(pairs, start, step).seen
    return F.when(F.size(seen) >= 2, F.concat(F.array_join(seen, "/"), F.lit("/shared/"))).otherwise(F.lit(otherwise))


def porcelain_path(line: Column) -> Column:
    """Path of a status line: three characters off, the target of a rename, forward slashes."""
    path = trim(F.substring(line, F.lit(4), F.length(line)))
    return F.translate(F.element_at(F.split(path, " -> "), -1), "\\", "/")


_PRUNED = tuple("build coverage dist node_modules storybook-static __pycache__ __tests__ .cache .git .next .parcel-cache .turbo .vite .vite-temp".split())


def pruned(path: Column, names: tuple[str, ...] = _PRUNED) -> Column:
    """A folder above the file, under the root, is of the pruned ones."""
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.isin(*names))


def infrastructure(path: Column, parts: tuple[str, ...]) -> Column:
    """One of the parts is in the path, or a segment begins with a dot without being a script."""
    path = F.translate(path, "\\", "/")
    dotted = F.exists(F.split(path, "/"), lambda p: p.startswith(".") & ~p.contains(".ts") & ~p.contains(".js"))
    out = dotted
    for p in parts:
        out |= path.contains(p)
    return out
