"""Lines of texts, and the lines that suppression blocks cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.globs import java_escape
from ..functions.text import SPACES, trim
from ..model import MARKER


def explode_lines(files: DataFrame, path: str = "path", source: str = "source") -> DataFrame:
    """(path, line, text), lines counted from 1; a newline at the end opens an empty last line."""
    return files.select(F.col(path).alias("path"), F.posexplode(F.split(source, "\n", -1)).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")


def beyond_directive(line: Column, marker: str = MARKER) -> Column:
    """Whether a trimmed line holds more than comments with a directive."""
    which = f"({java_escape(marker)}-start|{java_escape(marker)}-end)"
    bare = F.regexp_replace(line, rf"\{{\s*/\*\s*-*\s*{which}\s*-*.*?\*/\s*\}}", "")
    bare = F.regexp_replace(bare, rf"(?<!\{{)\s*/\*\s*-*\s*{which}\s*-*.*?\*/\s*(?!\}})", "")
    bare = F.regexp_replace(bare, rf"//\s*-*\s*{which}\s*-*.*\z", "")
    return trim(bare) != ""


def suppressed(lines: DataFrame, marker: str = MARKER) -> DataFrame:
    """lines with ``is_ignored``.

    A line with a start opens a block, unless it also has an end; a line with an
    end closes it; blocks don't nest and an open one runs to the end of the
    text. Lines within are ignored; of directive lines those that hold code
    too, at an end only if a block was open. One sort by (path, line), which
    lines of a file already share a task for.
    """
    start, end = F.col("text").contains(f"{marker}-start"), F.col("text").contains(f"{marker}-end")
    state = F.when(start & end, F.lit(False)).when(start, F.lit(True)).when(end, F.lit(False))
    before = W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    was_open = F.coalesce(F.last(state, ignorenulls=True).over(before), F.lit(False))
    code = beyond_directive(trim(F.col("text")), marker)
    return lines.withColumn("__open", was_open).withColumn("is_ignored", F.when(start, code).when(end, F.col("__open") & code).otherwise(F.col("__open"))).drop("__open")


def loc(lines: DataFrame, comments: bool = False, blanks: bool = False, block_comments: bool = False) -> DataFrame:
    """(path, loc): lines of code, by a state that runs through block comments.

    A comment opens where a line outside one begins with its sign, and closes
    at the first line that holds the closing sign, its own included.
    """
    texts = lines.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("ls"))
    return texts.select("path", _loc(F.col("ls.text"), comments, blanks, block_comments).alias("loc"))


def loc_of_files(files: DataFrame, comments: bool = False, blanks: bool = False, block_comments: bool = False, path: str = "path", source: str = "source") -> DataFrame:
    """The same for files, each text folded where it is read: only (path, loc) is shuffled. Texts of one path are added up."""
    each = files.where(F.col(source).isNotNull()).select(F.col(path).alias("path"), _loc(F.split(source, "\n", -1), comments, blanks, block_comments).alias("loc"))
    return each.groupBy("path").agg(F.sum("loc").cast("int").alias("loc"))


def _loc(texts: Column, comments: bool, blanks: bool, block_comments: bool) -> Column:
    # The first two signs of a line and whether it closes a comment are all that counts; they are taken once a line.
    seen = F.transform(texts, lambda t: F.struct(F.substring(F.ltrim(t, F.lit(SPACES)), 1, 2).alias("head"), t.contains("*/").alias("closes")))
    zero = F.struct(F.lit(0).alias("n"), F.lit(False).alias("inside"))
    return F.aggregate(seen, zero, lambda acc, line: _loc_step(acc, line, comments, blanks, block_comments)).n


def _loc_step(acc: Column, line: Column, comments: bool, blanks: bool, block_comments: bool) -> Column:
    covered = acc.inside | (line.head == "/*")
    one = lambda yes: acc.n + F.lit(int(yes))
    n = F.when(covered, one(block_comments)).when(line.head == "", one(blanks)).when(line.head == "//", one(comments)).otherwise(one(True))
    return F.struct(n.alias("n"), (covered & ~line.closes).alias("inside"))
