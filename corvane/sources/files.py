"""Files as a table (path, source), filtered before their contents are read."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import any_glob, derive_extensions, ignore_column, in_scopes
from ..functions.text import pruned


def read_text(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """Whole files under a folder, or one file, with paths relative to it; pruned folders are left out.

    Names that begin with ``.`` or ``_`` are hidden from Spark's listing of a folder.
    """
    found = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    local = lambda c: F.regexp_replace(c, r"^file:/*", "/")
    base = re.sub(r"^file:/*", "/", folder.getFileSystem(conf).makeQualified(folder).toString()).rstrip("/") + "/"
    # Names are percent-coded; a plus stands for itself.
    name = F.url_decode(F.replace(local(F.col("_metadata.file_path")), F.lit("+"), F.lit("%2B")))
    path = F.when(name.startswith(base), F.substring(name, len(base) + 1, 1 << 30)).otherwise(F.element_at(F.split(name, "/"), -1))
    files = found.select(path.alias("path"), F.col("value").alias("source")).where(~pruned(F.col("path")))
    return files.where(has_extension(F.col("path"), extensions)) if extensions else files


def ignore_patterns(root: str, name: str | None) -> list[str]:
    """Lines of the ignore file of a folder; none where there is no such file, or no name."""
    try:
        with open(os.path.join(root, name or ""), encoding="utf-8") as f:
            return f.read().splitlines()
    except OSError:
        return []


def has_extension(path: Column, extensions: list[str]) -> Column:
    out = F.lit(False)
    for e in extensions:
        out |= path.endswith(e)
    return out


def from_documents(docs: DataFrame) -> DataFrame:
    """Documents as files: source/lang/doc_id.txt."""
    return docs.select(F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("source"), *[c for c in docs.columns if c not in ("source", "text", "path")])


def scan(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, extensions: list[str] | None = None, scope: list[str] | None = None, ignore: list[str] | None = None, changed: DataFrame | None = None) -> DataFrame:
    """The files of a step: cheap tests first, changed paths by a semi-join last; order is the sink's concern."""
    path = F.col("path")
    if extensions is not None or include:
        files = files.where(has_extension(path, derive_extensions(include, extensions)))
    if scope:
        files = files.where(in_scopes(path, scope))
    if include:
        files = files.where(any_glob(path, include))
    if exclude:
        files = files.where(~any_glob(path, exclude))
    if ignore:
        files = files.where(~ignore_column(path, ignore))
    return files if changed is None else files.join(changed.select("path").distinct(), "path", "left_semi")
