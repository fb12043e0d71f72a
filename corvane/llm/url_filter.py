"""Pages whose URL is listed: a blocked Bloom filter first, then an exact join.

A canonical URL is the URL without scheme, user, port, query and fragment, in
lower case, without ``www.`` and ``m.`` in front of the host, without ``.html`` or
``.htm`` and slashes at its end, and with one slash after the host. A list may hold single
pages or all under a host or directory: a URL is looked up as itself, as each
of its directories (ending in a slash) and as the root of each domain above its
host that has a dot in it.

The filter has blocks of 256 bits, one of 32 in each of 8 words per listed URL,
as in Parquet's. It is built in Spark (a bitwise or per block) and sent to the
executors if its blocks number at most ``BROADCAST_BLOCKS``; a longer list's
filter is joined by block number instead. What it passes meets the list in a
join on the URL itself, so false positives go.

Result: one row (page_id, url, canonical_url, listed_url) per row of pages that
is listed, with the longest entry that it falls under, the least among equals.
Defined cases: null or empty url, or one without a host: not listed. Null,
empty and repeated entries of the list count once or not at all. Repeated rows
of pages: a row each. Null page_id: kept, as null. Other columns are ignored.
Empty tables: empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_URL, BROADCAST_BLOCKS = 12, 1 << 21  # 64 MB
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)


def canonical(url: Column) -> Column:
    """Canonical form; empty where there is no host."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://", "")
    bare = F.regexp_replace(bare, r"[?#].*$", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^[^/]*", 0), r"^.*@", ""), r":[0-9]*$", "")
    host = F.regexp_replace(host, r"^(www\.|m\.)+", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"/.*$", 0), r"\.html?$", ""), r"^/+|/+$", "")
    return F.when(host == "", F.lit("")).otherwise(F.concat(host, F.lit("/"), path))


def entry(url: Column) -> Column:
    """Canonical form of an entry of a list: a slash at its end makes it a directory."""
    plain = canonical(url)
    return F.when(F.trim(url).endswith("/") & ~plain.endswith("/") & (plain != ""), F.concat(plain, F.lit("/"))).otherwise(plain)


def lookups(url: Column) -> Column:
    """What a canonical URL is looked up as."""
    host = F.substring_index(url, "/", 1)
    parts = F.split(url, "/")
    n = F.size(parts)
    directories = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))
    labels = F.split(host, r"\.")
    count = F.size(labels)
    domains = F.when(count > 2, F.transform(F.sequence(F.lit(2), F.greatest(count - 1, F.lit(2))), lambda k: F.concat(F.array_join(F.slice(labels, k, count), "."), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(url), directories, domains))


def _bit(low: Column, salt: int) -> Column:
    place = F.shiftright((low * F.lit(salt)).bitwiseAND(0xFFFFFFFF), 27).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def filter_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7) of the filter over column ``entry``."""
    h = listed.select(F.xxhash64("entry").alias("h"))
    low = F.col("h").bitwiseAND(0x7FFFFFFF)
    words = [_bit(low, s) for s in SALTS]
    return h.select(F.pmod(F.shiftright("h", 32), F.lit(blocks)).alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)]).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)])


def listed_pages(pages: DataFrame, urls: DataFrame, url_col: str = "url", list_col: str = "url", id_col: str = "page_id", bits: int = BITS_PER_URL, broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    listed = urls.select(entry(F.col(list_col)).alias("entry")).where("entry is not null and entry <> ''").distinct()
    many = listed.count()
    blocks = max(1, -(-many * bits // 256))
    table = filter_blocks(listed, blocks)
    asked = (
        pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
        .withColumn("canonical_url", canonical(F.col("url")))
        .where("canonical_url <> ''")
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("entry", F.explode(lookups(F.col("canonical_url"))))
        .withColumn("h", F.xxhash64("entry"))
    )
    if blocks <= broadcast_blocks:
        got = table.toPandas()
        bitmap = np.zeros((blocks, 8), dtype=np.uint32)
        bitmap[got["block"].to_numpy()] = got[[f"w{i}" for i in range(8)]].to_numpy().astype(np.uint32)
        shared = pages.sparkSession.sparkContext.broadcast(bitmap)

        @F.pandas_udf("boolean")
        def maybe(h: pd.Series) -> pd.Series:
            return pd.Series(may_contain(shared.value, h.to_numpy()))

        passed = asked.where(maybe("h"))
    else:
        low = F.col("h").bitwiseAND(0x7FFFFFFF)
        ok = F.lit(True)
        for i, s in enumerate(SALTS):
            ok &= F.col(f"w{i}").bitwiseAND(_bit(low, s)) != 0
        passed = asked.withColumn("block", F.pmod(F.shiftright("h", 32), F.lit(blocks))).join(table, "block").where(ok)
    best = F.min(F.struct((-F.length("entry")).alias("n"), "entry", "page_id", "url", "canonical_url"))
    return passed.join(listed, "entry").groupBy("row").agg(best.alias("x")).select("x.page_id", "x.url", "x.canonical_url", F.col("x.entry").alias("listed_url"))


def may_contain(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each 64-bit hash may have been listed."""
    rows = bitmap[np.mod(h >> 32, len(bitmap))]
    low = (h & 0x7FFFFFFF).astype(np.uint64)
    out = np.ones(len(h), dtype=bool)
    for i, s in enumerate(SALTS):
        bit = ((low * np.uint64(s)) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
        out &= (rows[:, i] >> bit.astype(np.uint32)) & 1 == 1
    return out
