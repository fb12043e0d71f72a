"""Sources mixed to target weights by a low-discrepancy schedule.

Texts count in tokens, which are runs of other than space, tab, newline and
carriage return (white space after a token, and before a text's first, belongs to it).
Within each source, documents are put in a random order by hash, and their
tokens, one after another, are cut into blocks of ``block`` tokens; a source's
last block may be shorter. Slot t of the schedule takes the point
t * 1327217885 mod 2**31 (the golden ratio in whole numbers), and the source whose stretch
of the cumulative weights holds it; the source's r-th slot takes a block of epoch
r // blocks: the r-th in epoch 0, and later, when all blocks have been taken,
that at r * prime + shift mod blocks, where prime and shift belong to the epoch. So
every stretch of the schedule has the sources in nearly the target shares, and
every epoch all blocks once in an order of its own.

There are as many slots as blocks, unless ``slots`` says otherwise. Weights are by
default the square roots of the sources' tokens, which lifts small sources. Shares
are exact to 2**-31 of the schedule.

Result: one row per piece of a document in a slot: slot, source, block, epoch,
place (of the piece in its block, from 0), doc_id, start_word, end_word, and the other
columns of the documents, ``text`` being the piece. The pieces of a document join to its
text, and those of a block, by place, to the block's tokens.

No task holds a whole source: running sums are of two levels, stretches of the
weights meet points by equal high bits, and the slots of a block go in parts of at most ``USES``.

Defined cases: null doc_id: row ignored; ids of any type. Null source: a source of its own, the
empty name. Null or empty texts, or texts without tokens: one piece of no tokens in
the block that is open at their place in the order. Sources without tokens have no blocks and
get no slots; if there are none at all the result is empty. Equal texts and ties
of the hash: ordered by doc_id. Repeated rows of one doc_id: the first by a hash of the text
counts. Columns of the documents named like the result's are replaced, other columns keep their names. Weights given for
absent sources, zero or less count as none; sources without a weight get none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cluster import cut, hot_join

BLOCK, SEED, GOLDEN, RANGE = 1024, 5, 1327217885, 1 << 31
#: Rows of one source whose running sums one task adds up; slots of a block that travel in one row.
BUCKET_ROWS, USES = 1_000_000, 256
#: Stretches of weights are cut at multiples of RANGE / CELLS, to meet the points of the same cell.
CELLS = 1 << 12
PRIMES = (134217689, 134217649, 134217617, 134217613, 134217593, 134217541, 134217529, 134217509)
WORD = r"[^ \t\n\r]+"
PIECE = r"(^[ \t\n\r]*)?[^ \t\n\r]+[ \t\n\r]*"


def order_key(value: Column, seed: int = SEED) -> Column:
    """32 bits of the md5 of seed and value: the random order of documents in a source, and of sources."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), value.cast("string"))), 1, 8), 16, 10).cast("long")


def _running(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, rows: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the same keys, in two levels, so that no key is one task's.

    order[0] has to be spread over 32 bits.
    """
    buckets = rows // bucket_rows + 1
    df = df.withColumn("at_bucket", F.floor(F.col(order[0]) * F.lit(buckets) / F.lit(1 << 32)))
    sums = df.groupBy(*keys, "at_bucket").agg(F.sum(value).alias("own"))
    before = W.partitionBy(*keys).orderBy("at_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("own").over(before), F.lit(0))).drop("own")
    within = W.partitionBy(*keys, "at_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    # The window has put the rows where the join wants them.
    return df.withColumn(name, F.coalesce(F.sum(value).over(within), F.lit(0))).join(sums, [*keys, "at_bucket"]).withColumn(name, F.col(name) + F.col("base")).drop("at_bucket", "base")


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """Weights above zero in parts of 2**50, one at least."""
    over = {k: float(v) for k, v in weights.items() if v > 0}
    return {k: max(1, round(v / sum(over.values()) * 2**50)) for k, v in over.items()}


def stretches(totals: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """(source, blocks, lo, hi) of (source, words, blocks): the points lo <= x < hi are the source's."""
    if weights is None:
        w = F.floor(F.sqrt(F.col("words").cast("double")) * 1000).cast("long")
    else:
        given = totals.sparkSession.createDataFrame(list(whole_weights(weights).items()), "source string, w long")
        totals, w = totals.join(given, "source"), F.col("w")
    rows = cut(totals.where("words > 0").select("source", "blocks", w.alias("w")).where("w > 0").withColumn("key", order_key(F.col("source"), 0)).withColumn("one", F.lit(0)))
    n, total = rows.agg(F.count(F.lit(1)), F.sum("w")).first()
    upto = _running(rows, ["one"], ["key", "source"], "w", "upto", n)
    edge = lambda x: F.floor(x.cast("double") / F.lit(total or 1) * RANGE).cast("long")
    return cut(upto.select("source", "blocks", edge(F.col("upto")).alias("lo"), edge(F.col("upto") + F.col("w")).alias("hi")))


def epoch_block(rank: Column, blocks: Column, seed: int = SEED) -> tuple[Column, Column]:
    """(block, epoch) of a source's slot of that rank."""
    epoch = F.floor(rank / blocks)
    nth = rank % blocks
    # A prime that blocks is no multiple of; no table has as many blocks as the product of two.
    pick = lambda k: F.element_at(F.array(*[F.lit(p) for p in PRIMES]), (F.pmod(epoch + k, F.lit(len(PRIMES))) + 1).cast("int"))
    prime = F.when(blocks % pick(0) == 0, pick(1)).otherwise(pick(0))
    return F.when(epoch == 0, nth).otherwise((nth * prime + order_key(epoch, seed)) % blocks), epoch


def schedule(totals: DataFrame, weights: dict[str, float] | None, slots: int | None, seed: int = SEED) -> DataFrame:
    """(slot, source, block, epoch) from (source, words, blocks)."""
    spread = stretches(totals, weights)
    have = spread.agg(F.sum("blocks")).first()[0]
    many = 0 if have is None else have if slots is None else slots
    wide = RANGE // CELLS
    cells = spread.where("lo < hi").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / wide), F.floor((F.col("hi") - 1) / wide))))
    point = F.pmod(F.pmod(F.col("id"), F.lit(RANGE)) * F.lit(GOLDEN), F.lit(RANGE))
    points = totals.sparkSession.range(many).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", F.floor(F.col("point") / wide))
    placed = points.join(cells, "cell").where("point >= lo and point < hi").select("slot", "source", "blocks")
    # Rank within the source: running counts, in two levels by stretches of slots.
    at = F.floor(F.col("slot") * F.lit(float(1 << 32)) / F.lit(float(max(many, 1)))).cast("long")
    ranked = _running(placed.withColumn("at", at).withColumn("unit", F.lit(1).cast("long")), ["source"], ["at", "slot"], "unit", "rank", many)
    block, epoch = epoch_block(F.col("rank"), F.col("blocks"), seed)
    return ranked.select("slot", "source", block.alias("block"), epoch.alias("epoch"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, slots: int | None = None, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    made = ("slot", "source", "block", "epoch", "place", "doc_id", "start_word", "end_word", "text")
    rest = [c for c in docs.columns if c.lower() not in {*made, id_col.lower(), text_col.lower(), source_col.lower()}]
    # Other columns travel in one of their own, so that none can be taken for a helper.
    others = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(0)
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(F.col(f"`{source_col}`"), F.lit("")).alias("source"), others.alias("others")).where("doc_id is not null")
    docs = docs.withColumn("mark", F.xxhash64("text", "source"))
    counted = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n"), "mark")
    counted = counted.groupBy("doc_id").agg(F.min(F.struct("mark", "source", "n")).alias("x")).select("doc_id", "x.source", F.col("x.n").alias("words"), "x.mark").withColumn("key", order_key(F.col("doc_id"), seed))
    counted = cut(counted)
    totals = counted.groupBy("source").agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("words") / F.lit(block)).cast("long"))
    totals = cut(totals)
    laid = _running(counted, ["source"], ["key", "doc_id"], "words", "begin", counted.count())
    # The last open block of a source takes what has no tokens and comes after its last token.
    last = F.greatest(F.col("blocks") - 1, F.lit(0))
    first_block = F.least(F.floor(F.col("begin") / F.lit(block)), last)
    last_block = F.least(F.floor((F.col("begin") + F.greatest(F.col("words") - 1, F.lit(0))) / F.lit(block)), last)
    pieces = hot_join(laid, totals.where("words > 0").select("source", "blocks", "n"), ["source"], "doc_id").withColumn("block", F.explode(F.sequence(first_block, last_block)))
    in_block = W.partitionBy("source", "block").orderBy("key", "doc_id")
    pieces = pieces.select(
        "doc_id", "mark", "words", "source", "block", (F.row_number().over(in_block) - 1).cast("long").alias("place"),
        F.greatest(F.col("block") * block - F.col("begin"), F.lit(0)).alias("start_word"), F.least((F.col("block") + 1) * block - F.col("begin"), F.col("words")).alias("end_word"),
    )
    plan = schedule(totals, weights, slots, seed)
    # The slots of one block travel together, so that its text is cut and sent once.
    uses = plan.groupBy("source", "block", F.floor(F.col("epoch") / USES).alias("part")).agg(F.collect_list(F.struct("slot", "epoch")).alias("uses"))
    wanted = pieces.join(uses, ["source", "block"])
    by_doc = wanted.groupBy("doc_id", "mark", "part").agg(F.collect_list(F.struct("block", "place", "uses", "start_word", "end_word", "words")).alias("pieces"))
    lead = docs.join(by_doc, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark", "part"])
    # A document whose text is needed whole is not taken apart.
    whole = F.expr("size(pieces) = 1 and pieces[0].end_word - pieces[0].start_word = pieces[0].words")
    named = lambda x, text: F.struct(*[x[c].alias(c) for c in ("block", "place", "uses", "start_word", "end_word")], text.alias("text"))
    taken = lambda w, x: F.array_join(F.slice(w, (x["start_word"] + 1).cast("int"), (x["end_word"] - x["start_word"]).cast("int")), "")
    # The variable of a lambda is evaluated once, whatever number of pieces is taken of it.
    parts = F.transform(F.array(F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))), lambda w: F.transform("pieces", lambda x: named(x, F.when(x["words"] > 0, taken(w, x)))))
    cut_up = F.when(whole, F.transform("pieces", lambda x: named(x, F.col("text")))).otherwise(F.get(parts, F.lit(0)))
    out = lead.select("doc_id", "source", "others", F.explode(cut_up).alias("piece")).withColumn("use", F.explode("piece.uses"))
    return out.select("use.slot", "source", "piece.block", "use.epoch", "piece.place", "doc_id", "piece.start_word", "piece.end_word", "piece.text", *[F.col(f"others.`{c}`").alias(c) for c in rest])
