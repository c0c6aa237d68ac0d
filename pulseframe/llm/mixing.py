"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

Every source has a stream: its documents in the order of md5(id), repeated as often as needed, cut into blocks of
equally many words. Sources lie one behind another on a line of points, one point a block. The van der Corput sequence
maps slots to points: with 2 ** bits points, slot and point have each other's bits in reverse, so a source of so many
points has exactly as many slots, and any run of slots meets every source in proportion. The r-th slot of a source takes
block r of its stream; slots whose point lies behind the last source stay empty. The last block of a source is cut at
its target, so a source's words equal its target to rounding, however small the source. All of it is whole numbers.

Targets share all words by weight (5, 2, 1, repeating over the sources by code point, null last). A target stops at
`cap` times its source's size; the excess is shared by weight among the others until none is above.

A null text has size 0, a null id counts as ''; such documents and empty ones take nothing. Repeated rows count as rows
of their own; rows of one id and size are interchangeable. An empty table gives an empty result. Only id, text and source
are read; other columns and their names don't matter, nor does the length of a text. One hot source is no hot key:
positions and ranks are sums over (source, hash range) and (source, slot range) plus offsets. The sources' own table, a
row each, is ordered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.llm.common import word_count, written

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
BLOCK_WORDS = 1024  #: words in a block at most
LEAST_BLOCKS = 1024  #: blocks in a source's target, unless it has fewer words
HASH_RANGES = 4096
SLOT_RANGE = 1 << 16  #: slots ranked, and points made, at once
BROADCAST_SOURCES = 100_000  #: up to so many sources, their rows of five numbers are broadcast
#: Masks that swap neighbouring bits, pairs, fours, bytes and halves of words.
SWAPS = ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF))


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sized(source, size) -> one row per source: sid (rank by code point, null last), source, source_size, target."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    totals = totals.withColumn("sid", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    totals = totals.withColumn("most", (cap * F.col("source_size")).cast("double")).withColumn("total", F.sum("source_size").over(everything).cast("double"))
    # Sources reach their cap in the order of most / weight. If those before one have stopped, the others share by level.
    stops = Window.orderBy(F.col("most") / F.col("weight"), "sid")
    totals = totals.withColumn("before", F.coalesce(F.sum("most").over(stops.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    totals = totals.withColumn("left", F.sum("weight").over(stops.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.col("total") - F.col("before")) / F.col("left")
    level = F.when(level * F.col("weight") <= F.col("most"), F.struct((F.col("most") / F.col("weight")).alias("at"), F.col("sid").alias("sid"), level.alias("level")))
    totals = totals.withColumn("level", F.min(level).over(everything)["level"])
    return totals.select("sid", "source", "source_size", F.least("most", F.col("level") * F.col("weight")).alias("target"))


def slot_of(point: Column, bits: int) -> Column:
    """The bits of a number in reverse order."""
    x = point
    for n, mask in SWAPS:
        x = F.shiftrightunsigned(x, n).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(mask)), n))
    return F.shiftrightunsigned(x, 64 - bits)


def schedule(sources: DataFrame, bits: int) -> DataFrame:
    """sources(sid, low, blocks), each with the points low to low + blocks - 1 of 2 ** bits -> slot, sid, rank: for every
    slot that a source takes, how many it took before."""
    taken = sources.where("blocks > 0").withColumn("high", F.col("low") + F.col("blocks"))
    chunks = taken.select("sid", "low", "high", F.explode(F.expr(f"sequence(low div {SLOT_RANGE}, (high - 1) div {SLOT_RANGE})")).alias("chunk")).repartition("sid", "chunk")
    points = chunks.select("sid", F.explode(F.expr(f"sequence(greatest(low, chunk * {SLOT_RANGE}), least(high, (chunk + 1) * {SLOT_RANGE}) - 1)")).alias("point"))
    dealt = points.select(slot_of(F.col("point"), bits).alias("slot"), "sid").withColumn("span", F.expr(f"slot div {SLOT_RANGE}"))
    counts = dealt.groupBy("span", "sid").agg(F.count("*").alias("n"))
    earlier = counts.withColumn("earlier", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = dealt.withColumn("within", F.row_number().over(Window.partitionBy("span", "sid").orderBy("slot")) - 1)
    return within.join(earlier.drop("n"), ["span", "sid"]).select("slot", "sid", (F.col("within") + F.col("earlier")).alias("rank"))


def placements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, cap: int = CAP, block_words: int = BLOCK_WORDS, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """The mix, block by block: a row for each block that a turn of a document touches, with slot and part (words of the
    document in it), and one with null for a document that isn't taken. sid, range and row name the row of docs; doc_id,
    size, source_size, target and start (its place in its source's stream) are the document's."""
    sized = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    plan = source_targets(sized, weights, cap).withColumn("words", F.least(F.round("target").cast("long"), cap * F.col("source_size")))
    plan = plan.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block_words), F.expr(f"words div {LEAST_BLOCKS}"))).cast("long"))
    plan = plan.withColumn("blocks", F.expr("(words + block - 1) div block"))
    cumulative = F.sum("blocks").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    plan = written(plan.withColumn("low", cumulative - F.col("blocks")), "sources")
    n_sources, all_blocks = plan.agg(F.count("*"), F.coalesce(F.sum("blocks"), F.lit(0))).first()
    small = F.broadcast if n_sources <= broadcast_sources else lambda x: x

    # Where each document lies in its source's stream.
    named = plan.select(F.col("source").alias("name"), "sid")
    placed = sized.join(small(named), F.col("source").eqNullSafe(F.col("name"))).select("doc_id", "sid", "size", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"))
    placed = placed.withColumn("range", F.conv(F.substring("key", 1, int(math.log(HASH_RANGES, 16))), 16, 10).cast("int"))
    order = Window.partitionBy("sid", "range").orderBy("key", "doc_id", "size")
    placed = placed.withColumn("row", F.row_number().over(order)).withColumn("start", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    sums = placed.groupBy("sid", "range").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("offset", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    placed = placed.join(sums, ["sid", "range"]).join(small(plan.select("sid", "source_size", "target", "words", "block")), "sid")
    placed = placed.withColumn("start", F.col("start") + F.col("offset"))

    # The blocks that each of its turns touches, met with the slots that take those blocks.
    turn = F.explode_outer(F.when((F.col("size") > 0) & (F.col("start") < F.col("words")), F.sequence(F.lit(0).cast("long"), F.expr("(words - 1 - start) div source_size"))))
    turns = placed.withColumn("turn", turn).withColumn("from", F.col("start") + F.col("turn") * F.col("source_size")).withColumn("to", F.least(F.col("from") + F.col("size"), F.col("words")))
    spans = turns.withColumn("rank", F.explode_outer(F.expr("CASE WHEN turn IS NOT NULL THEN sequence(from div block, (to - 1) div block) END")))
    met = spans.join(schedule(plan.select("sid", "low", "blocks"), max(1, (all_blocks - 1).bit_length())), ["sid", "rank"], "left")
    part = F.when(F.col("slot").isNotNull(), F.least("to", (F.col("rank") + 1) * F.col("block")) - F.greatest("from", F.col("rank") * F.col("block")))
    return met.select("sid", "range", "row", "doc_id", "size", "source_size", "target", "start", "turn", "slot", part.alias("part"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, cap: int = CAP, block_words: int = BLOCK_WORDS, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target (its source's), taken, start (its place in its source's
    stream), first_slot and last_slot (of those that take words of it, null if none does)."""
    found = placements(docs, id_col, text_col, source_col, weights, cap, block_words, broadcast_sources)
    rows = found.groupBy("sid", "range", "row", "doc_id", "size", "source_size", "target", "start")
    return rows.agg(F.coalesce(F.sum("part"), F.lit(0)).cast("long").alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot")).select(
        "doc_id", "size", "source_size", "target", "taken", "start", "first_slot", "last_slot"
    )
