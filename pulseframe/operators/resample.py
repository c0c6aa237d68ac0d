"""Uniform grids, as-of and interpolation joins, and trigger segments. Times are microseconds.

Joins with the nearest row before or behind are unions in time order: rows of both sides are sorted together and values
are carried along, block by block (ordered.carried), so no pairs are made and a long series is split. Raw rows of equal
time are ordered by `seq`; an exact hit takes the last of them looking back and the first looking ahead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions.labels import is_valid_trigger
from pulseframe.operators.ordered import Carry, carried, number_rows, with_previous
from pulseframe.sources.tables import settled

BLOCK_US = 3_600_000_000  #: series are split by the hour unless told otherwise
CHUNK = 4096


def _block(block_us: int) -> Column:
    return F.expr(f"t div {block_us}")


def grid(raw: DataFrame, keys: list[str], step_us: int, rounded: bool = False) -> DataFrame:
    """keys, i, t: from the first to the last time of each series; rounded: as many points as the duration is steps,
    halves to even, and one."""
    ends = raw.groupBy(*keys).agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    steps = (F.col("_b") - F.col("_a")) / step_us
    ends = ends.withColumn("_n", (F.rint(steps) if rounded else F.floor(steps)).cast("long"))
    chunks = ends.withColumn("_c", F.explode(F.expr(f"sequence(0L, _n div {CHUNK})")))
    points = chunks.withColumn("i", F.explode(F.expr(f"sequence(_c * {CHUNK}, least(_c * {CHUNK} + {CHUNK - 1}, _n))")))
    return points.select(*keys, "i", (F.col("_a") + F.col("i") * step_us).alias("t"))


def neighbours(points: DataFrame, raw: DataFrame, keys: list[str], value: str, block_us: int = BLOCK_US) -> DataFrame:
    """points(keys, i, t) with before and after: struct(t, v) of the nearest rows of raw(keys, t, seq, value)."""
    held = F.struct(F.col("t").alias("t"), F.col(value).alias("v"))
    left = points.select(*keys, "t", F.col("i"), F.lit(None).cast("long").alias("seq"), F.lit(1).alias("_kind"))
    right = raw.select(*keys, "t", F.lit(None).cast("long").alias("i"), F.col("seq").cast("long").alias("seq"), F.lit(0).alias("_kind"), held.alias("_held"))
    both = left.unionByName(right, allowMissingColumns=True)
    kind, seq = F.col("_kind"), F.coalesce("seq", F.lit(0))
    ahead = Carry("after", "_held", (F.col("t"), -kind, seq), backward=True)
    behind = Carry("before", "_held", (F.col("t"), kind, seq))
    found = carried(both, keys, _block(block_us), ahead, behind)
    return found.where("_kind = 1").select(*keys, "i", "t", "before", "after")


def _line(pick) -> Column:
    """Between the neighbours' values, which pick takes out of them; constant beyond the ends."""
    a, b, t = F.col("before"), F.col("after"), F.col("t")
    line = pick(a) + (pick(b) - pick(a)) * (t - a["t"]) / (b["t"] - a["t"])
    return F.when(a.isNull(), pick(b)).when(b.isNull() | (a["t"] == t), pick(a)).otherwise(line)


def _next(pick) -> Column:
    return F.when(F.col("after").isNotNull(), pick(F.col("after"))).otherwise(pick(F.col("before")))


def interpolated(points: DataFrame, raw: DataFrame, keys: list[str], value: str, block_us: int = BLOCK_US) -> DataFrame:
    """points with value: linear between neighbours, constant beyond the ends."""
    return neighbours(points, raw, keys, value, block_us).select(*keys, "i", "t", _line(lambda x: x["v"]).alias("value"))


def next_label(points: DataFrame, raw: DataFrame, keys: list[str], label: str, block_us: int = BLOCK_US) -> DataFrame:
    """points with the label of the first raw row at or after them, behind the last row that row's."""
    return neighbours(points, raw, keys, label, block_us).select(*keys, "i", "t", _next(lambda x: x["v"]).alias(label))


def uniform_resample(raw: DataFrame, keys: list[str], step_us: int, block_us: int = BLOCK_US) -> DataFrame:
    """raw(keys, t, seq, value, trigger) -> keys, i, t, value, trigger on a grid. Rows with a null time or value go."""
    clean = raw.where("t IS NOT NULL AND value IS NOT NULL")
    found = neighbours(grid(clean, keys, step_us), clean.withColumn("_both", F.struct("value", "trigger")), keys, "_both", block_us)
    return found.select(*keys, "i", "t", _line(lambda x: x["v"]["value"]).alias("value"), _next(lambda x: x["v"]["trigger"]).alias("trigger"))


def segment_resample(raw: DataFrame, keys: list[str], step_us: int, block_us: int = BLOCK_US) -> DataFrame:
    """raw(keys, t, seq, value), one label's rows in each series -> keys, i, t, value. Gaps are bridged; rows that don't
    come later than the row before them go; series of fewer than two rows, before or after that, give nothing. The grid
    reaches to the last row, gone or not."""
    ordered = number_rows(raw, keys, ["seq"], F.expr(f"seq div {1 << 16}"), "_n")
    ordered = with_previous(ordered, keys, "_n", {"_before": "t"})
    kept = ordered.where("_n = 0 OR t > _before")
    enough = kept.groupBy(*keys).agg(F.count("*").alias("_kept")).where("_kept >= 2").drop("_kept")
    ends = raw.groupBy(*keys).agg(F.min_by("t", "seq").alias("_a"), F.max_by("t", "seq").alias("_b")).join(enough, keys)
    spans = ends.select(*keys, F.explode(F.array("_a", "_b")).alias("t"))
    points = grid(spans, keys, step_us, rounded=True)
    # decreasing times are left to sorting, with the first row of equal times kept
    first = kept.groupBy(*keys, "t").agg(F.min("seq").alias("seq"), F.min_by("value", "seq").alias("value"))
    return interpolated(points, first.join(enough, keys, "left_semi"), keys, "value", block_us)


def islands(rows: DataFrame, keys: list[str], trigger: str = "trigger", block_us: int = BLOCK_US) -> DataFrame:
    """rows(keys, t, seq, trigger) -> keys, segment (from 1), trigger, start_t, end_t, n_rows: runs of one trigger among
    the rows with a valid trigger. Runs that only invalid rows part are one."""
    valid = rows.where(is_valid_trigger(F.col(trigger))).select(*keys, "t", "seq", F.col(trigger).alias("trigger"))
    order = (F.col("t"), F.col("seq"))
    valid = valid.withColumn("_held", F.struct("trigger"))
    marked = carried(valid, keys, _block(block_us), Carry("_last", "_held", order, exclusive=True))
    new = F.col("_last").isNull() | (F.col("_last.trigger") != F.col("trigger"))
    marked = settled(marked.withColumn("_start", F.when(new, F.struct("t", "seq"))).drop("_held", "_last"))
    known = carried(marked, keys, _block(block_us), Carry("_of", "_start", order))
    runs = known.groupBy(*keys, "_of", "trigger").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count("*").alias("n_rows"))
    runs = settled(runs.withColumn("_seq", F.col("_of.seq")))
    return number_rows(runs, keys, ["start_t", "_seq"], F.expr(f"start_t div {block_us}"), "segment").select(*keys, (F.col("segment") + 1).alias("segment"), "trigger", "start_t", "end_t", "n_rows")


def reslice(segments: DataFrame, samples: DataFrame, keys: list[str], least: int = 1, block_us: int = BLOCK_US) -> DataFrame:
    """All samples(keys, t, ...) within segments(keys, segment, trigger, start_t, end_t), ends included, for segments of
    at least `least` samples. Segments are numbered without gaps in an order in which neither starts nor ends fall, as islands
    gives them; several may meet in one time.

    So a sample's segments are those from the first that ends at or after it to the last that starts at or before it: both
    are carried to it in time order, and no pairs are tried. Samples of one such range and time block are counted once."""
    segments = segments if hasattr(segments, "_scratch") else settled(segments, "segments")
    mark = F.struct(F.col("segment"))
    starts = segments.select(*keys, F.col("start_t").alias("t"), F.lit(0).alias("_kind"), F.col("segment").alias("_n"), mark.alias("_start"))
    stops = segments.select(*keys, F.col("end_t").alias("t"), F.lit(2).alias("_kind"), F.col("segment").alias("_n"), mark.alias("_stop"))
    both = samples.withColumns({"_kind": F.lit(1), "_n": F.lit(0).cast("long")}).unionByName(starts, allowMissingColumns=True).unionByName(stops, allowMissingColumns=True)
    order = (F.col("t"), F.col("_kind"), F.col("_n"))
    met = carried(both, keys, _block(block_us), Carry("_to", "_start", order), Carry("_from", "_stop", order, backward=True))
    of = [*keys, "_bucket", "_first", "_final"]
    met = met.where("_kind = 1 AND _from.segment <= _to.segment").withColumns({"_bucket": _block(block_us), "_first": F.col("_from.segment"), "_final": F.col("_to.segment")})
    met = settled(met.select(*samples.columns, *of[len(keys) :]), "met")
    ranges = met.groupBy(*of).agg(F.count("*").alias("_n")).select(*of, "_n", F.explode(F.sequence("_first", "_final")).alias("segment"))
    kept = segments.select(*keys, "segment", F.col("trigger").alias("segment_trigger"), "start_t", "end_t")
    if least > 1:
        ranges = settled(ranges, "ranges")
        kept = kept.join(ranges.groupBy(*keys, "segment").agg(F.sum("_n").alias("_n")).where(F.col("_n") >= least).drop("_n"), [*keys, "segment"])
    added = ("segment", "segment_trigger", "start_t", "end_t")
    held = ranges.drop("_n").join(kept, [*keys, "segment"]).groupBy(*of).agg(F.collect_list(F.struct(*added)).alias("_held"))
    return met.join(held, of).select(*samples.columns, F.explode("_held").alias("_s")).select(*samples.columns, *[F.col(f"_s.{c}").alias(c) for c in added])


def least_samples(rate: float) -> int:
    """Samples that a segment needs."""
    return max(int(2 * rate), 10)


def last_of_trigger(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Where a trigger comes again, its last segment only."""
    last = segments.groupBy(*keys, "trigger").agg(F.max("segment").alias("segment"))
    return segments.join(last, [*keys, "trigger", "segment"], "left_semi")
