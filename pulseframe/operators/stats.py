"""Exact order statistics, modes and histograms of groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.functions.values import INF
from pulseframe.sources.tables import forget, settled

LARGEST = 1 << 20  #: different values sorted in one task
DIGIT = 10  #: bits of a radix round; ORDER_BITS of them make at most seven rounds
ORDER_BITS = 64
STEPS = 256  #: parts of a power of two in which values are counted before they are told apart
WIDTHS, ROUNDS = 4096, 4  #: equal parts of a part that is still too large, and how often it is divided


def counted(df: DataFrame, keys: list[str], value: str, *more: Column) -> DataFrame:
    """keys, _v, _n: how often each value of a group occurs, null and NaN aside; written, for several statistics."""
    held = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    return settled(held.groupBy(*keys, (F.col(value) + F.lit(0.0)).alias("_v")).agg(F.count("*").alias("_n"), *more), "counts")


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the last column, doubles, by whole numbers of the same order."""
    for batch in batches:
        bits = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).view(np.int64)
        # of negative doubles the other bits fall as the value rises
        whole = np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(whole)], names=batch.schema.names)


def _with_order(counts: DataFrame, columns: list[str]) -> DataFrame:
    """Adds _o, a long that orders as _v does."""
    rows = counts.select(*columns, F.col("_v").alias("_o"))
    schema = ", ".join(f"`{f.name}` {'bigint' if f.name == '_o' else f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_ordered, schema)


def _between(low: Column, high: Column, share: Column) -> Column:
    """Linear interpolation; equal ends, also infinite ones, stay as they are, and a span beyond doubles doesn't overflow."""
    span = high - low
    return F.when((low == high) | (share == 0), low).when(F.abs(span) < INF, low + span * share).otherwise(low * (1 - share) + high * share)


def quantiles_of(counts: DataFrame, keys: list[str], asked: dict[str, float], largest: int = LARGEST) -> DataFrame:
    """counts(keys, _v, _n) -> keys, n and exact quantiles (name -> share) by linear interpolation.

    Values of a group are put in order and their counts summed. A group of more than `largest` different values is first
    narrowed by radix selection: values become 64-bit numbers of the same order, and in each round the counts of the next
    DIGIT bits tell which of 1,024 parts hold the wanted ranks. Only these stay, until they are small enough to be sorted:
    seven rounds at most, whatever the values, infinities included."""
    groups = counts.groupBy(*keys).agg(F.sum("_n").alias("n"), F.count("*").alias("_values"))
    rows = counts.select(*keys, "_v", "_n").join(groups, keys).withColumns({"_at": F.lit(0).cast("long"), "_ranks": _asked_ranks(asked)})
    return _picked(rows, keys, asked, groups.agg(F.max("_values")).first()[0] or 0, largest)


def _asked_ranks(asked: dict[str, float]) -> Column:
    return F.array_distinct(F.array(*[f((F.col("n") - 1) * F.lit(q)).cast("long") for q in asked.values() for f in (F.floor, F.ceil)]))


def _picked(rows: DataFrame, keys: list[str], asked: dict[str, float], most: int, largest: int) -> DataFrame:
    """rows(keys, _v, _n, n, _at, _ranks), each value of a part once, of which a part has at most `most` -> keys, n, quantiles."""
    part, temporary = [*keys, "_at"], []  # _at: how many values of the group lie below the part
    if most > largest:
        rows = _with_order(rows, [*keys, "_v", "_n", "n", "_at", "_ranks"])
        for low in range(ORDER_BITS - DIGIT, -DIGIT, -DIGIT):
            low, mask = max(low, 0), (1 << DIGIT) - 1
            # the sign bit turned, so that negative numbers come first
            digit = F.shiftrightunsigned(F.col("_o").bitwiseXOR(F.lit(-(1 << 63))), low).bitwiseAND(F.lit(mask))
            placed = rows.withColumn("_digit", digit)
            sizes = placed.groupBy(*part, "_digit").agg(F.sum("_n").alias("_size"), F.count("*").alias("_values"), F.first("_ranks").alias("_ranks"))
            sizes = sizes.withColumn("_before", F.col("_at") + F.sum("_size").over(Window.partitionBy(*part).orderBy("_digit")) - F.col("_size"))
            hit = F.filter("_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_size")))
            wanted = settled(sizes.withColumn("_hit", hit).where(F.size("_hit") > 0).select(*part, "_digit", "_before", "_hit", "_values"), "wanted")
            inside = placed.drop("_ranks").join(wanted.drop("_values"), [*part, "_digit"])
            rows = settled(inside.select(*keys, "_v", "_n", "n", F.col("_before").alias("_at"), F.col("_hit").alias("_ranks"), "_o"), "inside")
            most = wanted.agg(F.max("_values")).first()[0] or 0
            forget(wanted, *temporary)
            temporary = [rows]
            if most <= largest:
                break
    inside = rows.withColumn("_start", F.col("_at") + F.sum("_n").over(Window.partitionBy(*part).orderBy("_v")) - F.col("_n"))
    found = inside.withColumn("_ranks", F.filter("_ranks", lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_n")))).where(F.size("_ranks") > 0)
    found = found.groupBy(*keys, "n").agg(F.map_from_entries(F.flatten(F.collect_list(F.transform("_ranks", lambda r: F.struct(r, F.col("_v")))))).alias("_found"))

    def quantile(q: float) -> Column:
        at = (F.col("n") - 1) * F.lit(q)
        low, high = F.element_at("_found", F.floor(at).cast("long")), F.element_at("_found", F.ceil(at).cast("long"))
        return _between(low, high, at - F.floor(at))

    return found.select(*keys, "n", *[quantile(q).alias(name) for name, q in asked.items()])


def _scale(v: Column) -> Column:
    """A whole number that never falls as v rises: STEPS to a power of two, 0 of zero, infinities at the ends."""
    size = F.when(F.abs(v) < INF, F.floor(F.log2(F.abs(v)) * STEPS)).otherwise(F.lit(1200 * STEPS)) + 1200 * STEPS
    return F.when(v == 0, F.lit(0).cast("long")).when(v < 0, -size).otherwise(size)


def _hit(start: str, size: str) -> Column:
    return F.filter("_ranks", lambda r: (r >= F.col(start)) & (r < F.col(start) + F.col(size)))


def narrowed(df: DataFrame, keys: list[str], value: str, asked: dict[str, float], largest: int = LARGEST) -> DataFrame:
    """keys, _v, _n, n, _at, _ranks: how often each value occurs in the parts that hold the wanted ranks; written.

    A table of all values would grow with them in each task. So rows are first counted by _scale, a few thousand parts, and only
    those of the parts that hold a rank go on; parts of more than `largest` rows that differ are cut into equal widths again."""
    held = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, (F.col(value) + F.lit(0.0)).alias("_v"))
    ends = [F.count("*").alias("_size"), F.min("_v").alias("_low"), F.max("_v").alias("_high")]
    placed, part, columns = held.withColumn("_digit", _scale(F.col("_v"))), list(keys), ["_at", "n", "_ranks", "_low", "_high"]
    group = Window.partitionBy(*keys)
    sizes = placed.groupBy(*keys, "_digit").agg(*ends).withColumns({"n": F.sum("_size").over(group), "_before": F.sum("_size").over(group.orderBy("_digit")) - F.col("_size")})
    sizes = sizes.withColumn("_ranks", _asked_ranks(asked))
    for _ in range(ROUNDS):
        wanted = settled(sizes.withColumn("_ranks", _hit("_before", "_size")).where(F.size("_ranks") > 0).select(*part, "_digit", F.col("_before").alias("_start"), *columns[1:], "_size"), "wanted")
        inside = placed.select(*part, "_v", "_digit").join(wanted.drop("_size"), [*part, "_digit"]).select(*keys, "_v", F.col("_start").alias("_at"), *columns[1:])
        if wanted.where((F.col("_size") > largest) & (F.col("_low") < F.col("_high"))).isEmpty():
            break
        part, span = [*keys, "_at"], F.col("_high") - F.col("_low")
        share = F.when((span > 0) & (span < INF), (F.col("_v") - F.col("_low")) / span).otherwise(0.0)
        placed = settled(inside, "inside").withColumn("_digit", F.least(F.floor(share * WIDTHS), F.lit(WIDTHS - 1)))
        sizes = placed.groupBy(*part, "_digit").agg(*ends, F.first("n").alias("n"), F.first("_ranks").alias("_ranks"))
        sizes = sizes.withColumn("_before", F.col("_at") + F.sum("_size").over(Window.partitionBy(*part).orderBy("_digit")) - F.col("_size"))
    return settled(inside.groupBy(*keys, "n", "_at", "_v").agg(F.count("*").alias("_n"), F.first("_ranks").alias("_ranks")), "counts")


def quantiles(df: DataFrame, keys: list[str], value: str, asked: dict[str, float], largest: int = LARGEST) -> DataFrame:
    """Exact quantiles with linear interpolation (name -> share) of the values of each group, null and NaN aside, and their
    number as n. df is read twice."""
    rows = narrowed(df, keys, value, asked, largest)
    most = rows.groupBy(*keys, "_at").count().agg(F.max("count")).first()[0] or 0
    return _picked(rows, keys, asked, most, largest)


def spread_of(counts: DataFrame, keys: list[str], asked: dict[str, float] | None = None, largest: int = LARGEST) -> DataFrame:
    """counts(keys, _v, _n) -> n, med, mad (median absolute deviation, unscaled) and other quantiles asked for. Deviations
    are counted from the counts: the rows aren't read again."""
    med = settled(quantiles_of(counts, keys, {"med": 0.5} | (asked or {}), largest), "medians")
    away = counts.join(med.select(*keys, "med"), keys).groupBy(*keys, F.abs(F.col("_v") - F.col("med")).alias("_v")).agg(F.sum("_n").alias("_n"))
    return med.join(quantiles_of(settled(away.where(~F.isnan("_v")), "deviations"), keys, {"mad": 0.5}, largest).drop("n"), keys)


def median_and_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, med and mad (median absolute deviation, unscaled) of the values of each group, null and NaN aside."""
    return spread_of(counted(df, keys, value), keys)


def modes_of(counts: DataFrame, keys: list[str]) -> DataFrame:
    """counts(keys, _v, _n, _first) -> mode_value (of several, the one met first) and mode_fraction."""
    best = counts.groupBy(*keys).agg(F.max_by("_v", F.struct(F.col("_n"), (-F.col("_first")).alias("f"))).alias("mode_value"), F.max("_n").alias("_most"), F.sum("_n").alias("_all"))
    return best.select(*keys, "mode_value", (F.col("_most") / F.col("_all")).alias("mode_fraction"))


def modes(df: DataFrame, keys: list[str], value: str, idx: str) -> DataFrame:
    """mode_value (of several, the one met first) and mode_fraction of the non-null values of each group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"), F.min(idx).alias("_first"))
    return modes_of(counts, keys)


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bin (from 0), n, low, high of equal-width bins over the non-null values; the last bin holds the maximum too."""
    values = df.where(F.col(value).isNotNull()).select(F.col(value).alias("_v"))
    half = F.when(F.col("_a") == F.col("_b"), 0.5).otherwise(0.0)
    ends = values.agg(F.min("_v").alias("_a"), F.max("_v").alias("_b")).select((F.col("_a") - half).alias("_a"), (F.col("_b") + half).alias("_b"))
    low, width = ends.select("_a").scalar(), ends.select((F.col("_b") - F.col("_a")) / bins).scalar()
    counts = values.select(F.least(F.floor((F.col("_v") - low) / width), F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), (low + F.col("bin") * width).alias("low"), (low + (F.col("bin") + 1) * width).alias("high"))


def five_numbers(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """rows, and {value}_mean, _std (sample), _median, _min, _max of each group; NaN counts as missing, infinities don't."""
    clean = df.select(*keys, *[F.when(~F.isnan(v), F.col(v)).alias(v) for v in values])
    plain = clean.groupBy(*keys).agg(F.count("*").alias("rows"), *[x for v in values for x in (F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std"), F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max"))])
    long = clean.select(*keys, F.explode(F.array(*[F.struct(F.lit(v).alias("_name"), F.col(v).alias("_x")) for v in values])).alias("_e")).select(*keys, "_e.*")
    medians = quantiles(long, [*keys, "_name"], "_x", {"_m": 0.5}).groupBy(*keys).pivot("_name", values).agg(F.first("_m"))
    return plain.join(medians.select(*keys, *[F.col(v).alias(f"{v}_median") for v in values]), keys, "left")


def top(df: DataFrame, count: str, ties: list[str], k: int) -> DataFrame:
    return df.orderBy(F.col(count).desc(), *ties).limit(k)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Nulls count as a value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col(column).asc_nulls_last())
