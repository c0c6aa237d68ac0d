"""Anomaly rules for skin-resistance (GSR) and ECG signals.

Signals are rows (subject, idx, value, ...) with idx dense from 0 in each subject, over all its tasks. Thresholds are
parameters whose defaults are the data sets' rules. A value that isn't finite meets no rule but non_finite.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.functions.labels import joined
from pulseframe.functions.values import finite, guarded, is_finite, reasons
from pulseframe.operators.ordered import with_previous
from pulseframe.operators.stats import counted, modes_of, quantiles_of, spread_of
from pulseframe.sources.tables import settled

LEAST_VALID = 20  #: valid values that the robust rule needs
SCALE = 0.6745  #: makes a deviation over the MAD a standard score
ROBUST = "robust_outlier_mad_gt_8"


@dataclass(frozen=True)
class GsrRules:
    low: float = 1.0  #: valid values lie between low and high
    high: float = 1000.0
    step: float = 500.0
    robust: float = 8.0
    many: float = 0.05
    flat_mode: float = 0.8


@dataclass(frozen=True)
class EcgRules:
    extreme: float = 2.0
    step: float = 1.0
    robust: float = 8.0
    window: int = 400  #: samples; windows start every half of it
    flat: float = 1e-6
    many: float = 0.05
    flat_mode: float = 0.8


SERIOUS = ("non_finite", "extreme_amplitude_gt_2", "large_step_gt_1")
GSR_COUNTS = {"NonPositiveRows": "non_positive_le_0", "SentinelOneRows": "sentinel_value_1", "HighGe1000Rows": "high_resistance_ge_1000", "LargeStepRows": "large_step_ge_500", "RobustOutlierRows": ROBUST}
ECG_COUNTS = {"NonFinite": "non_finite", "Flatline": "flatline_window", "ExtremeAmp": "extreme_amplitude_gt_2", "LargeStep": "large_step_gt_1", "RobustOutlier": ROBUST}


def value_counts(signal: DataFrame) -> DataFrame:
    """How often each subject has each finite value, and where first: what points and summaries share. Written."""
    return counted(signal.where(is_finite(F.col("value"))), ["subject"], "value", F.min("idx").alias("_first"))


def _robust(signal: DataFrame, counts: DataFrame | None, valid: Callable[[Column], Column], threshold: float) -> DataFrame:
    """Adds outlier: the modified z-score of a valid value is above the threshold."""
    counts = value_counts(signal) if counts is None else counts
    stats = settled(spread_of(counts.where(valid(F.col("_v"))), ["subject"]), "spread")
    met = signal.join(stats.select("subject", F.col("n").alias("_n"), F.col("med").alias("_med"), F.col("mad").alias("_mad")), "subject", "left")
    score = F.lit(SCALE) * F.abs(F.col("value") - F.col("_med")) / F.nullif(F.col("_mad"), F.lit(0.0))
    return met.withColumn("outlier", valid(F.col("value")) & F.coalesce((F.col("_n") >= LEAST_VALID) & (score > threshold), F.lit(False))).drop("_n", "_med", "_mad")


def _step() -> Column:
    return F.abs(F.col("value") - F.col("previous"))


def gsr_points(signal: DataFrame, rules: GsrRules = GsrRules(), counts: DataFrame | None = None) -> DataFrame:
    """signal with `reasons`, sorted, empty where nothing is odd. counts: value_counts(signal), if at hand."""
    v = F.col("value")
    rows = with_previous(signal, ["subject"], "idx", {"previous": "value"})
    rows = _robust(rows, counts, lambda x: guarded((x > rules.low) & (x < rules.high), x), rules.robust)
    rules_ = {
        "non_finite": ~is_finite(v), "non_positive_le_0": guarded(v <= 0, v), "sentinel_value_1": guarded(v == 1, v), "high_resistance_ge_1000": guarded(v >= rules.high, v),
        "large_step_ge_500": guarded(_step() >= rules.step, v - F.col("previous")), ROBUST: F.col("outlier"),
    }
    return rows.withColumn("reasons", reasons(rules_)).drop("previous", "outlier")


def flat_blocks(signal: DataFrame, window: int, flat: float) -> DataFrame:
    """subject, block: the half windows that lie in a window whose finite values (two at least) hardly vary. Spread is
    merged from the two halves' counts, means and squared deviations; a last window that isn't full doesn't count."""
    half = window // 2
    v = finite(F.col("value"))
    blocks = signal.groupBy("subject", F.expr(f"idx div {half}").alias("block")).agg(F.count("*").alias("size"), F.count(v).alias("n"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias("m2"))
    halo = blocks.where("block % 4096 = 0 AND block > 0").select("*", F.lit(True).alias("_halo"), (F.col("block") - 1).alias("_to"))
    rows = blocks.select("*", F.lit(False).alias("_halo"), F.col("block").alias("_to")).unionByName(halo)
    w = Window.partitionBy("subject", F.expr("_to div 4096")).orderBy("block")
    after = {f"_{c}": F.lead(c).over(w) for c in ("size", "n", "mean", "m2")}
    rows = rows.withColumns(after).where("NOT _halo")
    n = F.col("n") + F.col("_n")
    m2 = F.col("m2") + F.col("_m2") + F.pow(F.col("mean") - F.col("_mean"), F.lit(2)) * F.col("n") * F.col("_n") / F.nullif(n, F.lit(0))
    full = (F.col("size") == half) & (F.col("_size") == half) & (n >= 2) & (F.sqrt(m2 / F.nullif(n, F.lit(0))) < flat)
    return rows.where(full).select("subject", F.explode(F.array("block", F.col("block") + 1)).alias("block")).distinct()


def ecg_points(signal: DataFrame, rules: EcgRules = EcgRules(), per_task: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """signal (with task) with `reasons`. Steps and windows cross the borders of tasks, whose samples stand one behind
    the other, unless per_task, where subject and idx should then name a task's series. counts: as in gsr_points."""
    v = F.col("value")
    rows = with_previous(signal, ["subject"], "idx", {"previous": "value", "previous_task": "task"})
    rows = _robust(rows, counts, lambda x: guarded(F.abs(x) <= rules.extreme, x), rules.robust)
    half = rules.window // 2
    flat = flat_blocks(signal, rules.window, rules.flat).withColumn("_flat", F.lit(True))
    rows = rows.withColumn("block", F.expr(f"idx div {half}")).join(flat, ["subject", "block"], "left")
    step = guarded(_step() > rules.step, v - F.col("previous"))
    if per_task:
        step = step & F.col("task").eqNullSafe(F.col("previous_task"))
    rules_ = {
        "non_finite": ~is_finite(v), "extreme_amplitude_gt_2": guarded(F.abs(v) > rules.extreme, v), "large_step_gt_1": step,
        "flatline_window": is_finite(v) & F.coalesce("_flat", F.lit(False)), ROBUST: F.col("outlier"),
    }
    return rows.withColumn("reasons", reasons(rules_)).drop("previous", "previous_task", "outlier", "block", "_flat")


def _share(count: Column, of: Column) -> Column:
    return F.try_divide(count.cast("double"), of)


def _value_stats(counts: DataFrame, digits: int | None) -> DataFrame:
    """subject, Min, P01, Median, P99, Max, ModeValue, ModeFraction over finite values."""
    by_value = counts
    if digits is not None:
        by_value = counts.groupBy("subject", F.bround("_v", digits).alias("_v")).agg(F.sum("_n").alias("_n"), F.min("_first").alias("_first"))
    found = quantiles_of(counts, ["subject"], {"Min": 0.0, "P01": 0.01, "Median": 0.5, "P99": 0.99, "Max": 1.0}).drop("n")
    return found.join(modes_of(by_value, ["subject"]), "subject").withColumnsRenamed({"mode_value": "ModeValue", "mode_fraction": "ModeFraction"})


def _with_errors(summary: DataFrame, errors: DataFrame | None) -> DataFrame:
    """Adds ParseErrors: rows of errors(subject, ...). Subjects with errors alone get a row of nulls and zero counts."""
    if errors is None:
        return summary.withColumn("ParseErrors", F.lit(0).cast("long"))
    counts = errors.groupBy("subject").agg(F.count("*").alias("ParseErrors"))
    met = summary.join(counts, "subject", "full")
    return met.withColumns({c: F.coalesce(c, F.lit(0)) for c, t in met.dtypes if t in ("bigint", "int")})


def _flags(rules: dict[str, Column], mode_format: str, flat_mode: float) -> Column:
    flat = F.when(F.col("ModeFraction") >= flat_mode, F.format_string(f"flatline_mode_{mode_format}", F.col("ModeValue")))
    return joined(F.array_compact(F.array(*[F.when(F.coalesce(held, F.lit(False)), F.lit(name)) for name, held in rules.items()], flat)))


def gsr_summary(points: DataFrame, errors: DataFrame | None = None, rules: GsrRules = GsrRules(), values: DataFrame | None = None) -> DataFrame:
    """One row per subject of gsr_points' rows. values: value_counts of the signal, if at hand."""
    v, rows = F.col("value"), F.count("*")
    counts = points.groupBy("subject").agg(
        rows.alias("Rows"), F.count_if(F.size("reasons") > 0).alias("AnomalyRows"), F.count_if(guarded(v <= 1, v)).alias("_low"), F.count_if(guarded(v >= rules.high, v)).alias("_high"),
        *[F.count_if(F.array_contains("reasons", reason)).alias(name) for name, reason in GSR_COUNTS.items()],
    )
    found = _with_errors(counts.join(_value_stats(value_counts(points) if values is None else values, None), "subject", "left"), errors)
    for name, part in (("AnomalyFraction", "AnomalyRows"), ("ZeroOrOneFraction", "_low"), ("HighGe1000Fraction", "_high")):
        found = found.withColumn(name, _share(F.col(part), F.col("Rows")))
    flags = _flags({"empty_target_rows": F.col("Rows") == 0, "many_zero_or_one": F.col("ZeroOrOneFraction") >= rules.many, "many_high_ge_1000": F.col("HighGe1000Fraction") >= rules.many}, "%.1f", rules.flat_mode)
    columns = ["Rows", "AnomalyRows", "AnomalyFraction", "Min", "P01", "Median", "P99", "Max", "ModeValue", "ModeFraction", "ZeroOrOneFraction", "HighGe1000Fraction", *GSR_COUNTS, "ParseErrors"]
    return found.select(F.col("subject").alias("Subject"), *columns, flags.alias("Flags"))


def _odd(serious: bool) -> Column:
    return F.arrays_overlap("reasons", F.array(*map(F.lit, SERIOUS))) if serious else F.size("reasons") > 0


def _fractions(per_task: DataFrame) -> DataFrame:
    return per_task.select("subject", "task", "n", _share(F.col("_serious"), F.col("n")).alias("serious_fraction"), _share(F.col("_odd"), F.col("n")).alias("all_fraction"))


def condition_fractions(points: DataFrame) -> DataFrame:
    """subject, task, n, serious_fraction, all_fraction: by points, not by reasons."""
    return _fractions(points.groupBy("subject", "task").agg(F.count("*").alias("n"), F.count_if(_odd(True)).alias("_serious"), F.count_if(_odd(False)).alias("_odd")))


def ecg_summary(points: DataFrame, errors: DataFrame | None = None, rules: EcgRules = EcgRules(), tasks: tuple[str, ...] = ("T12", "T22", "T32"), values: DataFrame | None = None) -> DataFrame:
    """One row per subject of ecg_points' rows. SeriousAnomalyPoints and AllAnomalyPoints count reasons, of which a
    sample may have several; AnomalyRows counts samples. values: as in gsr_summary."""
    v = F.col("value")
    serious = F.size(F.array_intersect("reasons", F.array(*map(F.lit, SERIOUS))))
    # points are read once: counts of tasks add up to those of subjects
    per_task = points.groupBy("subject", "task").agg(
        F.count("*").alias("n"), F.count_if(_odd(True)).alias("_serious"), F.count_if(_odd(False)).alias("_odd"), F.sum(serious).alias("_serious_reasons"), F.sum(F.size("reasons")).alias("_reasons"),
        F.count_if(guarded(F.abs(v) > rules.extreme, v)).alias("_extreme"), *[F.count_if(F.array_contains("reasons", reason)).alias(name) for name, reason in ECG_COUNTS.items()],
    )
    per_task = settled(per_task, "per_task")
    sums = {"TotalPoints": "n", "SeriousAnomalyPoints": "_serious_reasons", "AllAnomalyPoints": "_reasons", "AnomalyRows": "_odd", "_extreme": "_extreme"} | {c: c for c in ECG_COUNTS}
    counts = per_task.groupBy("subject").agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    by_task = _fractions(per_task).where(F.col("task").isin(*tasks)).groupBy("subject").pivot("task", list(tasks))
    by_task = by_task.agg(F.first("serious_fraction").alias("SeriousFrac"), F.first("all_fraction").alias("AllFrac"))
    found = _with_errors(counts.join(by_task, "subject", "left").join(_value_stats(value_counts(points) if values is None else values, 6), "subject", "left"), errors)
    for name, part in (("SeriousAnomalyFraction", "SeriousAnomalyPoints"), ("AllAnomalyFraction", "AllAnomalyPoints"), ("ExtremeFraction", "_extreme")):
        found = found.withColumn(name, _share(F.col(part), F.col("TotalPoints")))
    flags = _flags({"empty_target_rows": F.col("TotalPoints") == 0, "many_extreme_amplitude": F.col("ExtremeFraction") >= rules.many}, "%.4f", rules.flat_mode)
    columns = ["TotalPoints", "SeriousAnomalyPoints", "SeriousAnomalyFraction", "AllAnomalyPoints", "AllAnomalyFraction", "AnomalyRows", *[f"{t}_{k}" for k in ("SeriousFrac", "AllFrac") for t in tasks]]
    columns += ["Min", "P01", "Median", "P99", "Max", "ModeValue", "ModeFraction", "ExtremeFraction", *ECG_COUNTS, "ParseErrors"]
    return found.select(F.col("subject").alias("Subject"), *columns, flags.alias("Flags"))


def point_rows(points: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """subject, row (idx), value, reasons as text, of the samples with a reason; and errors(subject, row, reason)."""
    odd = points.where(F.size("reasons") > 0).select("subject", F.col("idx").alias("row"), "value", joined(F.col("reasons")).alias("reasons"))
    if errors is None:
        return odd
    return odd.unionByName(errors.select("subject", "row", F.lit(None).cast("double").alias("value"), F.col("reason").alias("reasons")))


def reason_counts(points: DataFrame) -> DataFrame:
    return points.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
