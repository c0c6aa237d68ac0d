"""Raw recordings to signals of a fixed rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions.labels import is_target
from pulseframe.functions.values import INF
from pulseframe.operators.ordered import BLOCK, number_rows
from pulseframe.operators.stats import quantiles

ECG_STEP_US, GSR_STEP_US = 5_000, 20_000  #: 200 and 50 samples a second


def _anchored(raw: DataFrame, keys: list[str], order: str, t: str, block: Column | None) -> DataFrame:
    """Adds row_no, over all rows whatever their trigger, and anchor, the time of the series' first row."""
    numbered = number_rows(raw, keys, [order], F.expr(f"{order} div {BLOCK}") if block is None else block, "row_no")
    anchors = raw.groupBy(*keys).agg(F.min_by(t, order).alias("anchor"))
    return numbered.join(anchors, keys)


def expand_rows(raw: DataFrame, keys: list[str], order: str, t: str, samples: str, trigger: str = "trigger", step_us: int = ECG_STEP_US, width: int = 50, block: Column | None = None) -> DataFrame:
    """Each row holds `width` consecutive samples: keys, trigger, sample_idx, t (microseconds), value. Samples are
    numbered over all rows of a series, then rows without a target trigger go."""
    rows = _anchored(raw, keys, order, t, block).where(is_target(F.col(trigger)))
    each = rows.select(*keys, F.trim(trigger).alias("trigger"), "row_no", "anchor", F.posexplode(F.slice(samples, 1, width)).alias("offset", "value"))
    idx = F.col("row_no") * width + F.col("offset")
    return each.select(*keys, "trigger", idx.alias("sample_idx"), (F.col("anchor") + idx * step_us).alias("t"), "value")


def restamp_rows(raw: DataFrame, keys: list[str], order: str, t: str, value: str, trigger: str = "trigger", step_us: int = GSR_STEP_US, block: Column | None = None) -> DataFrame:
    """Each row holds one sample: keys, trigger, sample_idx, t, value; numbered before the trigger filter."""
    rows = _anchored(raw, keys, order, t, block).where(is_target(F.col(trigger)))
    return rows.select(*keys, F.trim(trigger).alias("trigger"), F.col("row_no").alias("sample_idx"), (F.col("anchor") + F.col("row_no") * step_us).alias("t"), F.col(value).alias("value"))


def channel_mean(samples: Column, width: int = 50) -> Column:
    """Mean of the first `width` channels; null for an empty array."""
    held = F.slice(samples, 1, width)
    return F.try_divide(F.aggregate(held, F.lit(0.0), lambda a, x: a + x.cast("double")), F.size(held))


def conductance(resistance: Column) -> Column:
    """Microsiemens from kiloohms; zero counts as 1e-9."""
    return F.lit(1000.0) / F.when(resistance == 0, F.lit(1e-9)).otherwise(resistance)


def both_modalities(ecg: DataFrame, gsr: DataFrame, subject: str = "subject") -> DataFrame:
    """Rows of ecg whose subject has gsr too."""
    return ecg.join(gsr.select(subject).distinct(), subject, "left_semi")


def tasks_in_both(ecg: DataFrame, gsr: DataFrame) -> DataFrame:
    """subject, task that both modalities have: a subject counts if there is one such task."""
    return ecg.select("subject", "task").distinct().join(gsr.select("subject", "task").distinct(), ["subject", "task"], "left_semi")


def sampling_rate(df: DataFrame, keys: list[str], t: str, previous: str, default: float | None = 50.0) -> DataFrame:
    """keys, rate: one over the median of the positive steps from `previous` to `t` (microseconds), rounded; `default`
    without one, null instead of rates under 2 if there is no default."""
    steps = df.select(*keys, ((F.col(t) - F.col(previous)) / 1e6).alias("_step")).where("_step > 0")
    found = df.select(*keys).distinct().join(quantiles(steps, keys, "_step", {"_m": 0.5}), keys, "left")
    if default is not None:
        return found.select(*keys, F.coalesce(1 / F.col("_m"), F.lit(default)).alias("rate"))
    rate = F.rint(1 / F.col("_m"))
    return found.select(*keys, F.when((rate >= 2) & (rate < F.lit(INF)), rate).alias("rate"))
