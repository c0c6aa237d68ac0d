"""An extra beyond the batch engine: the rules that need one sample or the one before it, on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulseframe.functions.values import guarded, is_finite, reasons
from pulseframe.operators.anomalies import GsrRules

SCHEMA = "subject string, ts timestamp, value double, previous double"


def _with_last(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else float("nan")
    for frame in frames:
        rows = frame.sort_values("ts", kind="stable").reset_index(drop=True)
        rows["previous"] = rows["value"].shift(1)
        rows.loc[0, "previous"] = last
        last = float(rows["value"].iloc[-1])
        yield rows[["subject", "ts", "value", "previous"]]
    state.update((last,))


def flagged(stream: DataFrame, rules: GsrRules = GsrRules()) -> DataFrame:
    """A stream (subject, ts, value) with reasons. The state is one number per subject; samples that come late within a
    batch are put in order, those of an earlier batch are judged against the last one seen."""
    rows = stream.select("subject", F.col("ts").cast("timestamp"), F.col("value").cast("double"))
    met = rows.groupBy("subject").applyInPandasWithState(_with_last, SCHEMA, "last double", "append", GroupStateTimeout.NoTimeout)
    v, step = F.col("value"), F.abs(F.col("value") - F.col("previous"))
    found = {
        "non_finite": ~is_finite(v), "non_positive_le_0": guarded(v <= 0, v), "sentinel_value_1": guarded(v == 1, v), "high_resistance_ge_1000": guarded(v >= rules.high, v),
        "large_step_ge_500": guarded(step >= rules.step, v - F.col("previous")),
    }
    return met.select("subject", "ts", "value", reasons(found).alias("reasons"))
