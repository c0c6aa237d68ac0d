"""The engine's three flows from recordings or landmarks to results, as chains of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.functions import labels
from pulseframe.operators import anomalies, expand, face, features, quality, resample
from pulseframe.sources.recordings import in_file_order, trigger_rows
from pulseframe.sources.tables import settled


def ecg_signal(raw: DataFrame, mode: str = "channels") -> DataFrame:
    """Raw rows (subject, file, row, t, samples, trigger) -> signal (subject, task, idx, t, value).

    mode: what the 50 numbers of a row are. "samples": consecutive ones at 200 Hz, stamped anew from each file's start.
    "channels": one moment's channels, averaged; each task's rows are resampled to 200 Hz. The two must not be mixed."""
    if mode == "samples":
        ordered = in_file_order(raw, ["subject", "file"])
        found = expand.expand_rows(ordered, ["subject", "file"], "seq", "t", "samples")
        w = Window.partitionBy("subject", "task").orderBy("file", "sample_idx")
        return found.withColumnRenamed("trigger", "task").withColumn("idx", F.row_number().over(w) - 1).select("subject", "task", "idx", "t", "value")
    if mode != "channels":
        raise ValueError(f"no mode {mode!r}; there are samples and channels")
    rows = in_file_order(trigger_rows(raw), ["subject"]).where(labels.is_target(F.col("trigger")))
    rows = settled(rows.select("subject", F.col("trigger").alias("task"), "seq", "t", expand.channel_mean(F.col("samples")).alias("value")))
    found = resample.segment_resample(rows, ["subject", "task"], expand.ECG_STEP_US)
    return found.select("subject", "task", F.col("i").alias("idx"), "t", "value")


def processed_signal(good: DataFrame) -> DataFrame:
    """Good rows of processed files (subject, task, file, row, t, value) -> signal: idx dense in each task, over its files in
    order of their names, and place dense in each subject, whose tasks stand one behind the other."""
    rows = settled(in_file_order(good, ["subject", "task"]).select("subject", "task", F.col("seq").alias("idx"), "t", "value", "trust"))
    tasks = Window.partitionBy("subject").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("subject", "task").agg(F.count("*").alias("_n")).select("subject", "task", F.coalesce(F.sum("_n").over(tasks), F.lit(0)).alias("_before"))
    return rows.join(before, ["subject", "task"]).withColumn("place", F.col("idx") + F.col("_before")).drop("_before")


def ecg_quality(signal: DataFrame, errors: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """signal -> features of each recording, anomaly summary of each subject, and grades."""
    tasks = Window.partitionBy("subject").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    sizes = signal.groupBy("subject", "task").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(tasks), F.lit(0)))
    joined = settled(signal.join(sizes.drop("_n"), ["subject", "task"]).withColumn("idx", F.col("idx") + F.col("_before")).drop("_before"))
    values = anomalies.value_counts(joined)
    summary = settled(anomalies.ecg_summary(anomalies.ecg_points(joined, counts=values), errors, values=values))
    found = settled(features.ecg_features(signal))
    return found, summary, quality.grade(found, summary)


def gsr_segments(raw: DataFrame, rate: float = 50.0) -> DataFrame:
    """Raw rows (subject, t, seq, value in kiloohms, trigger) -> subject, segment, task, idx, t, value in microsiemens:
    50 Hz, cut into runs of one trigger that are long enough."""
    clean = raw.withColumn("trigger", labels.trigger(F.col("trigger")))
    uniform = settled(resample.uniform_resample(settled(clean), ["subject"], expand.GSR_STEP_US).withColumn("seq", F.col("i")))
    runs = settled(resample.islands(uniform, ["subject"]))
    found = resample.reslice(runs, uniform.select("subject", "t", "i", "value"), ["subject"], resample.least_samples(rate))
    w = Window.partitionBy("subject", "segment").orderBy("i")
    return found.select("subject", "segment", labels.safe_name(F.col("segment_trigger")).alias("task"), (F.row_number().over(w) - 1).alias("idx"), "t", expand.conductance(F.col("value")).alias("value"))


def scr_of_segments(segments: DataFrame, rate: float = 50.0) -> DataFrame:
    """Features of the last segment of each trigger."""
    last = resample.last_of_trigger(segments.select("subject", "segment", F.col("task").alias("trigger")).distinct(), ["subject"])
    kept = segments.join(last.select("subject", "segment"), ["subject", "segment"], "left_semi")
    return features.scr_features(kept, rate)


def face_summary(landmarks: DataFrame, profile: str = "combined") -> tuple[DataFrame, DataFrame]:
    """landmarks -> features of each image, and their summary."""
    found = face.features(landmarks, profile)
    return found, face.summary(found)
