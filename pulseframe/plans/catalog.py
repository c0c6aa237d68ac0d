"""Registered queries of the signal and face engine over the proxy tables. Doubles are rounded for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.functions import boxes, labels, times
from pulseframe.functions import faces as geometry
from pulseframe.functions.values import finite
from pulseframe.operators import anomalies, expand, features, quality, resample, stats
from pulseframe.operators.ordered import with_previous
from pulseframe.plans import kernels, proxies, roundtrips
from pulseframe.plans.oracles import ORACLES as SIGNAL_ORACLES
from pulseframe.plans.roundtrips import rounded
from pulseframe.sources import images
from pulseframe.sources.tables import settled

__all__ = ["ORACLES", "QUERIES"]


def fixed_rate_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = expand.expand_rows(proxies.channel_rows(spark, sf_dir), ["subject"], "order", "t", "samples")
    return rounded(found.select("subject", labels.label(F.col("trigger"), "en").alias("trust"), "sample_idx", times.rounded_ms(F.col("t")).alias("t"), "value"))


def fixed_rate_restamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand.restamp_rows(proxies.raw_events(spark, sf_dir), ["subject"], "seq", "t", "value")


def channel_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(proxies.channel_rows(spark, sf_dir).select("order", expand.channel_mean(F.col("samples")).alias("mean")))


def label_map_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = proxies.raw_events(spark, sf_dir).where(labels.is_target(F.col("trigger")))
    task = F.trim("trigger")
    return rows.select("seq", task.alias("task"), *[labels.label(task, mode).alias(mode) for mode in ("zh", "en", "condition")])


def trigger_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    trigger = labels.trigger(F.col("trigger"))
    return proxies.raw_events(spark, sf_dir).groupBy(trigger.alias("trigger")).agg(F.count("*").alias("n")).withColumn("valid", labels.is_valid_trigger(F.col("trigger")))


def _grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    raw = proxies.raw_events(spark, sf_dir)
    return raw, resample.grid(raw, ["subject"], proxies.STEP_US)


def resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, points = _grid(spark, sf_dir)
    return rounded(resample.interpolated(points, raw, ["subject"], "value", proxies.BLOCK_US))


def trigger_asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, points = _grid(spark, sf_dir)
    return resample.next_label(points, raw, ["subject"], "trigger", proxies.BLOCK_US)


def segment_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = proxies.raw_events(spark, sf_dir).where("task IS NOT NULL")
    return rounded(resample.segment_resample(raw, ["subject", "task"], proxies.STEP_US, proxies.BLOCK_US))


def _islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = proxies.raw_events(spark, sf_dir).withColumn("trigger", labels.trigger(F.col("trigger")))
    return resample.islands(raw, ["subject"], "trigger", proxies.BLOCK_US)


def trigger_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _islands(spark, sf_dir)


def segment_reslice(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = proxies.raw_events(spark, sf_dir)
    found = resample.reslice(_islands(spark, sf_dir), raw.select("subject", "seq", "t", "value"), ["subject"], 4, proxies.BLOCK_US)
    return found.select("subject", "segment", "segment_trigger", "seq", "value")


def conductance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(proxies.raw_events(spark, sf_dir).select("seq", expand.conductance(F.floor("value")).alias("microsiemens")))


def sampling_rate_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulseframe.operators.ordered import with_previous

    rows = with_previous(proxies.signal(spark, sf_dir), ["subject"], "idx", {"previous_t": "t"})
    return rounded(expand.sampling_rate(rows, ["subject"], "t", "previous_t"))


def _signal(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The signal, and the counts of its values."""
    signal = settled(proxies.signal(spark, sf_dir), "signal")
    return signal, anomalies.value_counts(signal)


def gsr_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal, values = _signal(spark, sf_dir)
    return anomalies.point_rows(anomalies.gsr_points(signal, proxies.GSR, values))


def gsr_anomaly_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal, values = _signal(spark, sf_dir)
    return rounded(anomalies.gsr_summary(anomalies.gsr_points(signal, proxies.GSR, values), rules=proxies.GSR, values=values))


def _ecg(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal, values = _signal(spark, sf_dir)
    return anomalies.ecg_points(signal, proxies.ECG, counts=values)


def ecg_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies.point_rows(_ecg(spark, sf_dir))


def ecg_anomaly_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal, values = _signal(spark, sf_dir)
    return rounded(anomalies.ecg_summary(anomalies.ecg_points(signal, proxies.ECG, counts=values), rules=proxies.ECG, values=values))


def condition_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(anomalies.condition_fractions(_ecg(spark, sf_dir)))


def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies.reason_counts(_ecg(spark, sf_dir))


def top_anomaly_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = anomalies.gsr_points(proxies.signal(spark, sf_dir), proxies.GSR).groupBy("subject").agg(F.count_if(F.size("reasons") > 0).alias("odd"))
    return stats.top(counts, "odd", ["subject"], 3)


def value_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.modes(proxies.signal(spark, sf_dir), ["subject"], "value", "idx"))


def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = proxies.signal(spark, sf_dir).withColumn("value", finite(F.col("value")))
    return rounded(stats.histogram(rows, "value", 240))


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.grade(proxies.feature_rows(spark, sf_dir), proxies.anomaly_rows(spark, sf_dir))


def quality_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_graded(spark, sf_dir).select("user_id", "task_id", "recommendation", "reasons", "serious_fraction", "all_fraction"))


def quality_subject_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.subject_status(_graded(spark, sf_dir))


def drop_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.reason_histogram(_graded(spark, sf_dir), "drop")


def feature_group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = proxies.table(spark, sf_dir, "lineitem")
    return rounded(stats.five_numbers(rows, ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), 4)


def box_group_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = quality.evenly_spaced(proxies.box_rows(spark, sf_dir), ["subject"], "path")
    only = chosen.groupBy("subject").agg((F.count_if(F.col("method") == "opencv_haar") >= 3).alias("only"))
    used = chosen.join(only, "subject").where("NOT only OR method = 'opencv_haar'")
    return rounded(used.groupBy("subject").agg(F.count("*").alias("n"), *[F.median(c).alias(c) for c in ("left", "top", "right", "bottom")]))


def _one_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box rows as images of 1280 x 720 with a face each."""
    face = F.struct((F.col("left") * 10 + 300).alias("x"), F.col("top").alias("y"), (F.col("bottom") - 400).alias("w"), (F.col("bottom") - 380).alias("h"))
    rows = proxies.box_rows(spark, sf_dir)
    return rows.select(F.col("subject").cast("string").alias("subject"), F.lit("T12").alias("task"), "path", F.lit(1280).alias("width"), F.lit(720).alias("height"), F.array(face).alias("faces"), F.lit(None).cast("string").alias("error"))


def box_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.with_crop_box(_one_face(spark, sf_dir), F.col("faces"), F.col("width"), F.col("height")).select("path", "box.*")


def group_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.group_boxes(_one_face(spark, sf_dir)).select("subject", "image_count", "box.*")


def _face(profile: str) -> geometry.Face:
    return geometry.Face(F.col("landmarks"), F.col("width"), F.col("height"), profile, lambda i: i % proxies.POINTS)


def _geometry(measures, profile: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = measures(_face(profile))
        return rounded(proxies.faces(spark, sf_dir).select("vec_id", *[c.alias(name) for name, c in found.items()]))

    return query


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.first_rows(proxies.raw_events(spark, sf_dir).select("subject", "task", "seq", "value").where("task IS NOT NULL"), ["subject", "task"], ["seq"])


def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = proxies.table(spark, sf_dir, "events")
    return quality.missing_from(events.select("user_id"), events.where("value > 150").select("user_id"), ["user_id"])


def semi_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = proxies.table(spark, sf_dir, "events")
    found = events.where("event_type = 'error'").join(events.where("value > 250").select("user_id").distinct(), "user_id", "left_semi")
    return found.select("event_id", "user_id")


def missing_input_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = proxies.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"))
    return quality.with_status(users, proxies.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject")), "no_input_csv")


def scr_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.scr_features(proxies.signal(spark, sf_dir).where("task IS NOT NULL"), 5.0))


def ecg_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.ecg_features(proxies.signal(spark, sf_dir).withColumn("task", F.lit("T12"))))


QUERIES = {
    f.__name__: f
    for f in (
        fixed_rate_expand, fixed_rate_restamp, channel_mean, label_map_filter, trigger_normalise, resample_linear, trigger_asof_forward, segment_resample, trigger_islands, segment_reslice, conductance, sampling_rate_estimate,
        gsr_anomaly_summary, ecg_anomaly_summary, condition_fractions, reason_counts, top_anomaly_subjects, value_mode, value_histogram, quality_grade, quality_subject_status, drop_reason_counts, feature_group_summary,
        box_group_median, box_expand, group_boxes, dedup_first, set_difference, semi_existing, missing_input_status, scr_features, ecg_features,
    )
} | {"gsr_anomaly_points": gsr_points, "ecg_anomaly_points": ecg_points}
for _name, _measures in (("ear_geometry", geometry.ear), ("face3d_geometry", geometry.face3d), ("au_geometry", geometry.action_units)):
    for _profile in geometry.PROFILES:
        QUERIES[f"{_name}_{_profile}"] = _geometry(_measures, _profile)
QUERIES |= roundtrips.QUERIES | kernels.QUERIES
ORACLES = SIGNAL_ORACLES | roundtrips.ORACLES | kernels.ORACLES
