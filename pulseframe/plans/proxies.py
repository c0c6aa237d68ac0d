"""The engine's inputs, taken from general tables where no recordings are at hand.

events stand for signal rows (a series per event type, a task by user), embeddings for rows of 50 channels and, as
triples, for landmarks, lineitem for feature and box rows. Thresholds are set to these tables' ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.functions import times
from pulseframe.operators.anomalies import EcgRules, GsrRules
from pulseframe.operators.ordered import number_rows

GSR = GsrRules(high=200.0, step=150.0)
ECG = EcgRules(extreme=200.0, step=150.0, window=20, flat=12.0)
STEP_US = 600_000_000  #: grid step over events, ten minutes
BLOCK_US = 86_400_000_000
POINTS = 21  #: landmarks in a proxy face
TRIGGERS = ("T12", " T12 ", "t12", "null", "anxitey", "terrify", "base.", "T22", "T32 ", "drive")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def task_of(user: str = "user_id"):
    u = F.col(user) % 4
    return F.when(u == 0, "T12").when(u == 1, "T22").when(u == 2, "T32")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, seq, t, value, trigger, task: recordings before any processing."""
    trigger = F.get(F.array(*map(F.lit, TRIGGERS)), ((F.col("user_id") / 8).cast("int") % len(TRIGGERS)).cast("int"))
    events = table(spark, sf_dir, "events")
    return events.select(F.col("event_type").alias("subject"), F.col("event_id").alias("seq"), times.micros(F.col("ts")).alias("t"), "value", trigger.alias("trigger"), task_of().alias("task"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, idx, t, value, task."""
    rows = raw_events(spark, sf_dir)
    return number_rows(rows, ["subject"], ["seq"], F.expr("seq div 65536")).select("subject", "idx", "t", "value", "task")


def channel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, order, t, samples, trigger: rows of 50 samples and more."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        F.format_string("T%03d", "label").alias("subject"), F.col("vec_id").alias("order"), (F.lit(1_700_000_000_000_000) + F.col("vec_id") * 1_000_003).alias("t"), F.col("embedding").cast("array<double>").alias("samples"),
        F.get(F.array(*map(F.lit, TRIGGERS)), (F.col("vec_id") % len(TRIGGERS)).cast("int")).alias("trigger"),
    )


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, landmarks, width, height: 21 points from 63 numbers, shifted into the unit square."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    part = lambda i, k: F.get("e", i * 3 + k) + 0.5
    points = F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)), lambda i: F.struct(part(i, 0).alias("x"), part(i, 1).alias("y"), F.get("e", i * 3 + 2).alias("z")))
    return rows.select("vec_id", points.alias("landmarks"), F.lit(640).alias("width"), F.lit(480).alias("height"))


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows for the quality rules: a subject per user, a task per event type."""
    events = table(spark, sf_dir, "events")
    task = F.when(F.col("event_type") == "click", "T12").when(F.col("event_type") == "view", "T22").when(F.col("event_type") == "purchase", "T32")
    rows = events.withColumn("task_id", task).where("task_id IS NOT NULL AND user_id % 7 <> 3 OR task_id = 'T12'")
    found = rows.groupBy(F.format_string("T%03d", "user_id").alias("user_id"), "task_id").agg(
        F.count("*").alias("n_samples"), F.avg("value").alias("ecg_mean"), (F.stddev_pop("value") / 40).alias("ecg_std"), F.min("value").alias("ecg_min"), F.max("value").alias("ecg_max"), F.count_if(F.col("value") > 60).cast("int").alias("n_peaks"),
    )
    seconds = F.col("n_samples") * 5.0
    flags = F.array_join(F.array_compact(F.array(F.when(F.col("n_samples") < 8, "too_short"), F.when(F.col("ecg_std") < 0.3, "flatline_signal"), F.when(F.col("n_peaks") < 2, "too_few_peaks"))), ";")
    none = F.lit(None).cast("double")
    return found.select(
        "user_id", "task_id", F.concat("user_id", F.lit("_ECG_"), "task_id").alias("file"), F.lit("").alias("condition"), "n_samples", seconds.alias("duration_sec"), "ecg_mean", "ecg_std", "ecg_min", "ecg_max", "n_peaks",
        (F.col("n_peaks") / seconds * 600).alias("peak_rate_per_min"), none.alias("mean_ibi_ms"), none.alias("cv_ibi_pct"), none.alias("lf_hf_ratio"), none.alias("dominant_freq_hz"), flags.alias("quality_flags"),
    )


def anomaly_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomaly summaries for the quality rules: values above 150 are serious, above 100 odd."""
    events = table(spark, sf_dir, "events").withColumn("task_id", F.when(F.col("event_type") == "click", "T12").when(F.col("event_type") == "view", "T22").when(F.col("event_type") == "purchase", "T32"))
    share = lambda limit, task=None: F.try_divide(F.count_if((F.col("value") > limit) & (F.lit(True) if task is None else F.col("task_id") == task)).cast("double"), F.count("*") if task is None else F.count_if(F.col("task_id") == task))
    return events.groupBy(F.format_string("T%03d", "user_id").alias("Subject")).agg(
        share(150).alias("SeriousAnomalyFraction"), share(100).alias("AllAnomalyFraction"), *[share(limit, t).alias(f"{t}_{k}") for k, limit in (("SeriousFrac", 150), ("AllFrac", 100)) for t in ("T12", "T22", "T32")], F.lit("").alias("Flags")
    )


def box_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, path, left, top, right, bottom, method from lineitem; a subject has a few to dozens."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        F.col("l_suppkey").alias("subject"), F.format_string("%012d-%02d-%d-%.2f-%.0f", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").alias("path"), F.col("l_quantity").alias("left"), (F.col("l_discount") * 1000).alias("top"),
        (F.col("l_quantity") + 400).alias("right"), (F.col("l_tax") * 1000 + 500).alias("bottom"), F.when(F.col("l_returnflag") == "N", "opencv_haar").otherwise("fallback_complete_visible_face").alias("method"),
    )
