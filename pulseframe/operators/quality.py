"""Grades every subject and condition as keep, review or drop."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.functions.labels import TASKS, subject_order
from pulseframe.functions.values import guarded, number

FEATURES = ["condition", "n_samples", "duration_sec", "ecg_mean", "ecg_std", "ecg_min", "ecg_max", "n_peaks", "peak_rate_per_min", "mean_ibi_ms", "cv_ibi_pct", "lf_hf_ratio", "dominant_freq_hz", "quality_flags"]


@dataclass(frozen=True)
class Limits:
    duration: float = 60.0
    std: float = 1.0
    rate: tuple[float, float] = (30.0, 200.0)
    serious: tuple[float, float] = (0.001, 0.01)  #: review from, drop from
    all: tuple[float, float] = (0.02, 0.10)


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, F.struct(*[c for c in df.columns if c not in (*keys, *order)]).alias("_rest"))).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in order], "_best._rest.*").select(*df.columns)


def _rules(limits: Limits) -> list[tuple[str, str, Column]]:
    """(level, reason, condition) in order; a feature that is missing or NaN breaks no rule."""
    has = lambda flag: F.coalesce(F.contains(F.col("quality_flags"), F.lit(flag)), F.lit(False))
    col, rate = F.col, F.col("peak_rate_per_min")

    def between(name: str, low: float, high: float | None) -> Column:
        share = col(name)
        return guarded((share >= low) & (share < high) if high is not None else share >= low, share)

    (s_review, s_drop), (a_review, a_drop) = limits.serious, limits.all
    return [
        ("drop", "too_short_duration", has("too_short")),
        ("drop", "flatline_signal", has("flatline_signal")),
        ("drop", "too_few_peaks", has("too_few_peaks")),
        ("review", "short_duration_(<60s)", guarded(col("duration_sec") < limits.duration, col("duration_sec"))),
        ("review", "high_variation", guarded(col("ecg_std") > limits.std, col("ecg_std"))),
        ("review", "abnormal_peak_rate", (F.coalesce(col("n_peaks"), F.lit(0)) > 0) & guarded((rate < limits.rate[0]) | (rate > limits.rate[1]), rate)),
        ("drop", "high_serious_anomaly_fraction_(>=1%)", between("serious_fraction", s_drop, None)),
        ("review", "elevated_serious_anomaly_fraction_(>=0.1%)", between("serious_fraction", s_review, s_drop)),
        ("drop", "high_all_anomaly_fraction_(>=10%)", between("all_fraction", a_drop, None)),
        ("review", "elevated_all_anomaly_fraction_(>=2%)", between("all_fraction", a_review, a_drop)),
    ]


def grade(features: DataFrame, anomalies: DataFrame, limits: Limits = Limits(), tasks: tuple[str, ...] = TASKS, strict: bool = False) -> DataFrame:
    """features(user_id, task_id, file, ...) and ecg_summary rows -> one row per subject and task.

    Of several rows of a subject and task that of the smallest file counts; of a subject's anomaly rows one counts. A
    task's own anomaly fraction counts before the subject's; one of exactly zero is taken as missing unless strict."""
    first = first_rows(features.select("user_id", "task_id", "file", *FEATURES), ["user_id", "task_id"], ["file"])
    every = features.select("user_id").distinct().withColumn("task_id", F.explode(F.array(*map(F.lit, tasks))))
    summary = anomalies.groupBy(F.col("Subject").alias("user_id")).agg(F.max(F.struct(*[c for c in anomalies.columns if c != "Subject"])).alias("a"))
    rows = every.join(first.withColumn("_there", F.lit(True)), ["user_id", "task_id"], "left").join(summary, "user_id", "left")
    for name, suffix, whole in (("serious_fraction", "SeriousFrac", "SeriousAnomalyFraction"), ("all_fraction", "AllFrac", "AllAnomalyFraction")):
        own = F.coalesce(*[F.when(F.col("task_id") == t, number(F.col(f"a.{t}_{suffix}"))) for t in tasks])
        rows = rows.withColumn(name, F.coalesce(own if strict else F.nullif(own, F.lit(0.0)), number(F.col(f"a.{whole}"))))
    rules = F.array_compact(F.array(*[F.when(held, F.struct(F.lit(level).alias("level"), F.lit(reason).alias("reason"))) for level, reason, held in _rules(limits)]))
    missing = F.array(F.struct(F.lit("drop").alias("level"), F.lit("missing_feature_row").alias("reason")))
    rows = rows.withColumn("_broken", F.when(F.col("_there"), rules).otherwise(missing))
    worst = F.when(F.array_contains(F.transform("_broken", lambda x: x["level"]), "drop"), "drop").when(F.size("_broken") > 0, "review").otherwise("keep")
    return rows.select("user_id", "task_id", worst.alias("recommendation"), F.array_join(F.transform("_broken", lambda x: x["reason"]), ";").alias("reasons"), *FEATURES, "serious_fraction", "all_fraction", F.col("a.Flags").alias("anomaly_flags"))


def subject_status(graded: DataFrame) -> DataFrame:
    counts = graded.groupBy("user_id").agg(*[F.count_if(F.col("recommendation") == x).alias(f"{x}_count") for x in ("keep", "review", "drop")])
    status = F.when((F.col("review_count") == 0) & (F.col("drop_count") == 0), "ok").when(F.col("drop_count") >= 2, "drop").otherwise("review")
    return counts.withColumn("status", status)


def reason_histogram(graded: DataFrame, only: str | None = None) -> DataFrame:
    """reason, n over all rows, or those with one recommendation."""
    rows = graded if only is None else graded.where(F.col("recommendation") == only)
    return rows.select(F.explode(F.split("reasons", ";")).alias("reason")).select(F.trim("reason").alias("reason")).where("reason <> ''").groupBy("reason").agg(F.count("*").alias("n"))


def in_report_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(subject_order(F.col("user_id")), "user_id", "task_id")


def without_combined(features: DataFrame) -> DataFrame:
    """Features of split recordings only: the combined file also looks like one of T12."""
    return features.where(~F.contains(F.col("file"), F.lit("_T12_T22_T32_")))


def missing_from(wanted: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.select(*keys).distinct().join(found, keys, "left_anti")


def with_status(spine: DataFrame, files: DataFrame, status: str) -> DataFrame:
    """subject, files, status: `ok`, or the given word for subjects of the spine without files."""
    counts = files.groupBy("subject").agg(F.count("*").alias("files"))
    met = spine.select("subject").distinct().join(counts, "subject", "left")
    return met.select("subject", F.coalesce("files", F.lit(0)).alias("files"), F.when(F.col("files").isNull(), F.lit(status)).otherwise("ok").alias("status"))


def evenly_spaced(files: DataFrame, keys: list[str], order: str, count: int = 15) -> DataFrame:
    """At most `count` rows of each group, evenly over their order: places i * (n - 1) / (count - 1), cut off."""
    numbered = files.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    sizes = files.groupBy(*keys).agg(F.count("*").alias("_n"))
    chosen = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / F.lit(count - 1)))
    met = numbered.join(sizes, keys).where((F.col("_n") <= count) | F.array_contains(chosen, F.col("_i").cast("long")))
    return met.drop("_i", "_n")
