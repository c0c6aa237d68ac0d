"""Queries that write recordings as files and read them back, and rules over names and series, with their DuckDB SQL.

Files go to the session's shared scratch folder, a folder for each subject as raw recordings have it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.functions import labels, times
from pulseframe.operators import expand, quality, stats
from pulseframe.operators.ordered import number_rows, with_previous
from pulseframe.plans import proxies
from pulseframe.sources import recordings, sinks
from pulseframe.sources.tables import scratch_path

#: Folders above those of subjects, and event types with the subjects they stand for.
FOLDERS = {"T001": "a b", "T002": "p[1]", "T003": "x%20y", "T004": "q{1}", "T005": "a+b"}
SUBJECTS = {"click": "T001", "error": "T002", "purchase": "T003", "signup": "T004", "view": "T005"}


def _subject():
    return F.coalesce(*[F.when(F.col("subject") == k, v) for k, v in SUBJECTS.items()])


def raw_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """Raw skin-resistance recordings as CSV, a folder a subject, some with characters that patterns and addresses use;
    T002's columns stand in another order."""
    rows = proxies.raw_events(spark, sf_dir).withColumn("subject", _subject())
    text = rows.select("subject", "seq", times.text_ms(F.col("t")).alias("Timestamp"), F.col("value").cast("string").alias(recordings.RESISTANCE), F.col("trigger").alias("Trigger"))
    top = scratch_path(spark, "recordings")
    for subject in SUBJECTS.values():  # one write a folder, as recordings come
        columns = ["Timestamp", "Trigger", recordings.RESISTANCE] if subject == "T002" else ["Timestamp", recordings.RESISTANCE, "Trigger"]
        sinks.write_csv(text.where(F.col("subject") == subject).orderBy("seq"), f"{top}/{FOLDERS[subject]}/{subject}/raw", columns)
    return [f"{top}/{FOLDERS[subject]}/{subject}/raw" for subject in SUBJECTS.values()]


def csv_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recordings.gsr_rows(spark, raw_files(spark, sf_dir)).select("subject", "t", "value", "trigger")


def csv_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recordings.trigger_rows(recordings.gsr_rows(spark, raw_files(spark, sf_dir)))
    return found.groupBy("subject", "trigger").agg(F.count("*").alias("n"), F.min("t").alias("first_t"))


def csv_subject_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recordings.gsr_rows(spark, raw_files(spark, sf_dir))
    kept = recordings.subjects(rows, first=2, without=["T004"])
    return kept.groupBy("subject").agg(F.count("*").alias("n"))


def processed_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six decimals out, and in again; one value in 97 is no number and one time in 101 none."""
    rows = proxies.raw_events(spark, sf_dir)
    clean = rows.withColumn("trigger", F.when(F.col("seq") % 101 == 0, "T32").when(F.col("seq") % 97 == 0, "T22").otherwise("T12"))
    text = sinks.processed_csv(clean)
    mark = lambda t: F.col("Trust").eqNullSafe(labels.label(F.lit(t), "en"))
    spoilt = text.select(F.when(mark("T32"), "no time").otherwise(F.col("Timestamp")).alias("Timestamp"), F.when(mark("T22"), "low").otherwise(F.col("Data")).alias("Data"), "Trust")
    top = scratch_path(spark, "processed")
    sinks.write_csv(spoilt, f"{top}/T007/signal")
    good, bad = recordings.processed_rows(spark, f"{top}/T007/signal")
    found = good.select("subject", "t", "value", F.lit(None).cast("string").alias("reason"))
    return found.unionByName(bad.select("subject", F.lit(None).cast("long").alias("t"), F.lit(None).cast("double").alias("value"), F.substring_index("reason", ":", 1).alias("reason")))


def partitioned_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = proxies.signal(spark, sf_dir).where("task IS NOT NULL")
    rows = rows.select("subject", F.lit("gsr").alias("modality"), "task", "idx", "t", "value", F.lit("good").alias("trust"))
    path = scratch_path(spark, "signal")
    sinks.write_signal(rows, path)
    return spark.read.parquet(path).where("task = 'T22'").select("subject", "modality", "task", "idx", "t", "value")


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of file names made of events."""
    events = proxies.raw_events(spark, sf_dir)
    path = F.format_string("/data/T%03d/x/%s_ECG_%s.csv", F.col("seq") % 7, _subject(), F.coalesce("task", F.lit("other")))
    named = events.select("seq", path.alias("path"))
    return named.select(
        "seq", labels.stem(F.col("path")).alias("stem"), labels.field(F.col("path"), 1).alias("modality"), labels.suffix_task(F.col("path")).alias("task"), labels.path_subject(F.col("path")).alias("subject"),
        labels.subject_number(labels.path_subject(F.col("path"))).alias("number"), labels.safe_name(F.concat(F.lit("a b/"), labels.field(F.col("path"), 0))).alias("safe"),
    )


def robust_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.median_and_mad(proxies.signal(spark, sf_dir), ["subject"], "value"))


def quantiles_with_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value of 1e12 beside all others: buckets are cut again."""
    rows = proxies.signal(spark, sf_dir).withColumn("value", F.when((F.col("subject") == "view") & (F.col("idx") == 0), 1e12).otherwise(F.col("value")))
    return rounded(stats.quantiles(rows, ["subject"], "value", {"p005": 0.005, "p50": 0.5, "p90": 0.9, "p95": 0.95}, largest=16))


def rate_or_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of series whose seconds are milliseconds; under 2 there is none."""
    rows = with_previous(proxies.signal(spark, sf_dir), ["subject"], "idx", {"previous_t": "t"})
    faster = rows.withColumns({c: F.floor(F.col(c) / 10_000).cast("long") for c in ("t", "previous_t")})
    return expand.sampling_rate(faster, ["subject"], "t", "previous_t", None)


def area_under_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trapezoids between neighbours, in value hours."""
    rows = with_previous(proxies.signal(spark, sf_dir), ["subject"], "idx", {"previous_t": "t", "previous": "value"})
    area = (F.col("value") + F.col("previous")) / 2 * (F.col("t") - F.col("previous_t")) / 3.6e9
    return rounded(rows.groupBy("subject").agg(F.sum(area).alias("area")), 4)


def first_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a plot of one subject shows of its first 100 samples."""
    rows = proxies.signal(spark, sf_dir).withColumn("reasons", F.when(F.col("value") > 100, F.array(F.lit("high"))).otherwise(F.array().cast("array<string>")))
    return rounded(sinks.plot_series(rows, "view", 10.0, 10.0))


def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_counts(proxies.raw_events(spark, sf_dir), "task").select(F.coalesce("task", F.lit("none")).alias("task"), "n")


def numbered_in_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = proxies.raw_events(spark, sf_dir)
    return number_rows(rows, ["subject"], ["seq"], F.expr("seq div 1000")).select("subject", "seq", "idx")


def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = proxies.table(spark, sf_dir, "events").select(F.format_string("T%03d", "user_id").alias("user_id"), F.lit("T12").alias("task_id")).distinct()
    return quality.in_report_order(users).limit(20)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


QUERIES = {
    f.__name__: f
    for f in (csv_recordings, csv_triggers, csv_subject_range, processed_recordings, partitioned_signal, file_names, robust_spread, quantiles_with_outlier, rate_or_none, area_under_signal, first_hours, value_counts, numbered_in_series, report_order)
}

_SUBJECT = "CASE event_type WHEN 'click' THEN 'T001' WHEN 'error' THEN 'T002' WHEN 'purchase' THEN 'T003' WHEN 'signup' THEN 'T004' WHEN 'view' THEN 'T005' END"
_TASK = "CASE user_id % 4 WHEN 0 THEN 'T12' WHEN 1 THEN 'T22' WHEN 2 THEN 'T32' END"
_TRIGGER = "(['T12', ' T12 ', 't12', 'null', 'anxitey', 'terrify', 'base.', 'T22', 'T32 ', 'drive'])[((user_id // 8) % 10 + 1)::INT]"
_RAW = f"SELECT event_id AS seq, event_type, {_SUBJECT} AS subject, epoch_us(ts) AS t, epoch_us(ts) // 1000 * 1000 AS ms, value, user_id, {_TASK} AS task, {_TRIGGER} AS trigger FROM events"
_SIGNAL = f"SELECT event_type AS subject, row_number() OVER (PARTITION BY event_type ORDER BY seq) - 1 AS idx, t, value, task FROM ({_RAW})"

ORACLES = {
    "csv_recordings": f"SELECT subject, ms AS t, value, trim(trigger) AS trigger FROM ({_RAW})",
    "csv_triggers": f"SELECT subject, trim(trigger) AS trigger, count(*) AS n, min(ms) AS first_t FROM ({_RAW}) WHERE trim(trigger) NOT IN ('', 'null') GROUP BY ALL",
    "csv_subject_range": f"SELECT subject, count(*) AS n FROM ({_RAW}) WHERE subject IN ('T002', 'T003', 'T005') GROUP BY ALL",
    "processed_recordings": f"""
SELECT 'T007' AS subject, CASE WHEN bad IS NULL THEN (t + 500) // 1000 * 1000 END AS t, CASE WHEN bad IS NULL THEN round(value, 6) END AS value, bad AS reason
FROM (SELECT *, CASE WHEN seq % 101 = 0 THEN 'bad time' WHEN seq % 97 = 0 THEN 'bad value' END AS bad FROM ({_RAW}))""",
    "partitioned_signal": f"SELECT subject, 'gsr' AS modality, task, idx, t, value FROM ({_SIGNAL}) WHERE task = 'T22'",
    "file_names": f"""
SELECT seq, subject || '_ECG_' || coalesce(task, 'other') AS stem, 'ECG' AS modality, coalesce(task, 'UNKNOWN') AS task, format('T{{:03d}}', seq % 7) AS subject, (seq % 7)::INT AS number, 'ab' || subject AS safe FROM ({_RAW})""",
    "robust_spread": f"""
WITH s AS ({_SIGNAL}), m AS (SELECT subject, count(value) AS n, median(value) AS med FROM s GROUP BY subject)
SELECT subject, any_value(n) AS n, round(any_value(med), 6) AS med, round(median(abs(value - med)), 6) AS mad FROM s JOIN m USING (subject) GROUP BY subject""",
    "quantiles_with_outlier": f"""
SELECT subject, count(v) AS n, round(quantile_cont(v, 0.005), 6) AS p005, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.95), 6) AS p95
FROM (SELECT subject, CASE WHEN subject = 'view' AND idx = 0 THEN 1e12 ELSE value END AS v FROM ({_SIGNAL})) GROUP BY subject""",
    "rate_or_none": f"""
WITH d AS (SELECT subject, (t // 10000 - lag(t // 10000) OVER (PARTITION BY subject ORDER BY idx)) / 1e6 AS step FROM ({_SIGNAL})),
r AS (SELECT subject, round_even(1 / median(step), 0) AS rate FROM d WHERE step > 0 GROUP BY subject)
SELECT subject, CASE WHEN rate >= 2 THEN rate END AS rate FROM (SELECT DISTINCT event_type AS subject FROM events) LEFT JOIN r USING (subject)""",
    "area_under_signal": f"""
SELECT subject, round(sum(a), 4) AS area FROM (SELECT subject, (value + lag(value) OVER w) / 2 * (t - lag(t) OVER w) / 3.6e9 AS a FROM ({_SIGNAL}) WINDOW w AS (PARTITION BY subject ORDER BY idx)) GROUP BY subject""",
    "first_hours": f"SELECT round(idx / 600.0, 6) AS minute, round(value, 6) AS value, value > 100 AS odd FROM ({_SIGNAL}) WHERE subject = 'view' AND idx < 100",
    "value_counts": f"SELECT coalesce(task, 'none') AS task, count(*) AS n FROM ({_RAW}) GROUP BY ALL",
    "numbered_in_series": f"SELECT event_type AS subject, seq, row_number() OVER (PARTITION BY event_type ORDER BY seq) - 1 AS idx FROM ({_RAW})",
    "report_order": "SELECT format('T{:03d}', user_id) AS user_id, 'T12' AS task_id FROM (SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT 20)",
}
