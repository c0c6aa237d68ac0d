"""Writes results: Parquet and CSV by Spark, small reports on the driver."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.functions import labels, times
from pulseframe.operators import quality


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "overwrite") -> None:
    """With a header; only the columns named, in their order."""
    (df.select(*columns) if columns else df).write.mode(mode).option("header", True).csv(path)


def write_signal(signal: DataFrame, path: str, mode: str = "overwrite") -> None:
    """signal(subject, modality, task, idx, t, value, trust), a folder for each subject, modality and task."""
    signal.repartition("subject", "modality", "task").sortWithinPartitions("subject", "modality", "task", "idx").write.mode(mode).partitionBy("subject", "modality", "task").parquet(path)


def processed_csv(signal: DataFrame, mode: str = "en") -> DataFrame:
    """signal(t, value, trigger, ...) as processed files have it: Timestamp, Data, Trust."""
    return signal.select(times.text_ms(times.rounded_ms(F.col("t"))).alias("Timestamp"), F.format_string("%.6f", "value").alias("Data"), labels.label(F.col("trigger"), mode).alias("Trust"))


def write_splits(signal: DataFrame, path: str, mode: str = "en", tasks: tuple[str, ...] = labels.TASKS) -> None:
    """signal(t, value, trigger, idx) as processed CSV: all of it under `combined`, and each task's rows apart, a header alone for
    a task without any."""
    for name, rows in {"combined": signal, **{t: signal.where(F.trim("trigger") == t) for t in tasks}}.items():
        ordered = rows.repartitionByRange("idx").sortWithinPartitions("idx")
        write_csv(processed_csv(ordered.withColumn("trigger", F.trim("trigger")), mode), f"{path}/{name}")


def write_face_tables(features: DataFrame, path: str) -> None:
    """Eye, shape and action-unit tables, and the failed images, from one features frame with an error column."""
    base = ["image_name", "subject_id", "task_id", "condition"]
    good = features.where("error IS NULL")
    for name, prefix in (("ear", "ear_"), ("face3d", "face3d_"), ("au", "au")):
        good.select(*base, *[c for c in features.columns if c.startswith(prefix)]).write.mode("overwrite").parquet(f"{path}/{name}")
    features.where("error IS NOT NULL").select("image_name", labels.message(F.col("error")).alias("reason")).write.mode("overwrite").parquet(f"{path}/failed")


def write_quality_tables(graded: DataFrame, path: str) -> None:
    """All grades, those to discard, those to review, and a status for each subject."""
    tables = {"detail": graded, "discard": graded.where("recommendation = 'drop'"), "review": graded.where("recommendation = 'review'"), "summary": quality.subject_status(graded)}
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def html_table(rows: DataFrame, title: str, most: int | None = None) -> str:
    """A page with the frame's rows, for summaries of one row per subject; most: only the first so many, which the page says."""
    cell = lambda x: html.escape("" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in rows.columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(x)}</td>" for x in r) + "</tr>" for r in (rows if most is None else rows.limit(most)).collect())
    note = "" if most is None else f"<p>The first {most} rows at most.</p>"
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{note}<table><tr>{head}</tr>{body}</table>"


def quality_report(graded: DataFrame, status: DataFrame, reasons: DataFrame, most: int = 10) -> str:
    """Counts of recommendations, of subjects by status, and the most frequent reasons, as Markdown."""
    total = max(1, graded.count())
    grades = {r.recommendation: r["count"] for r in graded.groupBy("recommendation").count().collect()}
    lines = ["# Quality of recordings", "", "| recommendation | recordings | share |", "|-|-|-|"]
    lines += [f"| {k} | {grades.get(k, 0)} | {grades.get(k, 0) / total:.1%} |" for k in ("keep", "review", "drop")]
    lines += ["", "| status | subjects |", "|-|-|", *[f"| {r.status} | {r['count']} |" for r in status.groupBy("status").count().orderBy("status").collect()]]
    lines += ["", "| reason | recordings |", "|-|-|", *[f"| {r.reason} | {r.n} |" for r in reasons.orderBy(F.desc("n"), "reason").limit(most).collect()]]
    return "\n".join(lines) + "\n"


def plot_series(signal: DataFrame, subject: str, seconds: float | None = None, rate: float = 200.0) -> DataFrame:
    """What a plot of one subject shows: minute, value, odd; seconds: the first so many."""
    rows = signal.where(F.col("subject") == subject)
    if seconds is not None:
        rows = rows.where(F.col("idx") < int(seconds * rate))
    return rows.select((F.col("idx") / rate / 60).alias("minute"), "value", (F.size("reasons") > 0).alias("odd"))
