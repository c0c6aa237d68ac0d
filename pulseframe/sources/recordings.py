"""Reads raw and processed recordings.

Samples are numbered by the place of their line: `row` in its file, `seq` over all files of a subject in order of their
names, both from 0. All columns are read as text; bad values go to an errors frame instead of failing the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseframe.functions import labels, times
from pulseframe.functions.values import parsed
from pulseframe.operators.ordered import BLOCK, number_rows
from pulseframe.sources.lines import csv_cells, literal

CHANNELS = [f"raw ecg{i}" for i in range(1, 51)]
RESISTANCE = "Resistance(Koum)"
NPY_COLUMNS = ["Timestamp", RESISTANCE, "Trigger"]
LEAST_BYTES = 20 * 1024  #: smaller .npy files hold no recording


def _numbers(names: list[str]) -> Column:
    return F.array(*[F.expr(f"try_cast(`{c}` AS double)") for c in names])


def ecg_rows(spark: SparkSession, paths: str | list[str], positional: bool = False) -> DataFrame:
    """subject, file, row, seq, t, samples array<double>, trigger. positional: first column time, the next 50 samples, the
    last the trigger, whatever their names."""
    samples = {f"s{i}": i + 1 if positional else name for i, name in enumerate(CHANNELS)}
    rows = csv_cells(spark, paths, {"time": 0 if positional else "Timestamp", "trigger": -1 if positional else "Trigger"} | samples)
    return rows.select("subject", "file", "row", "seq", times.micros(times.parse(F.col("time"))).alias("t"), _numbers(list(samples)).alias("samples"), "trigger")


def gsr_rows(spark: SparkSession, paths: str | list[str], positional: bool = False) -> DataFrame:
    """subject, file, row, seq, t, value, trigger."""
    rows = csv_cells(spark, paths, {"time": 0, "value": 1, "trigger": -1} if positional else {"time": "Timestamp", "value": RESISTANCE, "trigger": "Trigger"})
    return rows.select("subject", "file", "row", "seq", times.micros(times.parse(F.col("time"))).alias("t"), parsed(F.col("value")).alias("value"), "trigger")


def trigger_rows(rows: DataFrame) -> DataFrame:
    """Rows whose trigger is neither empty nor `null`, trimmed; with their seq, the index of a label's rows over all files."""
    trimmed = F.trim("trigger")
    return rows.withColumn("trigger", trimmed).where((trimmed != "") & (trimmed != "null"))


def processed_rows(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Processed signals (Timestamp, Data, Trust): good rows (subject, task, file, row, t, value, trust), and errors
    (subject, file, row, reason, data), row being the line in the file, its header the first. A row is good only if time
    and value both are."""
    rows = csv_cells(spark, paths, {c: c for c in ("Timestamp", "Data", "Trust")}).withColumn("row", F.col("row") + 2)
    rows = rows.withColumn("t", times.micros(times.parse(F.col("Timestamp")))).withColumn("value", parsed(F.col("Data")))
    task = F.coalesce(F.nullif(F.regexp_extract("file", r"(?i)_(T(?:12|22|32))_(?:low|medium|high)[^/]*(?:/part-[^/]*)?$", 1), F.lit("")), F.lit("all"))
    rows = rows.withColumn("task", F.upper(task))
    good = rows.where("t IS NOT NULL AND value IS NOT NULL").select("subject", "task", "file", "row", "t", "value", F.col("Trust").alias("trust"))
    reason = F.when(F.col("t").isNull(), F.concat(F.lit("bad time: "), F.coalesce("Timestamp", F.lit("")))).otherwise(F.concat(F.lit("bad value: "), F.coalesce("Data", F.lit(""))))
    bad = rows.where("t IS NULL OR value IS NULL").select("subject", "file", "row", labels.message(reason).alias("reason"), F.col("Data").alias("data"))
    return good, bad


def npy_rows(spark: SparkSession, paths: str | list[str], least_bytes: int = LEAST_BYTES, trusted: bool = False) -> DataFrame:
    """subject, file, row, t, value, trigger of 2-D arrays in .npy files above a size. The first row is a header if its
    first cell is text that is no time. Arrays of objects are pickled and run code when loaded: only if trusted."""
    files = spark.read.format("binaryFile").load(literal(spark, paths)).where(F.col("length") > least_bytes).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                table = np.load(io.BytesIO(content), allow_pickle=trusted)
                if table.ndim != 2:
                    raise ValueError(f"{table.ndim} dimensions instead of 2")
                head = [str(x) for x in table[0]] if len(table) else []
                named = bool(head) and isinstance(table[0][0], str) and not head[0][:1].isdigit()
                names = head if named else NPY_COLUMNS[: table.shape[1]]
                body = pd.DataFrame(table[1:] if named else table, columns=names).reindex(columns=NPY_COLUMNS)
                text = body.map(lambda x: None if x is None or x != x else str(x))
                yield pd.DataFrame({"file": path, "row": np.arange(len(text)), "time": text[NPY_COLUMNS[0]], "number": text[RESISTANCE], "raw": text["Trigger"]})

    rows = files.mapInPandas(run, "file string, row long, time string, number string, raw string")
    return rows.select(F.upper(labels.path_subject(F.col("file"))).alias("subject"), "file", "row", times.micros(times.parse(F.col("time"))).alias("t"), parsed(F.col("number")).alias("value"), labels.trigger(F.col("raw")).alias("trigger"))


def in_file_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sets seq, dense from 0 over a series' files in order of their names, and their rows: of the rows that are left."""
    rows = number_rows(rows.drop("seq"), [*keys, "file"], ["row"], F.expr(f"row div {BLOCK}"), "_r")
    sizes = rows.groupBy(*keys, "file").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes.select(*keys, "file", before.alias("_before")), [*keys, "file"]).withColumn("seq", F.col("_r") + F.col("_before")).drop("_r", "_before")


def subjects(rows: DataFrame, first: int | None = None, last: int | None = None, names: list[str] | None = None, without: list[str] = ()) -> DataFrame:
    """Rows of a range or list of subjects."""
    n = labels.subject_number(F.col("subject"))
    kept = F.lit(True)
    if first is not None or last is not None:
        kept = (n >= F.lit(first) if first is not None else kept) & (n <= F.lit(last) if last is not None else F.lit(True))
    if names is not None:
        kept = kept & F.col("subject").isin(*[x.upper() for x in names])
    return rows.where(kept & ~F.col("subject").isin(*without) if without else kept)
