"""Segments as MAT files of level 5: tagged elements, compressed or not, in either byte order.

A file holds one struct, mat_dict, with the fields data and Timestamp (a row per sample), task_id and user_id. Files are bytes
in frames, so they go wherever Spark's readers and writers reach."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.functions import labels, times
from pulseframe.operators.resample import last_of_trigger
from pulseframe.sources.lines import literal

NAME = "mat_dict"
#: Fixed values of the format: element types with their numpy codes, and classes of arrays.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
TEXTS = {16: "utf-8", 17: "utf-16", 18: "utf-32"}
INT8, UINT16, INT32, UINT32, DOUBLE, MATRIX, COMPRESSED = 1, 4, 5, 6, 9, 14, 15
CELL, STRUCT, CHAR, DOUBLES = 1, 2, 4, 6
FIELD_WIDTH = 32  #: bytes of a field's name, the last one zero


def _element(kind: int, data: bytes) -> bytes:
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def _array(kind: int, shape: tuple[int, int], rest: bytes, name: str = "") -> bytes:
    head = _element(UINT32, struct.pack("<II", kind, 0)) + _element(INT32, struct.pack("<2i", *shape)) + _element(INT8, name.encode("ascii"))
    return _element(MATRIX, head + rest)


def _value(x: np.ndarray | str | list[str]) -> bytes:
    """A column of numbers, a text, or a text a row."""
    if isinstance(x, np.ndarray):
        return _array(DOUBLES, (len(x), 1), _element(DOUBLE, x.astype("<f8").tobytes()))
    rows = [x] if isinstance(x, str) else x
    width = max(map(len, rows), default=0)
    codes = np.array([list(map(ord, r.ljust(width))) for r in rows], "<u2").reshape(len(rows), width)
    return _array(CHAR, codes.shape, _element(UINT16, codes.tobytes(order="F")))


def encode(fields: dict[str, np.ndarray | str | list[str]], name: str = NAME) -> bytes:
    """A file with one struct, compressed."""
    names = b"".join(k.encode("ascii").ljust(FIELD_WIDTH, b"\0") for k in fields)
    whole = _array(STRUCT, (1, 1), _element(INT32, struct.pack("<i", FIELD_WIDTH)) + _element(INT8, names) + b"".join(map(_value, fields.values())), name)
    packed = zlib.compress(whole)
    return b"MATLAB 5.0 MAT-file".ljust(116) + b" " * 8 + struct.pack("<H2s", 0x0100, b"IM") + struct.pack("<II", COMPRESSED, len(packed)) + packed


class _Reader:
    def __init__(self, data: bytes, order: str):
        self.data, self.order, self.at = data, order, 0

    def more(self) -> bool:
        return self.at + 8 <= len(self.data)

    def element(self) -> tuple[int, bytes]:
        """Type and bytes of the next element; short ones lie in their tag."""
        first, size = struct.unpack_from(f"{self.order}II", self.data, self.at)
        if first >> 16:
            kind, size, start = first & 0xFFFF, first >> 16, self.at + 4
            self.at += 8
        else:
            kind, start = first, self.at + 8
            self.at = start + size + (-size % 8 if kind != COMPRESSED else 0)
        return kind, self.data[start : start + size]

    def numbers(self) -> np.ndarray:
        kind, data = self.element()
        return np.frombuffer(data, self.order + NUMBERS[kind])

    def text(self) -> np.ndarray:
        """Code points."""
        kind, data = self.element()
        if kind in TEXTS:
            ending = {"<": "-le", ">": "-be"}[self.order] if kind != 16 else ""
            return np.array(list(map(ord, data.decode(TEXTS[kind] + ending))), np.uint32)
        return np.frombuffer(data, self.order + NUMBERS[kind]).astype(np.uint32)

    def array(self):
        """The name and value of the array whose bytes these are: numbers as an array, texts as a text or a list of rows, cells as
        a list, a struct as a dict."""
        kind = int(self.numbers()[0]) & 0xFF
        shape = tuple(self.numbers().tolist())
        name = self.element()[1].decode("ascii", "replace")
        inner = lambda: _Reader(self.element()[1], self.order).array()[1]
        if kind == CELL:
            return name, [inner() for _ in range(int(np.prod(shape)))]
        if kind == STRUCT:
            width = int(self.numbers()[0])
            raw = self.element()[1]
            names = [raw[i : i + width].split(b"\0")[0].decode("ascii", "replace") for i in range(0, len(raw), width)]
            return name, {k: inner() for k in names}
        if kind == CHAR:
            rows = self.text().reshape(shape, order="F") if np.prod(shape) else np.zeros((0, 0), np.uint32)
            texts = ["".join(map(chr, r)).rstrip() for r in rows.tolist()]
            return name, texts[0] if len(texts) == 1 else texts if texts else ""
        return name, self.numbers().astype(np.float64).reshape(shape, order="F")


def decode(data: bytes) -> dict:
    """The arrays of a file by name."""
    if len(data) < 128 or data[126:128] not in (b"IM", b"MI"):
        raise ValueError("no MAT file of level 5")
    order = "<" if data[126:128] == b"IM" else ">"
    outer, out = _Reader(data[128:], order), {}
    while outer.more():
        kind, part = outer.element()
        if kind == COMPRESSED:
            kind, part = _Reader(zlib.decompress(part), order).element()
        if kind == MATRIX and part:
            name, value = _Reader(part, order).array()
            out[name] = value
    return out


def mat_files(segments: DataFrame) -> DataFrame:
    """segments(subject, segment, task, idx, t, value) -> path (`number_task.mat`), file: of the segments of one task the last."""
    last = last_of_trigger(segments.select("subject", "segment", F.col("task").alias("trigger")).distinct(), ["subject"])
    kept = segments.join(last.select("subject", "segment", F.col("trigger").alias("task")), ["subject", "segment", "task"], "left_semi")
    number = F.coalesce(labels.subject_number(F.col("subject")).cast("string"), F.col("subject"))
    rows = F.array_sort(F.collect_list(F.struct("idx", "value", times.text_ms(F.col("t"), short_year=True).alias("time"))))
    whole = kept.groupBy(number.alias("user_id"), F.col("task").alias("task_id")).agg(rows.alias("rows")).select("user_id", "task_id", "rows.value", "rows.time")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            files = [encode({"data": np.array(r.value, float), "Timestamp": list(r.time), "task_id": r.task_id, "user_id": r.user_id}) for r in batch.itertuples()]
            yield pd.DataFrame({"path": [f"{r.user_id}_{r.task_id}.mat" for r in batch.itertuples()], "file": files})

    return whole.mapInPandas(run, "path string, file binary")


def read_mat(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, content of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(literal(spark, paths)).where(F.lower("path").endswith(".mat")).select("path", "content")


def mat_rows(files: DataFrame) -> DataFrame:
    """files(path, content) -> path, user_id, task_id, idx, t, value, error: a row per sample; a file that can't be read is a row
    with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    held = decode(bytes(content))[NAME]
                    value, stamps = np.asarray(held["data"], float).ravel(), held["Timestamp"]
                    stamps = [stamps] if isinstance(stamps, str) else list(stamps)
                    frame = pd.DataFrame({"idx": np.arange(len(value)), "time": (stamps + [None] * len(value))[: len(value)], "value": value}).assign(user_id=str(held["user_id"]), task_id=str(held["task_id"]), error=None)
                except Exception as e:
                    frame = pd.DataFrame({"idx": [None], "time": [None], "value": [None], "user_id": [None], "task_id": [None], "error": [(str(e) or type(e).__name__)[:200]]})
                yield frame.assign(path=path).astype({"idx": "Int64"})[["path", "user_id", "task_id", "idx", "time", "value", "error"]]

    rows = files.mapInPandas(run, "path string, user_id string, task_id string, idx long, time string, value double, error string")
    return rows.select("path", "user_id", "task_id", "idx", times.micros(times.parse(F.col("time"))).alias("t"), "value", "error")
