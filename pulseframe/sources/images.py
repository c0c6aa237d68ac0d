"""Image files, their groups, crops and landmark tables. Detection models are plug-ins."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.functions import boxes, jpeg, labels
from pulseframe.operators.quality import evenly_spaced
from pulseframe.sources.lines import literal

IMAGE_NAME = r"(?i)T(?:12|22|32)\.(?:jpe?g|png|bmp)$"
#: Weights of red, green and blue in brightness.
LUMA = (0.299, 0.587, 0.114)
Detector = Callable[[np.ndarray], list[tuple[float, float, float, float]]]


def missing_model(kind: str) -> Callable:
    """Stands for a model that isn't installed."""

    def fail(*_args):
        raise RuntimeError(f"no {kind} model: pass a function from an image (rows of blue, green, red bytes) to its findings")

    return fail


def files(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """path, subject, task of image files named for a task; limit: the first so many paths."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(literal(spark, root)).where(F.col("path").rlike(IMAGE_NAME))
    named = found.select("path", F.upper(labels.path_subject(F.col("path"))).alias("subject"), labels.suffix_task(F.col("path")).alias("task"))
    return named if limit is None else named.orderBy("path").limit(max(0, limit))


def pixels(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """path, subject, task, height, width, channels, data (rows of blue, green, red), error: imread_failed for files that
    can't be read as images, which have no more than their names."""
    image = spark.read.format("image").option("dropInvalid", False).load(literal(spark, paths)).select("image.*")
    path, good = F.col("origin"), F.col("height") >= 0
    known = [F.when(good, F.col(c)).alias(name) for c, name in (("height", "height"), ("width", "width"), ("nChannels", "channels"), ("data", "data"))]
    return image.select(path.alias("path"), F.upper(labels.path_subject(path)).alias("subject"), labels.suffix_task(path).alias("task"), *known, F.when(~good, "imread_failed").alias("error"))


def _tried(row, run: Callable) -> tuple:
    """(run's finding in the row's image, None), or (None, what went wrong): one bad image is a row of the failure table."""
    if row.error:
        return None, row.error
    try:
        return run(np.frombuffer(row.data, np.uint8).reshape(int(row.height), int(row.width), int(row.channels))), None
    except Exception as e:
        return None, str(e)[:200]


def faces(images: DataFrame, detect: Detector = missing_model("face detection")) -> DataFrame:
    """path, subject, task, width, height, faces array<struct<x, y, w, h>>, error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tried = [_tried(r, lambda image: [dict(zip("xywh", map(float, f))) for f in detect(image)]) for r in batch.itertuples()]
            yield batch[["path", "subject", "task", "width", "height"]].assign(faces=[found or [] for found, _ in tried], error=[error for _, error in tried]).astype({"width": "Int32", "height": "Int32"})

    schema = "path string, subject string, task string, width int, height int, faces array<struct<x: double, y: double, w: double, h: double>>, error string"
    return images.select("path", "subject", "task", "height", "width", "channels", "data", "error").mapInPandas(run, schema)


def group_boxes(found: DataFrame, sample: int = 15) -> DataFrame:
    """faces() rows -> subject, task, image_count, box: the median of up to `sample` images' boxes; of three detected
    boxes or more only these count; without any image that could be read, the fallback."""
    w, h = F.col("width"), F.col("height")
    chosen = boxes.with_crop_box(evenly_spaced(found, ["subject", "task"], "path", sample).where("error IS NULL"), F.col("faces"), w, h)
    detected = F.count_if(F.col("box.method") == boxes.DETECTED)
    enough = chosen.groupBy("subject", "task").agg((detected >= 3).alias("_only"))
    used = chosen.join(enough, ["subject", "task"]).where("NOT _only OR box.method = 'opencv_haar'")
    medians = used.groupBy("subject", "task").agg(*[F.median(f"box.{c}").alias(c) for c in ("left", "top", "right", "bottom")], F.array_join(F.array_sort(F.collect_set("box.method")), "+").alias("_methods"))
    firsts = found.groupBy("subject", "task").agg(F.count("*").alias("image_count"), *[F.min_by(c, F.when(F.col("error").isNull(), F.col("path"))).alias(c) for c in ("width", "height")])
    met = firsts.join(medians, ["subject", "task"], "left")
    edges = {c: F.col(c) for c in ("left", "top", "right", "bottom")}
    return boxes.with_given_box(met, edges, w, h, F.concat(F.lit("group_"), F.col("_methods"))).select("subject", "task", "image_count", "box")


def _grey(image: np.ndarray) -> np.ndarray:
    return image[..., 0] if image.shape[2] == 1 else np.floor(image[..., :3] @ np.array(LUMA[::-1]) + 0.5).astype(np.uint8)


def grey_crops(images: DataFrame, group: DataFrame) -> DataFrame:
    """path, ok, message, width, height, grey (bytes, row by row): the group's box cut from each image's brightness.
    Encoding is left to the sink."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                cut, error = _tried(r, lambda image: _grey(image)[r.top : r.bottom, r.left : r.right])  # noqa: B023
                rows.append((r.path, False, error, None, None, None) if error else (r.path, True, "", cut.shape[1], cut.shape[0], cut.tobytes()))
            yield pd.DataFrame(rows, columns=["path", "ok", "message", "width", "height", "grey"]).astype({"width": "Int32", "height": "Int32"})

    met = images.join(group.select("subject", "task", "box.*"), ["subject", "task"])
    return met.select("path", "height", "width", "channels", "data", "error", "left", "top", "right", "bottom").mapInPandas(run, "path string, ok boolean, message string, width int, height int, grey binary")


def png(grey: bytes, width: int, height: int) -> bytes:
    """A grey image as a PNG file."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + grey[y * width : (y + 1) * width] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def png_files(crops: DataFrame) -> DataFrame:
    """grey_crops rows that are ok -> path, file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "file": [png(bytes(r.grey), r.width, r.height) for r in batch.itertuples()]})

    return crops.where("ok").select("path", "width", "height", "grey").mapInPandas(run, "path string, file binary")


def jpeg_files(crops: DataFrame, quality: int = 95) -> DataFrame:
    """grey_crops rows that are ok -> path, file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "file": [jpeg.encode(np.frombuffer(r.grey, np.uint8).reshape(r.height, r.width), quality) for r in batch.itertuples()]})

    return crops.where("ok").select("path", "width", "height", "grey").mapInPandas(run, "path string, file binary")


def _points(found) -> list[dict] | None:
    return None if found is None else [dict(zip("xyz", map(float, p))) for p in found]


def landmarks(images: DataFrame, detect: Callable = missing_model("landmark")) -> DataFrame:
    """path, subject, task, width, height, landmarks array<struct<x, y, z>> (null if there is no face), error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tried = [_tried(r, lambda image: _points(detect(image))) for r in batch.itertuples()]
            errors = [error or ("no_face" if points is None else None) for points, error in tried]
            yield batch[["path", "subject", "task", "width", "height"]].assign(landmarks=[points for points, _ in tried], error=errors).astype({"width": "Int32", "height": "Int32"})

    schema = "path string, subject string, task string, width int, height int, landmarks array<struct<x: double, y: double, z: double>>, error string"
    return images.select("path", "subject", "task", "height", "width", "channels", "data", "error").mapInPandas(run, schema)
