"""Media columns: texts as lossless WebP images of 8-bit samples, and pixel arrays read back from them.

A text's UTF-8 bytes, with bytes of 255 appended up to a positive multiple of PAD, are the grey samples of an image of
webp.ROW columns; more than webp.ROWS rows go on in further files behind the first. A null text counts as empty. Reading
undoes prefix codes, back-references, colour cache and transforms for any lossless WebP file; a null stays null.

Each row is stored and read by itself, so ties, repeated rows and hot groups need no care, and equal texts give equal
files. An empty table gives an empty result. Only the columns asked for are read. Rows are as large as their text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm import webp

PAD = webp.ROW
SLICE = 256  #: rows decoded before they are handed on


def _stored(text: bytes) -> bytes:
    samples = np.frombuffer(text + b"\xff" * ((-len(text)) % PAD or (0 if text else PAD)), np.uint8)
    part = webp.ROW * webp.ROWS
    return b"".join(webp.encode_grey(samples[i : i + part]) for i in range(0, len(samples), part))


def parts(media: bytes) -> Iterator[bytes]:
    """The files that stand one behind the other."""
    at = 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        yield media[at : at + size]
        at += size


def pixels(media: bytes) -> np.ndarray:
    """Rows of (blue, green, red, alpha) of all parts, which have one width."""
    found = [webp.decode(x) for x in parts(media)]
    return found[0] if len(found) == 1 else np.concatenate(found)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text), media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x.as_py() or "").encode() for x in batch.column(1)]
            files = pa.array([_stored(x) for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), files], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray | None]]]:
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            piece = batch.slice(i, SLICE)
            yield piece, [None if (m := x.as_py()) is None else pixels(m) for x in piece.column(2)]


def decode(stored: DataFrame) -> DataFrame:
    """stored(doc_id, n_bytes, media) -> doc_id, width, height, pixels: rows of four bytes, blue first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, images in _decoded(batches):
            shapes = [[None if x is None else x.shape[k] for x in images] for k in (1, 0)]
            arrays = pa.array([None if x is None else x.tobytes() for x in images], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int32()) for x in shapes), arrays], names=["doc_id", "width", "height", "pixels"])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, width int, height int, pixels binary")


def feature(samples: np.ndarray) -> str:
    """Size, mean, contrast (standard deviation), mean step along rows, and number of grey levels."""
    counts = np.bincount(samples.ravel(), minlength=256)
    total, mean = samples.size, float(counts @ np.arange(256)) / samples.size
    contrast = (float(counts @ np.arange(256) ** 2) / total - mean**2) ** 0.5
    wide = samples.astype(np.int16)
    step = int(np.abs(wide[:, 1:] - wide[:, :-1]).sum(dtype=np.int64)) / max(1, total - len(samples))
    return f"{samples.shape[1]}x{samples.shape[0]} mean={mean:.4f} contrast={contrast:.4f} step={step:.4f} levels={int((counts > 0).sum())}"


def describe(stored: DataFrame) -> DataFrame:
    """stored(doc_id, n_bytes, media), grey images -> doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the
    last 32 samples), media_bytes, media_sha256, feature, all computed from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, images in _decoded(batches):
            rows = []
            for media, image in zip(batch.column(2), images):
                media, samples = media.as_py(), np.ascontiguousarray(image[..., 1])
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, k) for x, k in zip(zip(*rows), kinds))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.where("media IS NOT NULL").select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
