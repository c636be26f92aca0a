"""Media columns: documents' payloads as progressive JPEG files, read back to bytes, RGB tensors and features.

A payload is stored losslessly in JPEG's own unit, the quantized coefficient: each payload byte is one coefficient of an 8 x 8
block. Null text is empty and has a payload of 64 zero bytes; empty tables give no rows. Work is cut into groups of about two
megabytes, so memory is bounded by that and the largest single text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import jpeg
from .common import arrow_map, ids_and_text, table, utf8

#: Payload bytes that are encoded together.
GROUP_BYTES = 1 << 21


def payload_of(raw: bytes) -> bytes:
    """The bytes, with zeros appended up to a positive multiple of 64."""
    return raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))


def _groups(raws: list[bytes]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, raw in enumerate(raws):
        if size and size + len(raw) > GROUP_BYTES:
            yield start, i
            start, size = i, 0
        size += len(raw) + 64
    if start < len(raws):
        yield start, len(raws)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the JPEG file of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = utf8(batch["text"])
            for a, b in _groups(raws):
                part = raws[a:b]
                files = jpeg.encode([payload_of(r) for r in part])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.array([len(r) for r in part], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return arrow_map(ids_and_text(docs), run, "doc_id long, n_bytes long, media binary")


def _feature(pixels: np.ndarray) -> str:
    """Size, channel sums and mean vertical change: whole numbers, the same wherever they are computed."""
    sums = pixels.sum(axis=(0, 1), dtype=np.int64)
    change = np.abs(pixels[1:].astype(np.int16) - pixels[:-1]).sum(axis=(0, 1), dtype=np.int64)
    return f"{pixels.shape[0]}x{pixels.shape[1]} rgb {sums[0]},{sums[1]},{sums[2]} dy {change[0]},{change[1]},{change[2]}"


_COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(stored: DataFrame) -> DataFrame:
    """Decode stored files: digests of payload and file, and features of the RGB tensor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch["media"].to_pylist()
            for a, b in _groups(files):
                part = files[a:b]
                c = jpeg.decode(part)
                back = jpeg.payloads(c)
                rows = [
                    (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(f), hashlib.sha256(f).hexdigest(), _feature(t))
                    for p, f, t in zip(back, part, jpeg.rgb(c), strict=True)
                ]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                made = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                names = [x.split()[0] for x in _COLUMNS.split(", ")]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), batch["n_bytes"].slice(a, b - a), *made], names)

    return arrow_map(stored, run, _COLUMNS)


def tensors(stored: DataFrame) -> DataFrame:
    """doc_id, height, width and the raw full-resolution RGB tensor (row-major, 3 bytes a pixel)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch["media"].to_pylist()
            for a, b in _groups(files):
                made = jpeg.rgb(jpeg.decode(files[a:b]))
                columns = [pa.array([t.shape[i] for t in made], pa.int32()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), *columns, pa.array([t.tobytes() for t in made], pa.binary())], ["doc_id", "height", "width", "rgb"])

    return arrow_map(stored, run, "doc_id long, height int, width int, rgb binary")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op5_media."""
    return read_back(store(table(spark, sf_dir, "documents")))
