"""Media columns: whole texts as lossless WebP images, stored as a binary column, and features of the pixels read back."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp

ROW = 192
STRIP_ROWS = 64
#: Bytes of payload that are encoded or decoded together in a task.
TOGETHER = 4 << 20


def padded(text: str | None) -> tuple[bytes, int]:
    """The text in UTF-8 with spaces up to a positive multiple of ROW, and its length before them."""
    raw = (text or "").encode()
    return raw + b" " * (ROW - len(raw) if len(raw) < ROW else -len(raw) % ROW), len(raw)


def together(sizes: list[int]) -> Iterator[tuple[int, int]]:
    lo = held = 0
    for i, n in enumerate(sizes):
        if i > lo and held + n > TOGETHER:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def to_images(payload: bytes) -> list[bytes]:
    step = ROW * STRIP_ROWS
    return [payload[i : i + step] for i in range(0, len(payload), step)]


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): media is the text's payload as one WebP file 64 pixels wide, of frames of up to 64 rows.

    Three payload bytes are a pixel's red, green and blue. A text of up to 12,288 bytes is a simple lossless file; a longer one
    has its frames below each other on one canvas, so that they are coded side by side. Null is the empty text; it and texts of up to 192 bytes have
    one row of pixels. Texts of any length are stored whole. Equal texts give equal media.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in together([len(t or "") for t in texts]):
                made = [padded(t) for t in texts[lo:hi]]
                strips = [to_images(p) for p, _ in made]
                files: list[bytes] = []
                flat = [s for own in strips for s in own]
                for a in range(0, len(flat), 512):
                    files += webp.encode(flat[a : a + 512])
                media, at = [], 0
                for own in strips:
                    media.append(webp.stacked(files[at : at + len(own)], ROW // 3, [len(p) // ROW for p in own]))
                    at += len(own)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([n for _, n in made], pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t")).mapInArrow(run, f"id {kind}, n_bytes long, media binary")
    return out.withColumnRenamed("id", id_col)


def describe(pixels: list[np.ndarray]) -> str:
    """Height, mean of each colour channel, and the share of pixels that differ from the one to their left, as text."""
    height = sum(p.shape[0] for p in pixels)
    count = sum(p.size for p in pixels)
    sums = sum(webp.channels(p)[..., 1:].sum(axis=(0, 1), dtype=np.int64) for p in pixels)
    edges = sum(int((p[:, 1:] != p[:, :-1]).sum()) for p in pixels)
    return f"h={height} r={sums[0] / count:.4f} g={sums[1] / count:.4f} b={sums[2] / count:.4f} edges={edges / count:.4f}"


def decode_features(stored: DataFrame, pixels: bool = False, id_col: str = "doc_id") -> DataFrame:
    """Per row of encode_texts, read back: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and with ``pixels`` also pixels, the array of pixel bytes: R, G, B from left to right and top to bottom, 192 a row.

    Everything but id and n_bytes is made from the stored bytes. Damaged media raise.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(2).to_pylist()
            for lo, hi in together([2 * len(m) for m in media]):
                files = [webp.frames(m) for m in media[lo:hi]]
                found = webp.decode([f for own in files for f in own])
                payloads, features, at = [], [], 0
                for own in files:
                    images = found[at : at + len(own)]
                    at += len(own)
                    payloads.append(b"".join(webp.channels(p)[..., 1:].astype(np.uint8).tobytes() for p in images))
                    features.append(describe(images))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array([len(p) for p in payloads], pa.int64()),
                        pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()),
                        pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()),
                        pa.array([len(m) for m in media[lo:hi]], pa.int64()),
                        pa.array([hashlib.sha256(m).hexdigest() for m in media[lo:hi]], pa.string()),
                        pa.array(features, pa.string()),
                        *([pa.array(payloads, pa.binary())] if pixels else []),
                    ],
                    names,
                )

    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["pixels"] * pixels
    kind = stored.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    out = stored.select(F.col(id_col).alias("id"), "n_bytes", "media").mapInArrow(run, schema + ", pixels binary" * pixels)
    return out.withColumnRenamed("id", id_col)
