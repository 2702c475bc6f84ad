"""Media columns of progressive JPEG.

``decode`` reads a binary column of progressive JPEG files: the scans (spectral
selection, successive approximation) accumulate in coefficient arrays, numpy
inverts the transform, chroma is upsampled, and the full-resolution RGB tensor
is stored with its shape. ``store_bytes`` and ``read_bytes`` put bytes into such
files without loss and get them back: the format's unit that holds a byte is
the quantised coefficient, as its 8-bit samples don't survive the transform.

Null media: all results null. Files that aren't progressive 8-bit Huffman JPEG,
or are cut short: null results and a reason in ``error``; the job goes on. Null
or empty text: a payload of 64 zero bytes. Very long texts give one large image
each. Equal inputs give equal outputs, whatever they are batched with. Ties,
repeated rows and empty tables need no rule. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .common import chunks

BLOCK = 64
STORED = "doc_id long, n_bytes long, media binary"
READ = "doc_id long, n_bytes long, media binary, payload binary, height int, width int, rgb binary, feature string, error string"


def payload(text: str) -> bytes:
    """UTF-8 with zeros up to a positive multiple of the block."""
    raw = text.encode("utf-8", "replace")
    return raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))


def feature(rgb: np.ndarray) -> str:
    """Size, sums of the channels, and a histogram of green in eight steps."""
    sums = rgb.reshape(-1, 3).sum(0, dtype=np.int64)
    steps = np.bincount((rgb[..., 1] >> 5).ravel(), minlength=8)
    return f"{rgb.shape[0]}x{rgb.shape[1]};{','.join(map(str, sums.tolist()))};{','.join(map(str, steps.tolist()))}"


def store_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the UTF-8 text) and media, a progressive JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            files = jpeg.encode([payload(t) for t in texts])
            sizes = [len(t.encode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, STORED)


def read_bytes(stored: DataFrame, tensors: bool = True) -> DataFrame:
    """``stored`` (doc_id, n_bytes, media) with what its files hold: the payload
    from the coefficients, the RGB tensor (left null unless ``tensors``), its
    shape and feature, or an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(2).to_pylist()
            lo = size = 0
            for i, f in enumerate(files):
                size += len(f or b"")
                if size < 1 << 20 and i < len(files) - 1:
                    continue
                part = batch.slice(lo, i + 1 - lo)
                yield _read(part, files[lo : i + 1], tensors)
                lo, size = i + 1, 0

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, READ)


def _read(part: pa.RecordBatch, files: list[bytes | None], tensors: bool) -> pa.RecordBatch:
    images = jpeg.decode_coefficients([f or b"" for f in files])
    out: dict[str, list] = {k: [] for k in ("payload", "height", "width", "rgb", "feature", "error")}
    for f, n, img, rgb in zip(files, part.column(1).to_pylist(), images, jpeg.rgb_tensors(images)):
        ok = f is not None and img.error is None
        held = None
        if ok and n is not None:
            length = max(1, -(-n // BLOCK)) * BLOCK
            held = img.coefficients[: length // BLOCK].astype(np.int8).tobytes()
        out["payload"].append(held)
        out["height"].append(img.height if ok else None)
        out["width"].append(img.width if ok else None)
        out["rgb"].append(rgb.tobytes() if ok and tensors else None)
        out["feature"].append(feature(rgb) if ok else None)
        out["error"].append(None if ok or f is None else img.error)
    kinds = {"payload": pa.binary(), "height": pa.int32(), "width": pa.int32(), "rgb": pa.binary(), "feature": pa.string(), "error": pa.string()}
    return pa.RecordBatch.from_arrays([*part.columns, *(pa.array(v, kinds[k]) for k, v in out.items())], names=[*part.schema.names, *out])


def decode(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """key, height, width, rgb (height x width x 3 bytes), feature and error of
    any progressive JPEG column."""
    rows = read_bytes(df.select(F.col(key).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_bytes"), F.col(media).alias("media")))
    return rows.select(F.col("doc_id").alias(key), "height", "width", "rgb", "feature", "error")


def digest(docs: DataFrame) -> DataFrame:
    """What the stored files of all texts hold, read back. The RGB tensors, of
    which ``feature`` is taken, are left out; ``decode`` and ``read_bytes`` store them."""
    read = read_bytes(store_bytes(docs), tensors=False)
    size = F.octet_length("payload").cast("long")
    return read.select(
        "doc_id",
        "n_bytes",
        size.alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -BLOCK, BLOCK)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
