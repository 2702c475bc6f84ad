"""What several corpus operators share: table access, the hold-out rule, bounded
samples and byte-bounded batching; staged tables are the library's own."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import clear_scratch, scratch_path, shared_folder, staged  # noqa: F401

#: Rows whose crc32 of the id, modulo HOLDOUT_MOD, is HOLDOUT_REST are never learned from.
HOLDOUT_MOD, HOLDOUT_REST = 4, 2
#: Text bytes that a Python stage works on at once.
CHUNK_BYTES = 1 << 20
#: Classes of a sample whose shares are broadcast.
CLASSES = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """The hold-out rule; a null id counts as not held out."""
    rest = F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % HOLDOUT_MOD
    return F.coalesce(rest == HOLDOUT_REST, F.lit(False))


def learnable(doc_id: str = "doc_id") -> Column:
    """Rows that may be learned from: an id is there and isn't held out."""
    return F.col(doc_id).isNotNull() & ~held_out(doc_id)


def bounded_sample(df: DataFrame, key: str, classes: str, per_class: int) -> DataFrame:
    """About ``per_class`` rows of each value of ``classes`` at most, picked by
    a hash of ``key`` so that the choice doesn't depend on partitioning. Shares
    of the classes are joined, a row for each class; they are sent to all tasks if
    they count at most ``CLASSES``."""
    scale = 1 << 20
    counts = df.filter(F.col(classes).isNotNull()).groupBy(F.col(classes).alias("__class")).agg(F.greatest(F.lit(1), F.round(F.lit(scale) * F.least(F.lit(1.0), F.lit(per_class) / F.count("*")))).alias("__share"))
    counts = staged(counts, "shares")
    if counts.count() <= CLASSES:
        counts = F.broadcast(counts)
    pick = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(scale))
    return df.join(counts, (F.col(classes) == F.col("__class")) & (pick < F.col("__share")), "left_semi")


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about ``limit`` bytes of ``column`` (at least
    a row), each with its texts, null as the empty string. Only one slice's
    texts are Python strings at a time."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = min(batch.num_rows, int(np.searchsorted(ends, before + limit, "left")) + 1)
            yield batch.slice(start, stop - start), [t or "" for t in values.slice(start, stop - start).to_pylist()]
            start = stop
    give_back()


def give_back() -> None:
    """At a task's end, returns freed memory to the system: workers live on, and
    those of earlier stages would hold theirs while later stages run."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def local_path(path: str) -> str | None:
    """The plain path of a file:// URI or a path; None for other schemes."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if "://" not in path else None


def tokenizer_file(name: str) -> str:
    """A vocabulary file of the installed public tokenizers; the folder can be
    set by the environment variable LUMENSTACK_TOKENIZERS."""
    if folder := os.environ.get("LUMENSTACK_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))
