"""Packing by concatenate and cut.

First pass: each partition encodes its documents, notes every document's
prefix sum within the partition, and writes the ids. The totals of the
partitions give, as prefix sums again, the partitions' bases; there is one
number for each partition. Second pass: base + prefix sum is a document's
place in the one long stream, which is cut each ``window`` ids. A document
that crosses a cut gives several pieces; ``crosses_start`` and ``crosses_end``
mark these boundary records.

Only the last sequence can be short. It counts as padded to the window, except
where its length is a power of two, which is kept (``padded_length``).

The second pass returns slices of at most ``SLICE_IDS`` ids (or a piece), so the
ids of a large batch or text aren't held twice.

Null or empty text: the separator alone. Very long texts: as many pieces as
windows that they touch. Ties and repeated rows: each row is packed. Empty
table: no pieces. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CACHED_PARTS, encoder
from .common import chunks, give_back, staged

WINDOW = 1024
#: Ids that the second pass returns at once (at least a piece).
SLICE_IDS = 1 << 19
ENCODED = "part int, doc_id long, before long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, padded_length long, crosses_start boolean, crosses_end boolean, ids array<int>"


def encode_documents(docs: DataFrame, tokenizer: str, separator: int, cached: int = CACHED_PARTS) -> DataFrame:
    """The first pass, staged: part, doc_id, before (ids of this partition's
    earlier documents), n, ids (packed)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, cached)
        end = enc.pack([separator])
        part, at = TaskContext.get().partitionId(), 0
        for batch, texts in chunks(batches):
            packed = [enc.encode(t) + end for t in texts]
            n = np.fromiter((len(x) // enc.dtype.itemsize for x in packed), np.int64, len(packed))
            before = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), batch.column(0), pa.array(before), pa.array(n), pa.array(packed, pa.binary())], names=["part", "doc_id", "before", "n", "ids"])

    return staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, ENCODED), "encoded")


def _in_place(packed: pa.Array, n: int) -> np.ndarray:
    """The ``n`` ids of all rows, one after another, without a copy."""
    wide_offsets = pa.types.is_large_binary(packed.type)
    bounds = np.frombuffer(packed.buffers()[1], np.int64 if wide_offsets else np.int32)[packed.offset : packed.offset + len(packed) + 1]
    size = int(bounds[-1] - bounds[0])
    return np.frombuffer(packed.buffers()[2], f"<u{size // n}", n, int(bounds[0]))


def pack(docs: DataFrame, tokenizer: str, separator: int = 0, window: int = WINDOW, with_ids: bool = False, cached: int = CACHED_PARTS) -> DataFrame:
    """One row for each piece. ``with_ids`` adds the piece's ids; otherwise that
    column is left out. ``cached`` bounds the words that a worker keeps the ids of."""
    spark = docs.sparkSession
    encoded = encode_documents(docs, tokenizer, separator, cached)
    bases, total = {}, 0
    for part, n in sorted(map(tuple, encoded.groupBy("part").agg(F.sum("n")).collect())):
        bases[part] = total
        total += n
    shared = spark.sparkContext.broadcast((bases, total))  # a number for each partition
    schema = PIECES if with_ids else PIECES.rpartition(",")[0]
    names = [x.split()[0] for x in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, end = shared.value
        last = end // window
        short = end - last * window
        padded = short if short & (short - 1) == 0 else window
        for batch in batches:
            if batch.num_rows == 0:
                continue
            part, ids, before, n, packed = batch.columns
            at = before.to_numpy() + np.array([base[p] for p in part.to_pylist()], np.int64)
            n = n.to_numpy()
            every = _in_place(packed, int(n.sum()))
            pieces = (at + n - 1) // window - at // window + 1
            row = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            seq = (at // window)[row] + nth
            lo = np.maximum(seq * window, at[row])
            hi = np.minimum((seq + 1) * window, (at + n)[row])
            ends = np.cumsum(hi - lo)  # pieces follow one another, as the ids of the batch do
            start = 0
            while start < len(row):
                first = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, first + SLICE_IDS, "right")))
                wide = every[first : int(ends[stop - 1])].astype("<u4")
                offsets = np.concatenate([[0], ends[start:stop] - first]).astype(np.int32)
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                r, q, l, h = (x[start:stop] for x in (row, seq, lo, hi))
                cols = [ids.take(pa.array(r)), l - at[r], h - l, pa.array(crc, pa.int64()), n[r], q, l - q * window, np.where(q == last, short, window), np.where(q == last, padded, window), l > at[r], h < (at + n)[r]]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(wide.view(np.int32))))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=names)
                start = stop
        give_back()

    return encoded.mapInArrow(cut, schema)
