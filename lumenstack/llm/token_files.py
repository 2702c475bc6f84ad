"""Token-id files: flat unsigned integers and 64-bit document offsets.

A folder holds, for partition ``p`` of the ascending id order,

* ``tokens-p-*.bin``: the ids of its documents, one after another, unsigned
  little-endian integers of 16 bits (32 where the vocabulary needs them);
* ``offsets-p-*.idx``: int64, one more than it has documents: where each
  document starts in the .bin file, in ids;
* ``docs-p-*.idx``: int64 ids of the documents (the smallest int64: null);

and ``manifest.json``: file names, rows, ids and the base of each partition,
which is the prefix sum of the id totals of those before it. A document's
global start is base + offset, so no file is rewritten once bases are known.

The .bin files are read as memory maps where the folder is on a mounted file
system, else through Arrow's file systems.

Null or empty text: a document of the end id alone. Rows that repeat a doc_id:
written in the order of their texts. Empty table: a manifest without files.
Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from .common import chunks, local_path, scratch_path

NO_ID = np.iinfo(np.int64).min
MANIFEST = "part int, tokens string, offsets string, docs string, n_docs long, n_tokens long, width int"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _system(path: str) -> tuple[fs.FileSystem, str]:
    plain = local_path(path)
    return (fs.LocalFileSystem(), plain) if plain else fs.FileSystem.from_uri(path)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, partitions: int | None = None) -> list[dict]:
    """Writes ``docs`` (doc_id, text) in ascending doc_id order; returns the
    manifest's entries: one for each partition, never one for each document.

    A task writes under names of its own attempt and reports them when done, so
    an attempt that is lost leaves files that no manifest names.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _system(path)
        enc = encoder(tokenizer)
        end = enc.pack([end_id])
        part = TaskContext.get().partitionId()
        tag = f"{part:05d}-{uuid.uuid4().hex}"
        names = [f"tokens-{tag}.bin", f"offsets-{tag}.idx", f"docs-{tag}.idx"]
        at, rows = 0, 0
        outs = None
        for batch, texts in chunks(batches):
            outs = outs or [system.open_output_stream(f"{folder}/{x}") for x in names]
            packed = [enc.encode(t) + end for t in texts]
            sizes = np.fromiter((len(x) // enc.dtype.itemsize for x in packed), np.int64, len(packed))
            outs[0].write(b"".join(packed))
            outs[1].write((at + np.cumsum(sizes) - sizes).astype("<i8").tobytes())
            outs[2].write(batch.column(0).fill_null(NO_ID).to_numpy().astype("<i8").tobytes())
            at, rows = at + int(sizes.sum()), rows + len(packed)
        if outs:
            outs[1].write(np.array([at], "<i8").tobytes())
            for out in outs:
                out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, *names, rows, at, enc.dtype.itemsize)], names=["part", "tokens", "offsets", "docs", "n_docs", "n_tokens", "width"]).cast(pa.schema([("part", pa.int32()), ("tokens", pa.string()), ("offsets", pa.string()), ("docs", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())]))

    system, folder = _system(path)
    system.create_dir(folder, recursive=True)
    order = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = order.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    entries = sorted((r.asDict() for r in ranged.mapInArrow(write, MANIFEST).collect()), key=lambda e: e["part"])
    base = 0
    for e in entries:
        e["base"] = base
        base += e["n_tokens"]
    with system.open_output_stream(f"{folder}/manifest.json") as out:
        out.write(json.dumps({"end_id": end_id, "tokens": base, "files": entries}).encode())
    return entries


def map_tokens(path: str, entry: dict) -> np.ndarray:
    """The ids of one partition, memory-mapped where that can be."""
    dtype = np.dtype(f"<u{entry['width']}")
    if plain := local_path(path):
        return np.memmap(os.path.join(plain, entry["tokens"]), dtype, "r") if entry["n_tokens"] else np.zeros(0, dtype)
    return np.frombuffer(_whole(path, entry["tokens"]), dtype)


def _whole(path: str, name: str) -> bytes:
    system, folder = _system(path)
    with system.open_input_stream(f"{folder}/{name}") as f:
        return f.read()


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document of the folder: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32 (of its ids as 32-bit integers). One task
    for each partition's files."""
    system, folder = _system(path)
    with system.open_input_stream(f"{folder}/manifest.json") as f:
        entries = json.loads(f.read())["files"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry in map(json.loads, batch.column(0).to_pylist()):
                tokens = map_tokens(path, entry)
                at = np.frombuffer(_whole(path, entry["offsets"]), "<i8")
                ids = np.frombuffer(_whole(path, entry["docs"]), "<i8")
                for lo in range(0, len(ids), 4096):
                    hi = min(lo + 4096, len(ids))
                    crc = [zlib.crc32(tokens[at[i] : at[i + 1]].astype("<u4")) for i in range(lo, hi)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[lo:hi], mask=ids[lo:hi] == NO_ID), pa.array(at[lo:hi] + entry["base"]), pa.array(np.diff(at[lo : hi + 1])), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    if not entries:
        return spark.createDataFrame([], READ)
    rows = spark.createDataFrame([(i, json.dumps(e)) for i, e in enumerate(entries)], "i int, entry string")
    return rows.repartitionByRange(len(entries), "i").select("entry").mapInArrow(read, READ)


def token_file_digest(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes ``docs`` to the shared folder and describes the files read back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path)
