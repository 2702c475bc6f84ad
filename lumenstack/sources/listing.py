"""File listings: what is there, what is new, what changed, what is ready."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import extension_of, stem_of

RAW_FORMATS = {e: e for e in "3fr arw cr2 cr3 dng erf nef orf pef raf raw rw2 sr2".split()}
IMAGES = frozenset("jpg jpeg png tif tiff webp heic heif gif bmp".split())
VIDEOS = frozenset("mp4 mov m4v avi mkv".split())
SIGNATURE = 4096
_MARKERS = [("DNGVersion", "dng"), ("FUJIFILM", "raf"), ("NIKON", "nef"), ("Nikon", "nef"), ("SONY", "arw"), ("Panasonic", "rw2"), ("OLYMPUS", "orf"), ("Hasselblad", "3fr"), ("Canon", "cr2"), ("PENTAX", "pef"), ("EPSON", "erf")]


def list_files(spark: SparkSession, *paths: str, content: bool = True) -> DataFrame:
    """path, modified_time, file_size (and content) of all files below the
    paths; unselected content is never read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    plain = F.regexp_replace("path", "^file:/*", "/")
    cols = [plain.alias("path"), F.col("modificationTime").alias("modified_time"), F.col("length").alias("file_size")]
    return df.select(*cols, *(["content"] if content else []))


def named(files: DataFrame) -> DataFrame:
    return files.withColumns({"stem": stem_of(F.col("path")), "extension": extension_of(F.col("path"))})


def raw_format(path: Column, content: Column) -> Column:
    """The RAW format: by extension, else by the first bytes (an ISO media brand,
    or a TIFF header with a maker's mark); null for other files. Built-in
    functions on hexadecimal text: a mark is where it is at an even offset."""
    head = F.hex(F.substring(content, 1, SIGNATURE))
    brands = [F.substring(head, 1 + 2 * at, 8) for at in (8, 16, 20, 24)]
    crx = [b.encode().hex().upper() for b in ("crx ", "cr3 ", "crx\0")]
    iso = (F.substring(head, 9, 8) == b"ftyp".hex().upper()) & (F.length(head) >= 32)
    out = F.when(iso, F.when(F.arrays_overlap(F.array(*brands), F.array(*map(F.lit, crx))), "cr3"))
    tiff = head.startswith("49492A00") | head.startswith("4D4D002A")
    maker = F.lit("tiff-raw")
    for mark, name in reversed(_MARKERS):
        maker = F.when(head.rlike(f"^(?:..)*{mark.encode().hex().upper()}"), name).otherwise(maker)
    sniffed = F.coalesce(out, F.when(tiff, maker))
    ext = extension_of(path)
    return F.when(ext.isin(*RAW_FORMATS), ext).when(ext.isin(*IMAGES, *VIDEOS), F.lit(None)).otherwise(sniffed)


def is_source(path: Column, content: Column) -> Column:
    return raw_format(path, content).isNotNull() | extension_of(path).isin(*IMAGES)


def ready(path: Column, size: Column, content: Column) -> Column:
    """A file that has been written to its end: not empty, and a JPEG ends with its marker."""
    jpeg = extension_of(path).isin("jpg", "jpeg")
    return (size > 0) & (~jpeg | (F.hex(F.substring(content, -2, 2)) == "FFD9"))


def fingerprint(content: Column, size: Column, mode: str = "head-tail", chunk: int = 65_536) -> Column:
    """SHA-1 of the first (and last) 64 KiB, the mode and the size."""
    head, tail = F.substring(content, 1, chunk), F.when(size > chunk, F.substring(content, -chunk, chunk)).otherwise(F.lit(b""))
    parts = [head, *([tail] if mode == "head-tail" else []), F.lit(mode.encode()), F.encode(size.cast("string"), "utf-8")]
    return F.sha1(F.concat(*parts))


def changed(files: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """Files whose (path, size, time) isn't known: what an incremental scan reads."""
    if force:
        return files
    return files.join(known.select("path", "file_size", "modified_time"), ["path", "file_size", "modified_time"], "left_anti")


def content_changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Known paths whose fingerprint, size or time differs."""
    old = known.select("path", *(F.col(c).alias(f"old_{c}") for c in ("fingerprint", "file_size", "modified_time")))
    same = F.lit(True)
    for c in ("fingerprint", "file_size", "modified_time"):
        same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    return files.join(old, "path").filter(~same).select(*files.columns)


def live_state(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Catalog rows with ``present`` and ``source_changed`` by a listing."""
    now = files.select("path", F.col("file_size").alias("now_size"), F.col("modified_time").alias("now_time"))
    out = rows.join(now, "path", "left").withColumn("present", F.col("now_size").isNotNull())
    return out.withColumn("source_changed", F.col("present") & ~(F.col("now_size").eqNullSafe(F.col("file_size")) & F.col("now_time").eqNullSafe(F.col("modified_time")))).drop("now_size", "now_time")


def split_tombstoned(files: DataFrame, tombstones: DataFrame, seconds: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Files that a tombstone (same size, time within two seconds) hides; and
    the tombstones of paths that hold another file now."""
    t = tombstones.select("path", F.col("file_size").alias("t_size"), F.col("modified_time").alias("t_time"))
    both = files.join(t, "path").withColumn("hidden", (F.col("file_size") == F.col("t_size")) & (F.abs(F.unix_micros("modified_time") - F.unix_micros("t_time")) < seconds * 1e6))
    return both.filter("hidden").select(*files.columns), both.filter(~F.coalesce("hidden", F.lit(False))).select("path")


def new_media(files: DataFrame, known: DataFrame, tombstones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths that are neither known nor tombstoned, each once; one row of counts."""
    hidden, _ = split_tombstoned(files, tombstones)
    marks = lambda df, name: df.select("path").distinct().withColumn(name, F.lit(True))
    rows = files.select("path").distinct().join(marks(known, "known"), "path", "left").join(marks(hidden, "tombstoned"), "path", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("known", "tombstoned")})
    counts = rows.agg(F.count_if("known").alias("known"), F.count_if(F.col("tombstoned") & ~F.col("known")).alias("tombstoned"), F.count_if(~F.col("known") & ~F.col("tombstoned")).alias("new"))
    return rows.filter("not known and not tombstoned").select("path").orderBy("path"), counts


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("image_path string, raw_path string, notes string").csv(path, header=True)


def write_truth(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)
