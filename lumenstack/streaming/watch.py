"""Watching folders: a picture is reported when its size or time of change is new.

A file stream of Spark reports each path once, so a picture that is overwritten,
or that was half-written when it was seen, would never come again. Here a stream
of ticks polls a listing instead. Each micro-batch compares the listing with the
state that the batch before left (path, time, size, as a Parquet table beside the
checkpoint), reads the content of new and changed files only, and hands on those
that are ready. Files that aren't ready stay out of the state, so they are tried
again with every poll. State follows the listing: what is gone is forgotten.

A batch's state is written after its files were handled, under the batch's
number: a batch that fails is run again from the same state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.names import extension_of
from ..sources.listing import IMAGES, changed, list_files, ready

STATE = "path string, modified_time timestamp, file_size long"
#: States that are kept: the last two, of which a batch that is run again needs one.
KEPT = 2


@dataclass(frozen=True)
class Listing:
    """The pictures of a folder, as often as they are asked for."""

    spark: SparkSession
    folder: str
    content: bool = True

    def rows(self, content: bool) -> DataFrame:
        return list_files(self.spark, self.folder, content=content).filter(extension_of(F.col("path")).isin(*IMAGES))


def listing_stream(spark: SparkSession, folder: str, content: bool = True) -> Listing:
    """New and changed pictures of a folder, with their content or without."""
    return Listing(spark, folder, content)


def changed_files(listing: Listing, known: DataFrame) -> DataFrame:
    """The ready files of a listing whose (path, size, time) isn't known. The
    content of known files isn't read: they are left before it is."""
    new = changed(listing.rows(content=True), known)
    new = new.filter(ready(F.col("path"), F.col("file_size"), F.col("content")))
    return new if listing.content else new.drop("content")


def watch(listing: Listing, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "1 second") -> StreamingQuery:
    """Starts a query that hands the changed files of each poll to ``handle``,
    which should be an upsert by path: files may come again after a failure.
    Without ``every`` it polls once and ends."""
    spark = listing.spark
    states = f"{checkpoint.rstrip('/')}/state"

    def poll(_: DataFrame, batch: int) -> None:
        known = _state(spark, states, batch)
        place = f"{states}/batch-{batch}"
        found = changed_files(listing, known).persist()
        try:
            handle(found, batch)
            now = listing.rows(content=False)
            same = known.join(now, ["path", "modified_time", "file_size"], "left_semi")
            same.select("path", "modified_time", "file_size").unionByName(found.select("path", "modified_time", "file_size")).write.mode("overwrite").parquet(place)
        finally:
            found.unpersist()
        _forget(spark, states, batch)

    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return ticks.writeStream.foreachBatch(poll).option("checkpointLocation", f"{checkpoint.rstrip('/')}/ticks").trigger(**trigger).start()


def _numbers(spark: SparkSession, states: str) -> tuple[object, dict[int, object]]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(states)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return fs, {}
    return fs, {int(str(x.getPath().getName())[6:]): x.getPath() for x in fs.listStatus(path) if str(x.getPath().getName()).startswith("batch-")}


def _state(spark: SparkSession, states: str, batch: int) -> DataFrame:
    """What the last batch before this one left."""
    fs, found = _numbers(spark, states)
    whole = [n for n, p in found.items() if n < batch and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    if not whole:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(f"{states}/batch-{max(whole)}")


def _forget(spark: SparkSession, states: str, batch: int) -> None:
    fs, found = _numbers(spark, states)
    for n in sorted(found)[:-KEPT]:
        if n < batch:
            fs.delete(found[n], True)
