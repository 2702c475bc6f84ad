"""Tables written to the folder that all executors share, to end a lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}
_written: list[tuple[weakref.ref, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where the session has none (tests
    on one machine) a temporary one that this process removes at its end."""
    set_ = spark.conf.get("spark.checkpoint.dir", None)
    if set_:
        return set_.rstrip("/")
    key = spark.sparkContext.applicationId
    if key not in _own_folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _own_folder[key] = tempfile.mkdtemp(prefix="lumenstack-")
        atexit.register(shutil.rmtree, _own_folder[key], ignore_errors=True)
    return f"file://{_own_folder[key]}"


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((weakref.ref(spark), path))
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage ends
    there, and losing an executor loses no rows."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> int:
    """Removes what ``staged`` wrote for this session; the number of folders.
    Only once no frame that was read from there is in use."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    for ref, path in list(_written):
        if ref() is spark:
            p = jvm.org.apache.hadoop.fs.Path(path)
            gone += bool(p.getFileSystem(conf).delete(p, True))
            _written.remove((ref, path))
    return gone
