"""A catalog: a folder with a Parquet dataset for each table.

Each table has versions. A numbered manifest names the ones to read; the highest
number counts. A change writes all its tables, then its manifest under a name of
its own, and renames that to the next number. The rename never overwrites, so of
two writers that began from the same manifest the second one fails, and at every
moment there is a whole catalog to read. A writer that dies leaves files that
nothing names."""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from .schemas import KEYS, TABLES, VERSION, schema, violations


MANIFESTS = "manifests"


class ConcurrentChange(RuntimeError):
    """Another change was published since this one began; nothing is changed."""


class Catalog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _latest(self) -> int:
        """The number of the newest manifest; 0 before the first."""
        fs, p = self._fs(MANIFESTS)
        if not fs.exists(p):
            return 0
        found = (re.fullmatch(r"(\d+)\.json", str(x.getPath().getName())) for x in fs.listStatus(p))
        return max((int(m[1]) for m in found if m), default=0)

    def _read(self, number: int) -> dict:
        if not number:
            return {"schema_version": VERSION, "tables": {}}
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.path}/{_manifest(number)}").collect()))

    def ensure(self) -> Catalog:
        """Creates the folder with empty tables, if it isn't there."""
        if not self._latest():
            try:
                self._publish(self._read(0), 1)
            except ConcurrentChange:  # another process created it
                pass
        return self

    def table(self, name: str) -> DataFrame:
        found = self._read(self._latest())["tables"].get(name)
        if found is None:
            return self.spark.createDataFrame([], schema(name))
        return self.spark.read.schema(schema(name)).parquet(f"{self.path}/{found}")

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in TABLES}

    def views(self) -> None:
        for name, df in self.tables().items():
            df.createOrReplaceTempView(name)

    def write(self, changed: dict[str, DataFrame], check: bool = True) -> None:
        """Publishes all tables of a change, or none; ``ConcurrentChange`` if
        another change was published meanwhile."""
        number = self._latest()
        state = self._read(number)
        new = dict(state["tables"])
        for name, df in changed.items():
            place = f"{name}/{uuid.uuid4().hex}"
            fields = schema(name)
            df.select(*(df[f.name].cast(f.dataType) if f.name in df.columns else _null(f) for f in fields)).write.parquet(f"{self.path}/{place}")
            if check and name in KEYS and not violations(name, self.spark.read.schema(fields).parquet(f"{self.path}/{place}")).isEmpty():
                raise ValueError(f"{name}: null or repeated keys, or values that aren't allowed")
            new[name] = place
        self._publish(state | {"tables": new}, number + 1)

    def _publish(self, state: dict, number: int) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        fs, temporary = self._fs(f"{MANIFESTS}/.new-{uuid.uuid4().hex}")
        out = fs.create(temporary, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        _, target = self._fs(_manifest(number))
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        never = self.spark.sparkContext._gateway.new_array(rename, 1)
        never[0] = rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), conf).rename(temporary, target, never)
        except Py4JJavaError as e:
            fs.delete(temporary, False)
            if fs.exists(target):
                raise ConcurrentChange(f"manifest {number} was published by another writer") from e
            raise


def _manifest(number: int) -> str:
    return f"{MANIFESTS}/{number:012d}.json"


def _null(field):
    from pyspark.sql import functions as F

    return F.lit(None).cast(field.dataType).alias(field.name)
