"""A table of one row per key that batches of rows are merged into.

Rows lie in a fixed number of buckets by a hash of their key, each bucket in one folder that is never
changed.  ``upsert`` rewrites the buckets that the new rows fall into and then publishes a version, a small
file that names every bucket's folder; a reader takes the last version, so it sees all of a batch or
nothing of it, and a lookup reads the buckets of its keys alone.  Publishing a version that another
writer has published meanwhile fails and is tried again on top of that one.  ``vacuum`` deletes what no
kept version names.

Versions are published by a rename that doesn't overwrite, which HDFS and local file systems do at once.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.plans.scratch import delete

TRIES = 5


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "upload_id", order: str = "at", buckets: int = 64):
        """``order`` is the column by whose greatest value a key's row is the latest; of equals the newly written one."""
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self._hadoop = spark._jvm.org.apache.hadoop

    def _path(self, at: str):
        return self._hadoop.fs.Path(at)

    def _fs(self):
        return self._path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _list(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs().listStatus(at)) if self._fs().exists(at) else []

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._list("versions") if n.endswith(".json")]

    def _named(self, version: int) -> dict[int, str]:
        """The folder of each bucket, under ``data``."""
        stream = self._fs().open(self._path(f"{self.path}/versions/{version:012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(k): v for k, v in json.loads(text).items()}

    def _publish(self, version: int, folders: dict[int, str]) -> bool:
        """Whether the version is ours."""
        new = self._path(f"{self.path}/versions/{uuid.uuid4().hex}.new")
        stream = self._fs().create(new, False)
        stream.write(bytearray(json.dumps(folders).encode()))
        stream.close()
        context = self._hadoop.fs.FileContext.getFileContext(self._fs().getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs().makeQualified(new), self._fs().makeQualified(self._path(f"{self.path}/versions/{version:012d}.json")), none)
        except Exception as e:
            self._fs().delete(new, False)
            if "AlreadyExists" in str(e):
                return False
            raise
        return True

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in folders])

    def upsert(self, rows: DataFrame) -> None:
        """Merges ``rows`` (any number per key) into the table."""
        names = self.schema.names
        rows = rows.select(*names).withColumn("bucket", self._bucket(F.col(self.key)))
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most the number of buckets
        if not touched:
            return
        for _ in range(TRIES):
            version = max(self.versions(), default=0)
            folders = self._named(version) if version else {}
            both, named = rows.withColumn("__new", F.lit(1)), [folders[b] for b in touched if b in folders]
            if named:
                both = both.unionByName(self._rows(named).withColumns({"bucket": self._bucket(F.col(self.key)), "__new": F.lit(0)}))
            latest = both.groupBy("bucket", self.key).agg(F.max_by(F.struct(*names), F.struct(self.order, "__new")).alias("row"))
            new = f"v{version + 1}-{uuid.uuid4().hex}"
            latest.select("row.*", "bucket").repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{new}")
            if self._publish(version + 1, folders | {b: f"{new}/bucket={b}" for b in touched}):
                return
            delete(self.spark, f"{self.path}/data/{new}")
        raise RuntimeError(f"{self.path}: other writers were faster {TRIES} times")

    def read(self) -> DataFrame:
        version = max(self.versions(), default=0)
        return self._rows(list(self._named(version).values()) if version else [])

    def get(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` (key column); buckets that hold none of them aren't read."""
        version = max(self.versions(), default=0)
        folders = self._named(version) if version else {}
        wanted = [r.b for r in keys.select(self._bucket(F.col(self.key)).alias("b")).distinct().collect()]  # at most the number of buckets
        return self._rows([folders[b] for b in wanted if b in folders]).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def vacuum(self, keep: int = 1) -> None:
        """Deletes all versions but the last ``keep``, and folders that those don't name; readers of older ones fail."""
        every = self.versions()
        kept = every[-keep:]
        named = {f for v in kept for f in self._named(v).values()}
        for v in every[:-keep]:
            delete(self.spark, f"{self.path}/versions/{v:012d}.json")
        newest = max(kept, default=0)
        for folder in self._list("data"):
            if int(folder[1:].split("-")[0]) > newest:
                continue  # a writer may still be at it
            buckets = [f for f in self._list(f"data/{folder}") if f.startswith("bucket=")]
            gone = [b for b in buckets if f"{folder}/{b}" not in named]
            for at in [folder] if len(gone) == len(buckets) else [f"{folder}/{b}" for b in gone]:
                delete(self.spark, f"{self.path}/data/{at}")
