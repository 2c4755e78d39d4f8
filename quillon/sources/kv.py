"""Results by key: Parquet files dealt into buckets by a hash of the key, and a manifest of which files hold a bucket now.

A write makes new files for the buckets that it touches and then swaps the manifest, so that readers see old or new. A
lookup of many keys is a join with the buckets of those keys; a query of the data source `quillon_keyed` that compares the
key with values opens the files of their buckets alone.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from .sinks import write_file

#: Buckets of a new store.
BUCKETS = 64
#: Rows in one file of a bucket at most.
FILE_ROWS = 5_000_000


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(key.cast("binary")), F.lit(buckets)).cast("int")


class KeyedStore:
    """A table with one row a key. Nulls are no keys: rows without one aren't kept."""

    def __init__(self, spark: SparkSession, path: str, key: str = "cache_key", buckets: int = BUCKETS):
        """`key` and `buckets` are those of a new store; one that exists has its own."""
        self.spark, self.path = spark, path.rstrip("/")
        self._fresh = {"key": key, "buckets": buckets, "generation": 0, "schema": None, "files": {}}

    def manifest(self) -> dict:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest.json")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self._fresh
        return json.loads(self.spark.read.text(p.toString(), wholetext=True).first().value)

    def _read(self, state: dict, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of some buckets, or of all; none before the first write."""
        if state["schema"] is None:
            return None
        schema = StructType.fromJson(state["schema"])
        files = [f for b, own in state["files"].items() if buckets is None or int(b) in set(buckets) for f in own]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def table(self) -> DataFrame:
        found = self._read(self.manifest())
        if found is None:
            raise ValueError(f"nothing has been put into {self.path}")
        return found

    def put(self, rows: DataFrame) -> int:
        """New rows instead of those of their keys; of equal keys among them the least row stays. Returns the generation.

        Only the buckets of the new keys are read and written.
        """
        state = self.manifest()
        key, generation = state["key"], state["generation"] + 1
        least = F.min(F.struct(*[F.col(c) for c in rows.columns if c != key])).alias("r")
        new = rows.where(F.col(key).isNotNull()).groupBy(key).agg(least).select(key, "r.*").select(*rows.columns)
        touched = [r.b for r in new.select(bucket_of(F.col(key), state["buckets"]).alias("b")).distinct().collect()]  # no more than buckets
        old = self._read(state, touched)
        if old is not None:
            new = old.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(new)
        folder = f"{self.path}/g{generation}"
        dealt = new.withColumn("_bucket", bucket_of(F.col(key), state["buckets"]))
        dealt.repartition("_bucket").sortWithinPartitions("_bucket", key).write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("_bucket").parquet(folder)
        files = dict(state["files"]) | {str(b): self._files(f"{folder}/_bucket={b}") for b in touched}
        write_file(self.spark, f"{self.path}/manifest.json", json.dumps({**state, "generation": generation, "schema": new.schema.jsonValue(), "files": files}))
        return generation

    def _files(self, folder: str) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return sorted(s.getPath().toString() for s in p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p) if s.getPath().getName().startswith("part-"))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Rows of `keys` with the store's columns, for keys that it has; only the buckets of the keys are read."""
        state = self.manifest()
        key = state["key"]
        touched = [r.b for r in keys.where(F.col(key).isNotNull()).select(bucket_of(F.col(key), state["buckets"]).alias("b")).distinct().collect()]
        found = self._read(state, touched)
        if found is None:
            raise ValueError(f"nothing has been put into {self.path}")
        return keys.join(found, key)

    def vacuum(self) -> int:
        """Deletes files that the manifest doesn't name any more; how many generations went whole."""
        state = self.manifest()
        live = {f.rsplit("/", 2)[0] for own in state["files"].values() for f in own}
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs, gone = root.getFileSystem(self.spark._jsc.hadoopConfiguration()), 0
        for status in fs.listStatus(root):
            if status.isDirectory() and status.getPath().toString() not in live:
                fs.delete(status.getPath(), True)
                gone += 1
        return gone


# --- the data source -----------------------------------------------------------------------------------------------


def _open(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


class BucketFile(InputPartition):
    def __init__(self, path: str, keys: tuple[str, ...] | None):
        super().__init__((path, keys))
        self.path, self.keys = path, keys


class KeyedReader(DataSourceReader):
    """Reads the files of the buckets that the pushed comparisons leave."""

    def __init__(self, state: dict, schema: StructType):
        self.state, self.schema, self.keys = state, schema, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of the key choose buckets; Spark checks all filters again, as others aren't looked at."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and tuple(f.attribute) == (self.state["key"],):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.keys = own if self.keys is None else self.keys & own
            yield f

    def partitions(self) -> list[InputPartition]:
        by_bucket: dict[int, list[str]] = {}
        for k in sorted(x for x in self.keys or () if x is not None):
            by_bucket.setdefault(zlib.crc32(k.encode()) % self.state["buckets"], []).append(k)
        files = ((int(b), f) for b, own in self.state["files"].items() for f in own)
        return [BucketFile(f, tuple(by_bucket[b]) if self.keys is not None else None) for b, f in files if self.keys is None or b in by_bucket] or [BucketFile("", ())]

    def read(self, partition: InputPartition):
        import pyarrow.dataset as ds

        if not partition.path:
            return
        fs, path = _open(partition.path)
        chosen = None if partition.keys is None else ds.field(self.state["key"]).isin(list(partition.keys))
        yield from ds.dataset(path, filesystem=fs, format="parquet", partitioning=None).to_batches(columns=self.schema.names, filter=chosen)


class KeyedSource(DataSource):
    """`spark.read.format("quillon_keyed").load(path)`, after `register`."""

    @classmethod
    def name(cls) -> str:
        return "quillon_keyed"

    def _state(self) -> dict:
        fs, path = _open(self.options["path"].rstrip("/") + "/manifest.json")
        with fs.open_input_stream(path) as f:
            return json.loads(f.read())

    def schema(self) -> StructType:
        return StructType.fromJson(self._state()["schema"])

    def reader(self, schema: StructType) -> KeyedReader:
        return KeyedReader(self._state(), schema)


def register(spark: SparkSession) -> None:
    """Makes the data source known, and lets Spark push filters to sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(KeyedSource)
