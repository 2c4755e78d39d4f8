"""Incremental import and running counts as streams: an extension, the batch operators over unbounded input."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RECORD_SCHEMA, with_key
from ..sources import bibliography

_FILE = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """New export files of a folder as they come."""
    return spark.readStream.format("binaryFile").schema(_FILE).option("maxFilesPerTrigger", per_batch).load(folder)


def stream_records(files: DataFrame) -> DataFrame:
    """Records of a stream of files; `ord` is the place in the file."""

    def run(batches):
        names = ["source_file", "source_index", "source_kind", "source_format", "raw_block", "fields", "header", "warning", "error"]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                yield pd.DataFrame(bibliography._parse_file(path, bytes(content)), columns=names)

    parsed = files.select("path", "content").mapInPandas(run, bibliography.PARSED).where("source_index > 0")
    return with_key(parsed.withColumn("ord", F.col("source_index").cast("long")).select(*[c.split()[0] for c in RECORD_SCHEMA.replace("map<string, array<string>>", "m").split(", ")]))


def append_records(records: DataFrame, path: str, checkpoint: str):
    """Appends a stream of records to a Parquet table, each file once."""
    return records.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def windowed_counts(events: DataFrame, time: str = "ts", window: str = "1 day", late: str = "2 days", *keys: str) -> DataFrame:
    """Tumbling counts; events later than `late` are dropped by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("events"))
