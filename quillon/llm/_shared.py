"""What the operators share: scratch tables in the cluster's shared folder and column selection."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_folder

_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where it is unset, one of the session's own."""
    return checkpoint_folder(spark).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    if not _scratch:
        atexit.register(_purge)
    path = f"{shared_dir(spark)}/quillon-{uuid.uuid4().hex}/{name}"
    _scratch.append((spark, os.path.dirname(path)))
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def _purge() -> None:
    for spark, path in _scratch:
        try:
            delete_path(spark, path)
        except Exception:  # the session may be gone already
            return


#: Whether Spark deletes a query's shuffle files when the query ends, and not only when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df`, written once as Parquet in the shared folder and read back: cuts lineage, survives lost executors.

    Shuffle files of the write are deleted with its end, or those of all steps would add up on the executors' disks.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def freed(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        delete_path(df.sparkSession, df.stored_at)


def sorted_groups(batches, keys: list[str]):
    """Runs of rows with equal integer `keys` of Arrow batches that are sorted by them: (key, {column: list}), one at a time."""
    import numpy as np

    held: tuple | None = None
    rows: dict[str, list] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
        ends = np.append(np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1, len(own))
        rest = [c for c in batch.schema.names if c not in keys]
        start = 0
        for end in ends.tolist():
            key = tuple(own[start].tolist())
            if key != held:
                if held is not None:
                    yield held, rows
                held, rows = key, {c: [] for c in rest}
            part = batch.slice(start, end - start)
            for c in rest:
                rows[c] += part.column(c).to_pylist()
            start = end
    if held is not None:
        yield held, rows


def release_memory() -> None:
    """Gives what this process's allocators hold and don't use back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def released(run):
    """`run` of a mapInArrow that gives its memory back to the system when the task ends.

    Python workers are used again by other operators; what one leaves in its allocators would add up beside the next one's.
    """

    def wrapped(batches):
        yield from run(batches)
        release_memory()

    return wrapped


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, as `id` and `text`, null texts as empty ones; other columns can't clash."""
    return docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
