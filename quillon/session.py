"""The Spark session that the library's queries are made for."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(name: str = "quillon", master: str | None = None, shuffle_partitions: int | None = None, memory: str = "6g") -> SparkSession:
    """A session with the library's settings; on a cluster leave `master` and `shuffle_partitions` to the submission."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS)
    if master:
        builder = builder.master(master).config("spark.driver.memory", memory)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own_folder: dict[str, str] = {}


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for checkpoints: spark.checkpoint.dir; in local mode, where it is unset, one of this session's own."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or _own_folder.get(context.applicationId)
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: the driver and the executors need a folder that they share")
        base = _own_folder[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="quillon-")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(base)
    return base
