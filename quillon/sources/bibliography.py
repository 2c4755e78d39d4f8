"""Scans of export files: listing, decoding, parsing on the executors, and per-file accounting."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import RECORD_SCHEMA, with_key
from ..session import checkpoint_folder
from . import formats, tagged_scan
from .tagged_scan import PARSED

DEFAULT_HEADER = "FN Clarivate Web of Science\nVR 1.0"


@dataclass
class Import:
    """records; files (path, source, format, count, error); warnings (path, warning); the header for an export."""

    records: DataFrame
    files: DataFrame
    warnings: DataFrame
    header: str = DEFAULT_HEADER


def expand_inputs(spark: SparkSession, paths: list[str], suffixes: tuple[str, ...] = formats.SUFFIXES) -> tuple[list[str], list[str]]:
    """Files of known suffixes among `paths` and below them, each once, folders sorted; and warnings for the rest.

    Listing goes through Hadoop's file systems, so any store that Spark reads will do.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found: dict[str, str] = {}
    warnings = []
    for given in paths:
        path = jvm.org.apache.hadoop.fs.Path(given)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            warnings.append(f"missing: {given}")
            continue
        folder = fs.getFileStatus(path).isDirectory()
        own, files = [], fs.listFiles(path, True)
        while files.hasNext():
            own.append(files.next().getPath().toString())
        fit = sorted((p for p in own if p.casefold().endswith(suffixes)), key=str.casefold)
        if not fit:
            warnings.append(f"no supported file in {given}" if folder else f"unsupported: {given}")
        for p in fit:
            found.setdefault(p.casefold(), p)
    return list(found.values()), warnings


def _parse_file(path: str, content: bytes) -> list[tuple]:
    blank = (None,) * 3
    try:
        parsed = formats.parse(content)
    except (formats.FormatError, ValueError, IndexError, KeyError) as e:
        return [(path, 0, None, None, None, None, None, None, str(e))]
    rows = [(path, 0, parsed.source, parsed.format, None, None, parsed.header, w, None) for w in parsed.warnings or [None]]
    return rows + [(path, k, parsed.source, parsed.format, raw, f, *blank) for k, (f, raw) in enumerate(parsed.records, 1)]


def _whole_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    def run(batches):
        names = ["source_file", "source_index", "source_kind", "source_format", "raw_block", "fields", "header", "warning", "error"]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                yield pd.DataFrame(_parse_file(path, bytes(content)), columns=names)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, PARSED)


#: Files of tagged text that are longer are read by many tasks.
SPLIT_OVER = 64 << 20


def read_bibliography(spark: SparkSession, paths: list[str], strict: bool = False, split_over: int = SPLIT_OVER) -> Import:
    """Reads export files of any known format; broken files become rows of `files`.

    A file is parsed by one task, but tagged text (Web of Science, RIS, NBIB, RefWorks) of more than `split_over` bytes by
    as many as Spark cuts it into, with the same records, numbers and warnings. With `strict` an unreadable file raises.
    `ord` follows the order of `paths`, then the place in the file. What was parsed is a checkpoint.
    """
    if not paths:
        raise formats.FormatError("no file to read")
    checkpoint_folder(spark)
    listed = spark.read.format("binaryFile").load(paths).select("path", "length").collect()  # contents aren't read
    large = tagged_scan.tagged_files(spark, [r.path for r in listed if r.length > split_over])
    whole = [_glob_free(r.path) for r in listed if r.path not in large]
    parts = [_whole_files(spark, whole)] if whole else []
    if large:
        parts.append(tagged_scan.scan(spark, large))
    parsed = reduce(DataFrame.unionByName, parts).checkpoint()
    summary = parsed.groupBy(F.col("source_file").alias("path")).agg(
        F.max("source_kind").alias("source"), F.max("source_format").alias("format"), F.count_if(F.col("source_index") > 0).alias("count"), F.max("error").alias("error")
    )
    if strict and (bad := summary.where("error is not null").first()) is not None:
        raise formats.FormatError(f"{bad.path}: {bad.error}")
    if summary.where("error is null").isEmpty():
        bad = summary.orderBy("path").first()
        raise formats.FormatError(f"none of the files can be used{f'; {bad.path}: {bad.error}' if bad else ''}")
    position = spark.createDataFrame([(p.split(":", 1)[-1].lstrip("/"), k) for k, p in enumerate(paths)], "_p string, _k long")
    tail = F.regexp_replace(F.regexp_replace("source_file", "^[a-z]+:", ""), "^/+", "")
    rows = parsed.where("source_index > 0").join(position, tail == F.col("_p"), "left")
    rows = rows.withColumn("ord", F.coalesce("_k", F.lit(0)) * (1 << 32) + F.col("source_index"))
    records = with_key(rows.select(*[c.split()[0] for c in RECORD_SCHEMA.replace("map<string, array<string>>", "m").split(", ")]))
    header = parsed.where("source_format = 'wos_tagged' and header <> ''").select("source_file", "header").first()
    return Import(records, summary, parsed.where("warning is not null").select(F.col("source_file").alias("path"), "warning"), header.header if header else DEFAULT_HEADER)


def _glob_free(path: str) -> str:
    """A listed path as one to load: characters that would be a pattern are escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """target and variant, one pair a line between them a tab; a line of another form refuses the whole file."""
    content = spark.read.format("binaryFile").load(path).select("content").first().content
    lines = [x for x in formats.decode(bytes(content)).split("\n") if x.strip()]
    rows = []
    for k, line in enumerate(lines, 1):
        cells = [c.strip() for c in line.split("\t")]
        if len(cells) != 2 or not all(cells):
            raise formats.FormatError(f"line {k}: two columns between a tab are needed")
        rows.append(tuple(cells))
    return spark.createDataFrame(rows, "target string, variant string")


def read_network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of a network file; refuses files of another shape."""
    text = spark.read.text(path, wholetext=True).first().value
    data = json.loads(text)
    if not isinstance(data.get("network"), dict) or not all(isinstance(data["network"].get(k), list) for k in ("items", "links")):
        raise formats.FormatError("not a network file")
    df = spark.read.json(path, multiLine=True)
    return df.selectExpr("inline(network.items)"), df.selectExpr("inline(network.links)")


def read_settings(text: str) -> dict:
    """Settings as JSON; anything else is no settings."""
    try:
        found = json.loads(text)
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def record_json():
    """A record as JSON text."""
    return F.to_json(F.struct("source_file", "source_index", "source_kind", "source_format", "raw_block", "fields"))


def from_record_json(df: DataFrame, column: str) -> DataFrame:
    schema = RECORD_SCHEMA.replace("ord long, ", "")
    return with_key(df.select(F.from_json(column, schema).alias("r")).select("r.*"))


def backfill_citations(records: DataFrame, fresh: DataFrame) -> DataFrame:
    """Records with missing counts (TC, Z9) from the same file, place and title of a newer reading of it."""
    from ..functions import text as t

    key = lambda: t.term_key(t.text("TI"))
    eligible = F.col("source_kind").isin("wos", "scopus") & F.col("source_format").isin("ris", "scopus_csv", "scopus_plain", "bibtex") & t.counted().isNull() & (t.text("TC") == "") & (t.text("Z9") == "")
    new = fresh.select("source_file", "source_index", key().alias("_title"), F.map_filter("fields", lambda k, v: k.isin("TC", "Z9")).alias("_new"))
    joined = records.withColumn("_key", key()).join(new, ["source_file", "source_index"], "left")
    take = eligible & (F.col("_key") == F.col("_title"))
    merged = F.map_concat(F.map_filter("fields", lambda k, v: ~F.map_contains_key("_new", k)), F.col("_new"))
    return joined.withColumn("fields", F.when(take, merged).otherwise(F.col("fields"))).drop("_key", "_title", "_new")


def first_per_path(df: DataFrame, path_col: str, order_col: str) -> DataFrame:
    """One row for each path, whatever its case: the first by `order_col`."""
    w = Window.partitionBy(F.lower(path_col)).orderBy(order_col)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
