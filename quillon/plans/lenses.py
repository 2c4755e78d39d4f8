"""How the driver's tables stand in for bibliographic records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.terms import exploded
from ..schema import with_key


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def fine(df: DataFrame) -> int:
    """Partitions for a shuffle of a table that is read: as many times as its files are cut, so that a task's part doesn't grow with it."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 6 * df.rdd.getNumPartitions())


def papers(spark: SparkSession, d: str) -> DataFrame:
    """Orders as papers: record_key, ord, py, tc, source, custkey."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("record_key"), F.col("o_orderkey").alias("ord"), F.year("o_orderdate").alias("py"), F.floor(F.col("o_totalprice") / 1000).cast("long").alias("tc"), F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("custkey")
    )


def terms(spark: SparkSession, d: str, dimension: str, distinct: bool = True) -> DataFrame:
    """The bridge (record_key, ord, py, tc, source, pos, term, key) of orders in a dimension."""
    p = papers(spark, d)
    if dimension == "journals":
        c = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("term"))
        rows = p.join(c, "custkey").withColumn("pos", F.lit(0))
    else:
        lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("record_key"), "l_suppkey", "l_partkey", F.col("l_linenumber").alias("pos"))
        if dimension in ("authors", "countries"):
            s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey")
            n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
            rows = lines.join(s, "l_suppkey").join(n, "s_nationkey").withColumn("term", F.col("s_name" if dimension == "authors" else "n_name"))
        elif dimension == "keywords":
            k = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("term"))
            rows = lines.join(k, "l_partkey")
        else:
            rows = lines.withColumn("term", F.col("l_partkey").cast("string"))
        n = fine(lines)
        rows = rows.select("record_key", "term", "pos").repartition(n, "record_key")
        if distinct:  # of rows that are together by record, so that no task holds more than its part of them
            rows = rows.groupBy("record_key", "term").agg(F.min("pos").alias("pos"))
        rows = rows.join(p.drop("custkey").repartition(n, "record_key"), "record_key")
    return rows.select("record_key", "ord", "py", "tc", "source", "pos", "term", F.lower("term").alias("key"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as records with fields, one file a source: the first line is the title, identifiers are digests."""
    text = F.col("text")
    fields = {
        "TI": F.substring_index(text, "\n", 1), "PY": (F.lit(2000) + F.col("doc_id") % 5).cast("string"), "AU": F.concat("lang", F.lit(", X")), "SO": F.col("source"), "AB": text, "LA": F.col("lang"),
        "DI": F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://doi.org/10.1/"), F.md5(text.cast("binary")), (F.col("doc_id") % 2).cast("string"))), "UT": F.when(F.col("doc_id") % 3 != 1, F.concat(F.lit("U:"), F.md5(F.substring_index(text, "\n", 1).cast("binary")))),
        "TC": F.when(F.col("doc_id") % 4 != 0, F.col("n_chars").cast("string")),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.array(v).alias("v")) for k, v in fields.items()])
    rows = table(spark, d, "documents").select(
        F.col("source").alias("source_file"), F.col("doc_id").cast("int").alias("source_index"), F.when(F.col("doc_id") % 2 == 0, "wos").otherwise("scopus").alias("source_kind"), F.lit("ris").alias("source_format"), F.lit("").alias("raw_block"), F.col("doc_id").alias("ord"),
        F.map_from_entries(F.filter(pairs, lambda x: F.get(x["v"], 0).isNotNull())).alias("fields"),
    )
    return with_key(rows)


def words(spark: SparkSession, d: str) -> DataFrame:
    """The words of documents as keyword spellings, with the part they come from; record_key is the id."""
    return exploded(word_lists(spark, d), "de", "term")


def word_lists(spark: SparkSession, d: str) -> DataFrame:
    """The same words as an array of each document."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("record_key"), F.regexp_extract_all(F.col("text"), F.lit(r"([A-Za-z]+-?[A-Za-z]*)"), F.lit(1)).alias("de"))


def bibliography(spark: SparkSession, d: str, tags: tuple[str, ...] = ("TI", "PY", "SO", "DE", "AU", "CR")) -> DataFrame:
    """Orders as whole records: brands as keywords, suppliers as authors, segments as journals, parts as cited references.

    Of the fields only those of `tags` are gathered, and only the tables that hold them are read.
    """
    lines = table(spark, d, "lineitem")
    n = fine(lines)
    lines = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    if {"DE", "CR"} & {*tags}:
        lines = lines.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"), "l_partkey")
    if {"AU", "CR"} & {*tags}:
        lines = lines.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    listed = {"DE": F.col("p_brand"), "AU": F.col("s_name"), "CR": F.concat_ws(", ", "s_name", (F.lit(1990) + F.col("l_partkey") % 30).cast("string"), "p_type", F.concat(F.lit("V"), "l_partkey"))}
    items = F.struct("l_linenumber", *[c.alias(tag) for tag, c in listed.items() if tag in tags])
    # an order has seven lines at most; they are dealt out first, as gathering them before a shuffle saves nothing
    cited = lines.select("l_orderkey", items.alias("item")).repartition(n, "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("item")).alias("own"))
    rows = table(spark, d, "orders")
    if "SO" in tags:
        rows = rows.join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    own = {"TI": lambda: F.array(F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))), "PY": lambda: F.array(F.year("o_orderdate").cast("string")), "SO": lambda: F.array("c_mktsegment")}
    rows = rows.select("o_orderkey", *[own[tag]().alias(tag) for tag in tags if tag in own]).repartition(n, "o_orderkey").hint("shuffle_hash").join(cited, F.col("o_orderkey") == F.col("l_orderkey"))
    pairs = F.create_map(*[c for tag in tags for c in (F.lit(tag), F.col(tag if tag in own else f"own.{tag}"))])
    return with_key(rows.select(F.lit("orders").alias("source_file"), F.col("o_orderkey").cast("int").alias("source_index"), F.lit("wos").alias("source_kind"), F.lit("ris").alias("source_format"), F.lit("").alias("raw_block"), F.col("o_orderkey").alias("ord"), pairs.alias("fields")))
