"""The record table: one row per bibliographic record, its tagged values as a map of arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_SCHEMA = "source_file string, source_index int, source_kind string, source_format string, raw_block string, ord long, fields map<string, array<string>>"

# Tags whose values are joined by "; " as text, and the order and form in which tags are exported.
MULTI_VALUE_TAGS = ("AU", "AF", "BA", "BE", "BF", "CA", "GP", "C1", "EM", "RI", "OI", "CR", "DE", "ID", "WC", "SC", "FU", "FX")
EXPORT_ORDER = ("PT", "AU", "AF", "TI", "SO", "LA", "DT", "DE", "ID", "AB", "C1", "C3", "RP", "EM", "CR", "NR", "TC", "Z9", "U1", "U2", "PU", "PI", "PA", "SN", "EI", "J9", "JI", "PD", "PY", "VL", "IS", "BP", "EP", "AR", "DI", "UT", "WC", "SC", "CO")
CONTINUED_TAGS = ("AU", "AF", "BA", "BE", "BF", "CA", "GP", "CR", "RI", "OI")
SEMICOLON_TAGS = ("DE", "ID", "WC", "SC")


def records(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Records from dicts of tag to value or values; keys in lower case are columns of the record itself."""
    found = []
    for k, row in enumerate(rows):
        fields = {t: [v] if isinstance(v, str) else list(v) for t, v in row.items() if t.isupper()}
        found.append((row.get("source_file", "memory"), row.get("source_index", k + 1), row.get("source_kind", "wos"), row.get("source_format", "wos_tagged"), row.get("raw_block", ""), row.get("ord", k), fields))
    return with_key(spark.createDataFrame(found, RECORD_SCHEMA))


def with_key(df: DataFrame) -> DataFrame:
    """Adds record_key: 24 hex digits of the file and the place in it."""
    return df.withColumn("record_key", F.substring(F.sha2(F.concat("source_file", F.lit("\0"), F.col("source_index").cast("string")), 256), 1, 24))
