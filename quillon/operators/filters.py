"""Filters over records: years, scopes, databases, languages, search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def year_range(start: str, end: str) -> tuple[int | None, int | None]:
    """Bounds from text; each blank or four digits from 1000 on, the first not after the second."""
    bounds = []
    for given in (start.strip(), end.strip()):
        if given and not (len(given) == 4 and given.isascii() and given.isdigit() and given[0] != "0"):
            raise ValueError(f"a year has four digits: {given}")
        bounds.append(int(given) if given else None)
    if None not in bounds and bounds[0] > bounds[1]:
        raise ValueError("the first year is after the last")
    return bounds[0], bounds[1]


def format_range(start: int | None, end: int | None) -> str:
    names = {(True, True): "不限", (True, False): f"{end} 年及以前", (False, True): f"{start} 年及以后"}
    return names.get((start is None, end is None), f"{start} 年" if start == end else f"{start}–{end} 年")


def partition_by_year(df: DataFrame, start: int | None, end: int | None, year: str = "py") -> DataFrame:
    """Adds year_status: included, excluded (outside the bounds) or unknown (kept; named so only if there is a bound)."""
    y = F.col(year)
    outside = F.lit(False)
    if start is not None:
        outside |= y < start
    if end is not None:
        outside |= y > end
    unknown = "included" if start is None and end is None else "unknown"
    return df.withColumn("year_status", F.when(y.isNull(), unknown).when(outside, "excluded").otherwise("included"))


def in_years(df: DataFrame, start: int | None, end: int | None, year: str = "py") -> DataFrame:
    """What the partition keeps, as one predicate that reaches the scan."""
    keep = F.lit(True)
    if start is not None:
        keep &= F.col(year).isNull() | (F.col(year) >= start)
    if end is not None:
        keep &= F.col(year).isNull() | (F.col(year) <= end)
    return df.where(keep)


def by_source_and_language(df: DataFrame, sources: list[str], language: str | None = None, title: str = "ti") -> DataFrame:
    if not sources:
        raise ValueError("no database is chosen")
    df = df.where(F.col("source_kind").isin(*sources))
    return df if language is None else df.where(t.title_language(F.col(title)) == language)


def scope(df: DataFrame, name: str, excluded: DataFrame | None = None, relevant: DataFrame | None = None, key: str = "record_key") -> DataFrame:
    """raw: all; deduped: without excluded keys; classified: of those, the relevant ones."""
    if name == "raw":
        return df
    if excluded is not None:
        df = df.join(excluded.select(key), key, "left_anti")
    if name == "deduped":
        return df
    if name == "classified" and relevant is not None:
        return df.join(relevant.select(key), key, "left_semi")
    raise ValueError(f"unknown scope: {name}")


def with_counts(df: DataFrame, citations: str = "tc", only_source: str | None = None) -> DataFrame:
    """Records that state a citation count, if asked those of one database."""
    df = df.where(F.col(citations).isNotNull())
    return df if only_source is None else df.where(F.col("source_kind") == only_source)


def titled(df: DataFrame, title: str = "ti") -> DataFrame:
    return df.where(F.coalesce(t.strip(F.col(title)), F.lit("")) != "")


def search(df: DataFrame, query: str, *columns: str) -> DataFrame:
    return df.where(F.contains(t.fold(F.concat_ws(" ", *columns)), F.lit(query.strip().lower())))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def restorable(kept: dict, now: dict, results: DataFrame, records: DataFrame, key: str = "record_id") -> bool:
    """Whether stored results still fit: of the same generation and years, and for just the records in question."""
    if any(kept.get(x) != now.get(x) for x in ("generation", "start_year", "end_year")):
        return False
    a, b = results.select(key).distinct(), records.select(key).distinct()
    return a.join(b, key, "left_anti").isEmpty() and b.join(a, key, "left_anti").isEmpty()
