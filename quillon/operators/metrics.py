"""Trends, rankings and fits over papers and terms.

Papers have (py, tc [, source]); terms have (term [, key, ord, pos], py, tc, source). Each operator is one or two
aggregations, combined before their shuffle.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tally(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("papers"), F.sum(F.coalesce("tc", F.lit(0))).cast("long").alias("citations"))


def annual_trend(papers: DataFrame) -> DataFrame:
    """Papers and citations by year; papers without a year are left out, missing counts add nothing."""
    return _tally(papers.where("py is not null"), F.col("py").alias("year")).orderBy("year")


def place() -> Column:
    """(ord, pos) as one number of the same order: of fixed width, so that its least is hashed where that of a struct would be sorted."""
    least = lambda name, kind, low: F.coalesce(F.col(name).cast(kind), F.lit(low).cast(kind))
    return least("ord", "long", -(1 << 63)).cast("decimal(19,0)") * F.lit(1 << 32).cast("decimal(10,0)") + least("pos", "int", -(1 << 31)).cast("decimal(10,0)")


def rank_terms(terms: DataFrame, limit: int | None = 20) -> DataFrame:
    """By folded key: the label seen first, papers and citations; most papers, then citations, then label."""
    spelled = terms.groupBy("key", "term").agg(F.min(place()).alias("place"), F.count("*").alias("papers"), F.sum(F.coalesce("tc", F.lit(0))).alias("citations"))
    found = spelled.groupBy("key").agg(F.min_by("term", F.struct("place", "term")).alias("name"), F.sum("papers").alias("papers"), F.sum("citations").cast("long").alias("citations"))
    ordered = found.orderBy(F.desc("papers"), F.desc("citations"), F.lower("name"), "key").select("name", "papers", "citations")
    return ordered if limit is None else ordered.limit(max(0, limit))


def dense_trend(papers: DataFrame, group: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Every year from the first (or `start`) to the last (or `end`) for every group seen, with zeros where none."""
    rows = papers.where("py is not null").withColumn("source", F.col(group) if group else F.lit("全部"))
    counts = _tally(rows, "py", "source")
    span = counts.agg(F.coalesce(F.lit(start), F.min("py")).alias("lo"), F.coalesce(F.lit(end), F.max("py")).alias("hi")).where("lo <= hi")
    years = span.select(F.explode(F.sequence("lo", "hi")).alias("py"))
    # the calendar bounds the years; groups may be any number, and are not sent
    frame = counts.select("source").distinct().crossJoin(F.broadcast(years))
    return frame.join(counts, ["py", "source"], "left").select(F.col("py").alias("year"), "source", F.coalesce("papers", F.lit(0)).cast("long").alias("papers"), F.coalesce("citations", F.lit(0)).cast("long").alias("citations"))


def _top(counts: DataFrame, metric: str, n: int) -> DataFrame:
    totals = counts.groupBy("term").agg(F.sum(metric).alias("total"))
    return totals.orderBy(F.desc("total"), F.lower("term"), "term").limit(max(1, n)).select("term")


def plot_ranking(terms: DataFrame, n: int = 20, metric: str = "papers", by_source: bool = False) -> DataFrame:
    """The exact terms with the largest totals, by term and source."""
    counts = _tally(terms.withColumn("source", F.col("source") if by_source else F.lit("全部")), "term", "source")
    # at most n rows
    return counts.join(F.broadcast(_top(counts, metric, n)), "term", "left_semi").select(F.col("term").alias("name"), "source", "papers", "citations")


def yearly_ranking(terms: DataFrame, n: int = 20, metric: str = "papers", by_source: bool = False, start: int | None = None, end: int | None = None) -> DataFrame:
    """The top terms' papers and citations by year, dense for each term and source; totals count undated papers too."""
    counts = _tally(terms.withColumn("source", F.col("source") if by_source else F.lit("全部")), "term", "source", "py")
    kept = counts.join(F.broadcast(_top(counts, metric, n)), "term", "left_semi").where("py is not null")
    span = kept.agg(F.coalesce(F.lit(start), F.min("py")).alias("lo"), F.coalesce(F.lit(end), F.max("py")).alias("hi")).where("lo <= hi")
    frame = kept.select("term", "source").distinct().crossJoin(F.broadcast(span)).select("term", "source", F.explode(F.sequence("lo", "hi")).alias("py"))
    found = frame.join(kept, ["term", "source", "py"], "left")
    return found.select(F.col("term").alias("name"), "source", F.col("py").alias("year"), F.coalesce("papers", F.lit(0)).cast("long").alias("papers"), F.coalesce("citations", F.lit(0)).cast("long").alias("citations"))


def share_of_total(df: DataFrame, value: str, name: str = "share") -> DataFrame:
    total = df.agg(F.sum(value).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn(name, F.when(F.col("_total") != 0, F.col(value) / F.col("_total"))).drop("_total")


def _from_least(df: DataFrame, x: str, *group: str) -> DataFrame:
    """Adds _least, the least x of each group; without a group that is one row for all, joined to every row."""
    least = df.groupBy(*group).agg(F.min(x).alias("_least"))
    return df.join(least, list(group)) if group else df.join(F.broadcast(least))


def linear_fit(df: DataFrame, x: str, y: str, *group: str) -> DataFrame:
    """slope, intercept, r2 with x counted from its least value; r2 is 1 without variance."""
    rows = _from_least(df, x, *group).withColumn("_x", F.col(x) - F.col("_least"))
    fit = rows.groupBy(*group).agg(F.regr_slope(y, "_x").alias("slope"), F.regr_intercept(y, "_x").alias("intercept"), F.regr_r2(y, "_x").alias("r2"), F.var_pop(y).alias("_v"))
    return fit.withColumn("r2", F.when(F.col("_v") == 0, 1.0).otherwise(F.col("r2"))).drop("_v")


def quadratic_fit(df: DataFrame, x: str, y: str, *group: str) -> DataFrame:
    """a x2 + b x + c by least squares from moment sums, x from its least value; null with fewer than three points."""
    rows = _from_least(df, x, *group).select(*group, (F.col(x) - F.col("_least")).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    sums = [F.sum(F.pow("x", F.lit(k))).alias(f"s{k}") for k in range(5)] + [F.sum(F.pow("x", F.lit(k)) * F.col("y")).alias(f"t{k}") for k in range(3)]
    m = rows.groupBy(*group).agg(*sums, F.sum(F.col("y") * F.col("y")).alias("yy"))
    det = lambda a: f"({a[0][0]}*({a[1][1]}*{a[2][2]}-{a[1][2]}*{a[2][1]})-{a[0][1]}*({a[1][0]}*{a[2][2]}-{a[1][2]}*{a[2][0]})+{a[0][2]}*({a[1][0]}*{a[2][1]}-{a[1][1]}*{a[2][0]}))"
    base = [["s4", "s3", "s2"], ["s3", "s2", "s1"], ["s2", "s1", "s0"]]
    right = ["t2", "t1", "t0"]
    for k, name in enumerate("abc"):
        own = [[right[r] if c == k else base[r][c] for c in range(3)] for r in range(3)]
        m = m.withColumn(name, F.expr(f"{det(own)} / nullif({det(base)}, 0D)"))
    rest = F.expr("yy - a * t2 - b * t1 - c * t0")
    total = F.expr("yy - t0 * t0 / s0")
    return m.select(*group, "a", "b", "c", F.when(F.abs(total) < 1e-9, 1.0).otherwise(1 - rest / total).alias("r2"))


def loess(df: DataFrame, x: str, y: str, group: str, span: float = 0.55) -> DataFrame:
    """Local linear smoothing with tricube weights per group; a group is a series of years, so one task holds it."""
    import numpy as np

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        xs, ys = pdf["x"].to_numpy(float) - pdf["x"].min(), pdf["y"].to_numpy(float)
        near = min(len(xs), max(3, math.ceil(span * len(xs)))) - 1
        out = []
        for at in xs:
            d = np.abs(xs - at)
            w = np.clip(1 - (d / max(np.partition(d, near)[near], 1)) ** 3, 0, None) ** 3 + 1e-8
            u = xs - at
            s0, s1, s2, t0, t1 = w.sum(), (w * u).sum(), (w * u * u).sum(), (w * ys).sum(), (w * u * ys).sum()
            det = s0 * s2 - s1 * s1
            out.append((s2 * t0 - s1 * t1) / det if abs(det) > 1e-12 else t0 / s0)
        return pd.DataFrame({"g": pdf["g"], "x": pdf["x"], "fitted": out})

    rows = df.select(F.col(group).cast("string").alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return rows.groupBy("g").applyInPandas(fit, "g string, x double, fitted double").select(F.col("g").alias(group), F.col("x").alias(x), "fitted")


def import_stats(files: DataFrame, records: DataFrame, retained: DataFrame) -> DataFrame:
    """By source: files given, read and failed, records and those that dedupe kept."""
    f = files.groupBy("source").agg(F.count("*").alias("uploaded"), F.count_if(F.col("error").isNull()).alias("success"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    r = records.groupBy(F.col("source_kind").alias("source")).agg(F.count("*").alias("records"))
    k = retained.groupBy(F.col("source_kind").alias("source")).agg(F.count("*").alias("retained"))
    found = f.join(r, "source", "full_outer").join(k, "source", "full_outer").na.fill(0)
    return found.withColumn("deduped", F.col("records") - F.col("retained"))
