"""URL filters by rules of a host and a path prefix: expressions, an equi-join on short hash prefixes, full digests, precedence.

A URL is expanded into the suffixes of its host (only those of as many labels as some rule has); each meets the hosts of
rules by the first four bytes of its SHA-256 and is confirmed by the whole digest. A confirmed host brings the lengths of
its rules' paths, at which the URL's path is cut; host and cut path meet the rules in the same way. Of the rules that fit,
the longest wins. Every equal host and path is judged once, so that a page that repeats costs a row of a join.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
#: Names of hosts have no more labels than this; rules that have are refused.
LABELS = 127
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; path: from there up to `?`, `#` or the end.

    Both are empty for null and for a text without `://`.
    """
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    tail = F.substring(rest, F.char_length(host) + 1, F.char_length(rest))
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(tail, "^[^?#]*", 0)


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """verdict, host and path of rules given as (verdict, text): `example.org/es/` is the host up to the first slash and the path."""
    rows = []
    for verdict, text in rules:
        host, slash, path = text.partition("/")
        rows.append((verdict, host, slash + path))
    return spark.createDataFrame(rows, "verdict string, host string, path string")


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _short(digest: Column) -> Column:
    """The first four bytes of a digest, in hex."""
    return F.substring(digest, 1, 8)


def _labels(host: Column) -> Column:
    return F.char_length(host) - F.char_length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _checked(rules: DataFrame) -> tuple[DataFrame, list[int]]:
    """Each rule once, a block before an allow of the same text; and how many labels hosts of rules have."""
    rules = rules.select("verdict", F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path")).where("host <> ''")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"), F.count_if(~F.col("verdict").isin(ALLOW, BLOCK) | F.col("verdict").isNull()).alias("odd"))
    found = rules.agg(F.array_sort(F.collect_set(F.when(_labels(F.col("host")) <= LABELS, _labels(F.col("host"))).otherwise(LABELS + 1))).alias("labels"), F.sum("odd").alias("odd")).first()
    if found.odd:
        raise ValueError(f"a rule is neither {ALLOW} nor {BLOCK}")
    if LABELS + 1 in found.labels:
        raise ValueError(f"a rule's host has more than {LABELS} labels")
    return rules.drop("odd"), list(found.labels)


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, verdict: every rule that fits a host and path of `urls` (each pair given once)."""
    rules, labels = _checked(rules)
    names = rules.groupBy("host").agg(F.collect_set(F.char_length("path")).alias("_cuts")).select(_digest(F.col("host")).alias("_name_digest"), "_cuts").withColumn("_name_short", _short(F.col("_name_digest")))
    texts = rules.select("verdict", F.concat("host", "path").alias("rule"), F.char_length("host").alias("_host_length")).withColumn("_rule_digest", _digest(F.col("rule"))).withColumn("_rule_short", _short(F.col("_rule_digest")))
    if not labels:
        suffixes = F.array().cast("array<string>")
    else:
        suffixes = F.array_compact(F.array(*[F.when(_labels(F.col("host")) >= k, F.substring_index("host", ".", -k)) for k in labels]))
    hosts = urls.where("host <> ''").select("host", "path", F.explode(suffixes).alias("_suffix")).withColumn("_digest", _digest(F.col("_suffix")))
    known = hosts.join(names, _short(F.col("_digest")) == F.col("_name_short")).where("_digest = _name_digest")
    cut = known.select("host", "path", "_suffix", F.explode("_cuts").alias("_cut")).where(F.char_length("path") >= F.col("_cut"))
    cut = cut.withColumn("_digest", _digest(F.concat("_suffix", F.expr("left(path, _cut)"))))
    return cut.join(texts, _short(F.col("_digest")) == F.col("_rule_short")).where("_digest = _rule_digest").select("host", "path", "rule", "verdict", "_host_length")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """Per row of `pages`: its id, host, path, rule (text of the rule that decides, else null) and verdict.

    `rules` has verdict, host and path. A rule fits its host and all subdomains where the URL's path starts with the
    rule's, wherever in a segment that ends. The longest text of host and path wins, of equal ones the longer host; of a
    rule that is given as both, the block. Where none fits, the verdict is `default`.

    Null and empty URLs, and those without `://`, have an empty host that no rule fits. Null and repeated ids stay, a row
    for a row; an empty table gives none, an empty rule table the default. Very long URLs are expanded no further than
    the longest rule. Columns of any other name are ignored.
    """
    host, path = host_and_path(pages[url_col])
    rows = pages.select(pages[id_col].alias(id_col), host.alias("host"), path.alias("path"))
    fits = fitting_rules(rows.select("host", "path").distinct(), rules)
    order = F.struct(F.char_length("rule"), "_host_length")
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), order).alias("_best"))
    judged = rows.join(best, ["host", "path"], "left")
    return judged.select(id_col, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
