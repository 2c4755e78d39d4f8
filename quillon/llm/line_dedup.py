"""Line dedup by a suffix array over line-ID sequences. DataFrame expressions only.

Blank lines aside, a document is a sequence of line ids. Lines that occur once end every repeat, so only stretches of
repeated lines enter the suffix array. It is built by distributed prefix doubling: from the ranks of suffixes by their
first m lines come those by their first 2m, by ranking the distinct pairs (rank here, rank m lines on) that occur more
than once with a distributed sort. Suffixes of equal rank at a depth are the intervals of the array in which the
longest common prefix has at least that depth.

A run repeats if it has at least `min_words` words and stands elsewhere too, in the same document or another. Every
line of each later copy (by id, then line) of every maximal repeat is deleted. Each such line lies in a shortest run
of `min_words` words that begins or one that ends in the copy, so only these shortest runs, whose intervals come from
two overlapping ranks of the array, have to be looked up: doubling ends at their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stored


def dense_ranks(groups: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Adds `rank`, from 1 in the order of `columns`, to rows that are distinct in them: a distributed sort.

    Ranges of the sorted rows number their own; the ranges' sizes, one row each, are summed before them.
    """
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(groups.repartitionByRange(n, *columns).withColumn("part", F.spark_partition_id()), name)
    own = dealt.withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy(*columns)))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for each of n ranges: small by construction
    return own.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").withColumn("rank", F.col("own") + F.col("before")).drop("part", "own", "before")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc (id and a hash of the text: equal rows are one document) and text."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(F.struct(docs[id_col].alias("id"), F.xxhash64(text).alias("h")).alias("doc"), text.alias("text"))


def repeated_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, k (number among the document's lines that aren't blank), line (its number among all), words, rank (1 line)."""
    lines = F.expr("filter(transform(split(text, '\\n', -1), (l, i) -> struct(i as line, l as l)), x -> x.l rlike '[^ \\\\t\\\\r\\\\f]')")
    rows = _keyed(docs, id_col, text_col).select("doc", F.posexplode(lines).alias("k", "x"))
    rows = rows.select("doc", "k", "x.line", F.unhex(F.md5(F.col("x.l").cast("binary"))).alias("key"), F.size(F.split(F.trim("x.l"), "[ \\t\\r\\f]+")).alias("words"))
    often = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(dense_ranks(often, ["key"], "line_ids"), "key").drop("key").distinct()


def suffix_ranks(suffixes: DataFrame, depth: int) -> list[tuple[int, DataFrame]]:
    """[(m, rows (doc, k, rank))] for m = 1, 2, 4 ... up to `depth`: the suffixes' order by their first m lines.

    Suffixes that no other equals in m lines, or with fewer lines before one that is not repeated, aren't in it.
    """
    levels, m = [(1, suffixes.select("doc", "k", "rank"))], 1
    while 2 * m <= depth:
        w = Window.partitionBy("doc").orderBy("k")
        at = levels[-1][1]
        # the suffix m lines on, if it is in the array, is at most m rows on
        pairs = at.select("doc", "k", F.col("rank").alias("a"), F.max(F.struct("k", "rank")).over(w.rangeBetween(m, m)).alias("on")).where("on is not null").select("doc", "k", "a", F.col("on.rank").alias("b"))
        pairs = stored(pairs, f"pairs_{2 * m}")
        often = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        m *= 2
        levels.append((m, stored(pairs.join(dense_ranks(often, ["a", "b"], f"ranks_{m}"), ["a", "b"]).select("doc", "k", "rank"), f"suffixes_{m}")))
    return levels


def _shortest_runs(suffixes: DataFrame, min_words: int) -> DataFrame:
    """doc, k, n: the shortest runs of `min_words` words of repeated lines from every line on and up to every line."""
    w = Window.partitionBy("doc").orderBy("k")
    stretch = suffixes.withColumn("first", F.col("k") - F.row_number().over(w))
    stretch = stretch.groupBy("doc", "first").agg(F.sort_array(F.collect_list(F.struct("k", "words"))).alias("s"))
    # a line has a word at least, so a run has at most min_words lines
    sums = f"""transform(s, (x, i) -> struct(x.k as k, size(s) - i as left, i as i,
        aggregate(slice(s, i + 1, {min_words}), struct(0 as n, 0 as words), (a, y) -> if(a.words >= {min_words}, a, struct(a.n + 1 as n, a.words + y.words as words))) as on,
        aggregate(reverse(slice(s, greatest(1, i - {min_words} + 2), least(i + 1, {min_words}))), struct(0 as n, 0 as words), (a, y) -> if(a.words >= {min_words}, a, struct(a.n + 1 as n, a.words + y.words as words))) as back))"""
    runs = f"flatten(transform({sums}, x -> filter(array(struct(x.k as k, x.on.n as n, x.on.words as words), struct(x.k - x.back.n + 1 as k, x.back.n as n, x.back.words as words)), r -> r.words >= {min_words})))"
    return stretch.select("doc", F.explode(F.array_distinct(F.expr(f"transform({runs}, r -> struct(r.k as k, r.n as n))"))).alias("r")).select("doc", "r.k", "r.n")


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5) -> DataFrame:
    """doc and lines (array of line numbers from 0): what line dedup deletes; documents that keep all lines are left out."""
    suffixes = stored(repeated_lines(docs, id_col, text_col), "suffixes")
    runs = stored(_shortest_runs(suffixes, min_words), "runs")
    depth = runs.agg(F.max("n")).first()[0]
    if depth is None:
        return runs.select("doc", F.array(F.lit(0)).alias("lines")).limit(0)
    named = None
    for m, level in suffix_ranks(suffixes, depth):
        # runs of m to 2m - 1 lines: the ranks of their first m and their last m lines
        own = runs.where(F.col("n").between(m, 2 * m - 1))
        last = level.select("doc", F.col("k").alias("tail"), F.col("rank").alias("b"))
        own = own.join(level.withColumnRenamed("rank", "a"), ["doc", "k"]).withColumn("tail", F.col("k") + F.col("n") - m).join(last, ["doc", "tail"]).select("doc", "k", "n", "a", "b")
        named = own if named is None else named.unionByName(own)
    named = stored(named, "intervals")
    first = named.groupBy("n", "a", "b").agg(F.min(F.struct("doc", "k")).alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    first = stored(first, "firsts")  # so that the join has a shuffle of its own, whose large partitions can be split
    later = named.join(first, ["n", "a", "b"]).where(F.struct("doc", "k") > F.col("first"))
    gone = later.select("doc", F.explode(F.expr("sequence(k, k + n - 1)")).alias("k")).distinct()
    return gone.join(suffixes.select("doc", "k", "line"), ["doc", "k"]).groupBy("doc").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5) -> DataFrame:
    """`docs` with later copies of repeated runs of lines deleted from `text_col`; n_lines, n_deleted and deleted are added.

    Blank lines are not compared; they stay, unless all other lines go: then the text is empty. Rows that equal each
    other in id and text are one document and are edited alike; of rows that share an id only, the text's hash decides
    which comes first. Null texts stay null, with no lines; null ids come first; an empty table gives none. A very long text
    is split by one task, its lines are rows from then on. Existing columns of the names
    that are added are replaced; all others and all rows stay.
    """
    gone = later_copies(docs, id_col, text_col, min_words).select(F.col("doc.id").alias("_quillon_id"), F.col("doc.h").alias("_quillon_h"), F.col("lines").alias("_quillon_gone"))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(*[c for c in docs.columns if c not in ("n_lines", "n_deleted", "deleted")]).withColumn("_quillon_h", F.xxhash64(text))
    rows = rows.join(gone.withColumnRenamed("_quillon_h", "_quillon_h2"), (rows[id_col].eqNullSafe(F.col("_quillon_id"))) & (rows["_quillon_h"] == F.col("_quillon_h2")), "left").drop("_quillon_id", "_quillon_h", "_quillon_h2")
    lines = F.split(F.col(text_col).cast("string"), "\n", -1)
    clean = F.expr(f"transform(array(split(cast(`{text_col}` as string), '\\n', -1)), ls -> array_join(transform(array_except(sequence(0, size(ls) - 1), _quillon_gone), i -> ls[i]), '\\n'))[0]")
    clean = F.when(clean.rlike(r"[^ \t\r\f\n]"), clean).otherwise("")
    rows = rows.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long"))
    rows = rows.withColumn("n_deleted", F.coalesce(F.size("_quillon_gone"), F.lit(0)).cast("long"))
    return rows.withColumn(text_col, F.when(F.col("_quillon_gone").isNull(), F.col(text_col)).otherwise(clean)).withColumnRenamed("_quillon_gone", "deleted")


def ranges(lines: str) -> str:
    """SQL: an ascending array of numbers as text, neighbours joined: 0-3,7."""
    begins = f"filter({lines}, (x, i) -> i = 0 or get({lines}, i - 1) <> x - 1)"
    ends = f"filter({lines}, (x, i) -> not (get({lines}, i + 1) <=> x + 1))"
    return f"array_join(zip_with({begins}, {ends}, (a, b) -> if(a = b, cast(a as string), concat(a, '-', b))), ',')"
