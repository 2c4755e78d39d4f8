"""Document fingerprints: Merkle trees over paragraphs and sections. DataFrame expressions only.

A text's paragraphs are its lines, `SECTION` neighbouring paragraphs are a section, and runs of `LEAF` words within
a paragraph are the leaves. A leaf's digest is the SHA-256 of its text, a paragraph's that of its leaves' digests, a
section's that of its paragraphs' digests, the root that of the sections'. The fingerprint is the tree written out:
`root/section;section;...`, a section as `digest:paragraph,paragraph,...`, a paragraph as `digest:leafleaf...`; the
root in full, all others by their first 8 digits. Equal roots mean equal texts. Where roots differ, differing branches
are followed down: to find what two texts share (`likeness`), and where one was edited (`edits`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

SECTION, LEAF = 8, 4
#: Covers every character of a paragraph: words with the space after them, and space before the first.
_LEAVES = rf"(?:[^\\s]++[\\s]*+){{1,{LEAF}}}+|[\\s]++"


def _let(name: str, value: str, body: str) -> str:
    """SQL: `body` with `name` for `value`, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _node(kind: str, parts: str) -> str:
    """SQL: the digest of a node over the array `parts` of its children's digests."""
    return f"sha2(concat('{kind}', array_join({parts}, '')), 256)"


def fingerprint(text: str) -> Column:
    """The fingerprint of the non-null string column `text`; an empty text is one paragraph without leaves."""
    leaves = f"transform(regexp_extract_all(p, '{_LEAVES}', 0), x -> sha2(x, 256))"
    paragraph = f"struct({_node('p', 'ls')} as d, array_join(transform(ls, x -> left(x, 8)), '') as leaves)"
    paragraphs = f"transform(split({text}, '\\n', -1), p -> {_let('ls', leaves, paragraph)})"
    section = f"struct({_node('s', 'transform(own, x -> x.d)')} as d, array_join(transform(own, x -> concat(left(x.d, 8), ':', x.leaves)), ',') as body)"
    sections = f"transform(sequence(0, cast((size(ps) - 1) div {SECTION} as int)), i -> {_let('own', f'slice(ps, {SECTION} * i + 1, {SECTION})', section)})"
    whole = f"concat({_node('r', 'transform(ss, x -> x.d)')}, '/', array_join(transform(ss, x -> concat(left(x.d, 8), ':', x.body)), ';'))"
    return F.expr(_let("ps", paragraphs, _let("ss", sections, whole)))


def root(fp: str) -> Column:
    return F.substring_index(F.col(fp), "/", 1)


def _sections(fp: str) -> str:
    return f"split(substring_index({fp}, '/', -1), ';')"


def likeness(a: str, b: str) -> Column:
    """Of two fingerprint columns: 1 if the roots are equal, else the shared part of the leaves (Dice), below 1.

    Branches of equal digests, wherever they stand, are shared as a whole: sections first, of the other sections the
    paragraphs, of the other paragraphs the leaves. What is repeated within a text counts once. Null if one is null.
    """
    inside = lambda parts: f"flatten(transform({parts}, x -> split(substr(x, 10), ',')))"
    size = lambda parts: f"aggregate({parts}, 0, (n, x) -> n + cast((length(x) - 9) div 8 as int))"
    cut = lambda parts: f"array_distinct(flatten(transform({parts}, x -> regexp_extract_all(substr(x, 10), '[0-9a-f]{{8}}', 0))))"
    dice = _let("both", "size(array_intersect(z.a, z.b))", "2.0D * (y.n + both) / (2 * y.n + size(z.a) + size(z.b) + 1e-9D)")
    leaves = _let("z", f"struct({cut('y.pa')} as a, {cut('y.pb')} as b)", dice)
    others = f"struct(array_except(x.pa, x.pb) as pa, array_except(x.pb, x.pa) as pb, {size('array_intersect(x.pa, x.pb)')} + {size(inside('x.both'))} as n)"
    paragraphs = f"struct({inside('array_except(w.sa, w.sb)')} as pa, {inside('array_except(w.sb, w.sa)')} as pb, array_intersect(w.sa, w.sb) as both)"
    part = F.expr(_let("w", f"struct({_sections(a)} as sa, {_sections(b)} as sb)", _let("x", paragraphs, _let("y", others, leaves))))
    return F.when(F.col(a).isNull() | F.col(b).isNull(), None).when(root(a) == root(b), 1.0).otherwise(F.least(part, F.lit(1 - 1e-6)))


def edits(a: str, b: str) -> Column:
    """Where two fingerprint columns differ: array of (section, paragraph), from 0, found by descending differing branches."""
    differing = f"filter(sequence(0, {SECTION - 1}), k -> not (get(y.pa, k) <=> get(y.pb, k)))"
    inside = _let("y", "struct(split(substr(get(z.sa, s), 10), ',') as pa, split(substr(get(z.sb, s), 10), ',') as pb)", f"transform({differing}, k -> struct(s as section, cast({SECTION} * s + k as int) as paragraph))")
    branches = "filter(sequence(0, greatest(size(z.sa), size(z.sb)) - 1), s -> not (left(get(z.sa, s), 8) <=> left(get(z.sb, s), 8)))"
    found = _let("z", f"struct({_sections(a)} as sa, {_sections(b)} as sb)", f"flatten(transform({branches}, s -> {inside}))")
    return F.when(root(a) == root(b), F.expr("cast(array() as array<struct<section:int,paragraph:int>>)")).otherwise(F.expr(found))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint of every row; a null text counts as empty; null ids and repeated rows are kept."""
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    return rows.select(F.col("id").alias(id_col), fingerprint("text").alias("fingerprint"))


def _buckets(ids: DataFrame, n: int) -> list:
    """Ascending bounds that part the numeric column `id` into about `n` equal ranges: statistics of all ids."""
    shares = ",".join(f"{k / n:.6f}D" for k in range(1, n))
    bounds = ids.select(F.expr(f"percentile_approx(id, array({shares}), {20 * n})")).first()[0] if n > 1 else None
    return sorted(set(bounds or []))


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds next_<column>: the values of the row with the next larger `id`; after the last comes the first.

    Ids are numbers, else a TypeError. Rows are dealt out by ranges of ids; each range also gets a copy of the first row
    of the range after it, so no task sees more than a range. Null ids come first; equal ids are ordered by the columns.
    """
    kind = rows.schema["id"].dataType
    if not isinstance(kind, NumericType):
        raise TypeError(f"ids are numbers here, not {kind.simpleString()}")
    n = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _buckets(rows.select("id"), n)

    def numbers(values: list, of: str) -> str:
        """SQL: an array of numbers; a table of the ranges goes into the plan as one literal."""
        return f"cast(split('{','.join('' if v is None else str(v) for v in values)}', ',') as array<{of}>)"

    position = "0"
    if bounds:
        step = 1 << len(bounds).bit_length()
        while step > 1:  # the position among the bounds, by halving
            step //= 2
            position = f"transform(array({position}), k -> k + if(k + {step} <= {len(bounds)} and get(s, k + {step - 1}) < id, {step}, 0))[0]"
        position = _let("s", numbers(bounds, kind.simpleString()), position)
    rows = rows.withColumn("bucket", F.coalesce(F.expr(position), F.lit(0)))
    # at most n rows: each range's number and its smallest id
    firsts = sorted(((r.bucket, r.least) for r in rows.groupBy("bucket").agg(F.expr("min(struct(id)).id").alias("least")).collect()), key=lambda r: r[0])
    if not firsts:
        return rows.drop("bucket").select("*", *[F.lit(None).cast(rows.schema[c].dataType).alias(f"next_{c}") for c in columns])
    least, goes = [None] * (len(bounds) + 1), [0] * (len(bounds) + 1)
    for k, (b, v) in enumerate(firsts):
        least[b], goes[b] = v, firsts[k - 1][0]
    is_first = F.col("id").eqNullSafe(F.expr(f"get({numbers(least, 'string')}, bucket)").try_cast(kind))  # '' is null
    # (range, after): copies stand after all rows of the range; that of the very first row goes to the last range
    own = F.struct(F.col("bucket").alias("b"), F.lit(0).alias("after"))
    copy = F.struct(F.expr(f"get({numbers(goes, 'int')}, bucket)").alias("b"), F.lit(1).alias("after"))
    dealt = rows.withColumn("to", F.explode(F.when(is_first, F.array(own, copy)).otherwise(F.array(own)))).drop("bucket")
    w = Window.partitionBy("to.b").orderBy("to.after", "id", *columns)
    found = dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return found.where("to.after = 0").drop("to")


def edit_probe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of an edited form of it, and how like they are.

    The edit replaces the last floor(n_chars / 4) code points by the first as many (or all) of the next document by
    ascending id. Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and where
    the trees differ: edited_paragraphs (how many) and edited_from (the first, as section.paragraph; null if none). A
    null text counts as empty; a single row is its own next; null ids come first; repeated rows are kept; an empty
    table gives none; other columns are ignored. Long texts are hashed whole.
    """
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("fingerprint", fingerprint("text")), ["text", "fingerprint"])
    rows = rows.withColumn("edited", F.expr("concat(left(text, char_length(text) - cast(char_length(text) div 4 as int)), left(next_text, cast(char_length(text) div 4 as int)))"))
    rows = rows.select("id", "text", "fingerprint", "next_fingerprint", "edited", fingerprint("edited").alias("edited_fingerprint"))
    return rows.select(
        F.col("id").alias(id_col), F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"), edits("fingerprint", "edited_fingerprint").alias("edits"),
    ).select("*", F.size("edits").cast("long").alias("edited_paragraphs"), F.expr("concat(get(edits, 0).section, '.', get(edits, 0).paragraph)").alias("edited_from")).drop("edits")
