"""Personal data: base patterns, and weak supervision for spans beyond them. DataFrame expressions only.

Base spans (email, ip, card, phone) are fixed patterns with checks. Further candidates (assignments of secrets, key
ids, long numbers) get votes of -1, 0 or 1 from labelers: patterns of known secrets, a gazetteer of key words, the
words before the span, the value's shape and its check digit. Expectation-maximisation estimates each labeler's
reliability without labels, and its posteriors train the final span classifier, a logistic regression over features of
the span itself (its length, variety and classes of characters, the words at it). Only the counts of the distinct
vectors of votes and features come to the driver, at most 3**5 * 2**9; the weights go back into the plan as literals.

Added spans may overlap base ones, which stay as they are; for redaction spans that overlap are one. Positions and
redaction take time in proportion to the text, also where a very long text has many thousand spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, written so that they never look at a character of a run twice. A run's first
# character, or the end of the match before (\G), is the only place where a match can begin leftmost.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "secret", "number")

# Candidates beyond the base.
SECRET = r"""\b[A-Za-z_]{2,20} ?[=:] ?"?[A-Za-z0-9_/+-]{8,}+"?|\b[A-Z]{4}[A-Z0-9]{12,}+\b"""
NUMBER = r"(?<![0-9])[0-9](?:[ .()-]?[0-9]){8,18}+(?![0-9])"
#: The gazetteer: what secrets are called, and what stands before personal numbers.
KEYS = ("password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "api_key", "auth", "credential", "private_key", "access_key")
BEFORE = ("account", "card", "iban", "passport", "phone", "tel", "telephone", "mobile", "fax", "ssn", "konto", "telefon", "carte", "tarjeta")
LABELERS = ("pattern", "gazetteer", "context", "shape", "check")


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _digits_hold(value: str, least: int, most: int, luhn: bool) -> str:
    """The value has from `least` to `most` digits and, if asked, a right check digit."""
    digit = "cast(substr(d, length(d) - i + 1, 1) as int)"
    check = f" and aggregate(sequence(1, length(d)), 0, (a, i) -> a + if(i % 2 = 0, 2 * {digit} - if({digit} > 4, 9, 0), {digit})) % 10 = 0"
    return f"exists(array({_digits(value)}), d -> length(d) between {least} and {most}{check if luhn else ''})"


#: What a match must pass, over `x.value`.
CHECKS = {
    "email": "true",
    "ip": "forall(split(x.value, '[.]'), p -> length(regexp_replace(p, '^0+(?=.)', '')) <= 3 and cast(right(p, 3) as int) <= 255)",
    "card": _digits_hold("x.value", 12, 19, True),
    "phone": _digits_hold("x.value", 9, 15, False),
}
#: Cheap tests without which a pattern can't match.
NEEDS = {"email": "instr(text, '@') > 0", "ip": "text rlike '[0-9][.][0-9]'", "card": "text rlike '[0-9]'", "phone": "instr(text, '+') > 0", "secret": "text rlike '[=:]|[A-Z]{4}[A-Z0-9]{12}'", "number": "text rlike '[0-9]'"}


def _with_matches(df: DataFrame, kind: str, pattern: str) -> DataFrame:
    """Adds column `kind`: array of (start, end, value), leftmost matches without overlap, in code points, end exclusive."""
    hits, gaps = f"_h_{kind}", f"_g_{kind}"
    literal = F.lit(pattern)
    df = df.withColumn(hits, F.when(F.expr(NEEDS[kind]), F.regexp_extract_all("text", literal, F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(gaps, F.when(F.size(hits) > 0, F.split("text", pattern, -1)).otherwise(F.array().cast("array<string>")))
    # ends of matches are sums over all before: sums of blocks of 64, then of a block's own
    found = f"""if(size({hits}) = 0, cast(array() as array<struct<start:int,end:int,value:string>>),
        transform(array(zip_with(slice({gaps}, 1, size({hits})), {hits}, (g, h) -> struct(length(g) + length(h) as step, length(h) as n, h as value))), m ->
        transform(array(transform(sequence(0, cast((size(m) - 1) div 64 as int)), b -> aggregate(slice(m, 64 * b + 1, 64), 0, (a, x) -> a + x.step))), s ->
        transform(array(transform(sequence(0, size(s) - 1), b -> aggregate(slice(s, 1, b), 0, (a, x) -> a + x))), o ->
        transform(transform(m, (x, i) -> struct(o[cast(i div 64 as int)] + aggregate(slice(m, i - i % 64 + 1, i % 64 + 1), 0, (a, y) -> a + y.step) as end, x.n as n, x.value as value)),
            x -> struct(x.end - x.n as start, x.end as end, x.value as value)))[0])[0])[0])"""
    return df.withColumn(kind, F.expr(found)).drop(hits, gaps)


def base_spans(rows: DataFrame) -> DataFrame:
    """Adds columns email, ip, card and phone to rows with a `text`: the checked base spans."""
    for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        rows = _with_matches(rows, kind, pattern)
        rows = rows.withColumn(kind, F.expr(f"filter({kind}, x -> {CHECKS[kind]})"))
    return rows


def _words(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _votes(x: str) -> str:
    """The struct of the labelers' votes on span `x` of `text`."""
    value = f"{x}.value"
    key = f"lower(regexp_extract({value}, '^([A-Za-z_]+) ?[=:]', 1))"
    body = f"regexp_replace({value}, '^[A-Za-z_]+ ?[=:] ?', '')"
    before = f"lower(regexp_extract(substr(text, greatest(1, {x}.start - 23), least(24, {x}.start)), '([A-Za-z]+)[^A-Za-z0-9]*$', 1))"
    return f"""struct(
        case when {value} rlike 'AKIA[0-9A-Z]{{16}}|[0-9a-f]{{16}}' then 1 when not {body} rlike '[0-9]' then -1 else 0 end as pattern,
        case when {key} = '' then 0 when {key} in {_words(KEYS)} then 1 else -1 end as gazetteer,
        case when {before} in {_words(BEFORE + KEYS)} then 1 when {value} rlike '^[A-Za-z_]+ ?=' then 1 when {value} rlike '^[A-Za-z_]+ ?:' then -1 else 0 end as context,
        case when {body} rlike '[A-Za-z]' and {body} rlike '[0-9]' then 1 else -1 end as shape,
        case when {value} rlike '[A-Za-z]' then 0 when {_digits_hold(value, 13, 19, True)} then 1 else -1 end as check)"""


FEATURES = ("is_number", "long", "very_long", "varied", "mixed", "upper", "key_word", "other_word", "word_before")


def _features(x: str, kind: str) -> str:
    """The struct of the classifier's features of span `x` of `text`, 0 or 1 each."""
    value = f"{x}.value"
    body = f"regexp_replace({value}, '^[A-Za-z_]+ ?[=:] ?', '')"
    key = f"lower(regexp_extract({value}, '^([A-Za-z_]+) ?[=:]', 1))"
    before = f"lower(regexp_extract(substr(text, greatest(1, {x}.start - 23), least(24, {x}.start)), '([A-Za-z]+)[^A-Za-z0-9]*$', 1))"
    tests = ("true" if kind == "number" else "false", f"length({body}) >= 14", f"length({body}) >= 28", f"size(array_distinct(split({body}, ''))) >= 9", f"{body} rlike '[A-Za-z]' and {body} rlike '[0-9]'", f"{body} rlike '[A-Z]'", f"{key} in {_words(KEYS)}", f"{key} <> '' and not {key} in {_words(KEYS)}", f"{before} in {_words(BEFORE + KEYS)}")
    return "struct(" + ", ".join(f"cast({test} as int) as {name}" for name, test in zip(FEATURES, tests)) + ")"


def _candidates(rows: DataFrame) -> DataFrame:
    """Adds `candidates`: (start, end, kind, features, votes) of spans beyond the base, secrets first."""
    rows = _with_matches(_with_matches(rows, "secret", SECRET), "number", NUMBER)
    parts = [f"transform({k}, x -> struct(x.start as start, x.end as end, '{k}' as kind, {_features('x', k)} as features, {_votes('x')} as votes))" for k in ("secret", "number")]
    return rows.withColumn("candidates", F.expr(f"concat({', '.join(parts)})")).drop("secret", "number")


def estimate(counts: dict[tuple[int, ...], int], rounds: int = 60) -> tuple[list[dict[int, float]], dict[tuple[int, ...], float]]:
    """Expectation-maximisation over vote vectors: each labeler's log odds per vote, and each vector's posterior."""
    posterior = {v: 0.9 if sum(v) > 0 else 0.1 if sum(v) < 0 else 0.3 for v in counts}
    odds: list[dict[int, float]] = []
    for _ in range(rounds):
        mass = [sum(n * (posterior[v] if y else 1 - posterior[v]) for v, n in counts.items()) for y in (0, 1)]
        odds = []
        for j in range(len(LABELERS)):
            p = [{x: 1.0 for x in (-1, 0, 1)} for _ in (0, 1)]
            for v, n in counts.items():
                p[1][v[j]] += n * posterior[v]
                p[0][v[j]] += n * (1 - posterior[v])
            # a labeler that abstains says nothing
            odds.append({x: math.log(p[1][x] / (mass[1] + 3)) - math.log(p[0][x] / (mass[0] + 3)) if x else 0.0 for x in (-1, 0, 1)})
        prior = math.log((mass[1] + 1) / (mass[0] + 1))
        posterior = {v: 1 / (1 + math.exp(-max(-50.0, min(50.0, prior + sum(o[x] for o, x in zip(odds, v)))))) for v in counts}
    return odds, posterior


def train(counts: dict[tuple[tuple[int, ...], tuple[int, ...]], int], steps: int = 400) -> list[float]:
    """Weights (first the bias, then one for each feature) of a logistic classifier, from counts of (votes, features)."""
    by_votes: dict[tuple[int, ...], int] = {}
    for (v, _), n in counts.items():
        by_votes[v] = by_votes.get(v, 0) + n
    _, posterior = estimate(by_votes)
    # per feature vector: how many spans, and how many of them are expected to be personal
    mass: dict[tuple[int, ...], list[float]] = {}
    for (v, f), n in counts.items():
        own = mass.setdefault((1, *f), [0.0, 0.0])
        own[0] += n
        own[1] += n * posterior[v]
    total = sum(by_votes.values())
    w = [0.0] * (1 + len(FEATURES))
    for _ in range(steps):
        g = [0.002 * x for x in w]
        for f, (n, expected) in mass.items():
            e = (n / (1 + math.exp(-max(-50.0, min(50.0, sum(a * b for a, b in zip(w, f)))))) - expected) / total
            g = [a + e * b for a, b in zip(g, f)]
        w = [a - 1.5 * b for a, b in zip(w, g)]
    return w


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def fit_span_classifier(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float] | None:
    """Counts the vectors of votes and features of all candidates of all documents and trains on them; None without candidates."""
    keys = [F.col(f"c.votes.{x}").alias(f"v_{x}") for x in LABELERS] + [F.col(f"c.features.{x}").alias(f"f_{x}") for x in FEATURES]
    found = _candidates(_texts(docs, id_col, text_col)).select(F.explode("candidates").alias("c")).groupBy(*keys).count()
    counts = {(tuple(r[f"v_{x}"] for x in LABELERS), tuple(r[f"f_{x}"] for x in FEATURES)): r["count"] for r in found.collect()}
    return train(counts) if counts else None


def _joined(spans: str) -> Column:
    order = "cast(array_position(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), x.kind) as int)"
    rows = f"array_sort(transform({spans}, x -> struct(x.start as start, {order} as nth, x.end as end, x.kind as kind)))"
    return F.expr(f"array_join(transform({rows}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def with_spans(rows: DataFrame, weights: list[float] | None) -> DataFrame:
    """Adds to rows with a non-null `text`: the four base columns, `base` and `spans`, arrays of (start, end, kind)."""
    rows = base_spans(rows)
    base = ", ".join(f"transform({k}, x -> struct(x.start as start, x.end as end, '{k}' as kind))" for k in KINDS[:4])
    rows = rows.withColumn("base", F.expr(f"concat({base})"))
    if weights is None:
        return rows.withColumn("spans", F.col("base"))
    rows = _candidates(rows)
    score = " + ".join([f"{weights[0]!r}D", *(f"{w!r}D * x.features.{name}" for w, name in zip(weights[1:], FEATURES))])
    added = f"filter(candidates, x -> {score} > 0)"
    return rows.withColumn("spans", F.expr(f"concat(base, transform({added}, x -> struct(x.start as start, x.end as end, x.kind as kind)))")).drop("candidates")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all, as kind:start:end).

    Positions are code points, end exclusive; spans come by start, then kind. A null or empty text has no spans;
    null ids and repeated rows are kept; an empty table gives none; other columns are ignored.
    """
    rows = with_spans(_texts(docs, id_col, text_col), fit_span_classifier(docs, id_col, text_col))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return rows.select(F.col("id").alias(id_col), *counts, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


#: Code points in a block of a text that is cut up.
_CUT = 4096


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: list[float] | None = None) -> DataFrame:
    """`docs` with every span of `text_col` replaced by its kind in brackets; all other columns and rows stay.

    A null text stays null, an empty one empty. Overlapping spans become one placeholder of the first kind (by start,
    then end, then name).
    """
    if weights is None:
        weights = fit_span_classifier(docs, id_col, text_col)
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    found = with_spans(own, weights).select("row", "text", F.expr("array_sort(spans)").alias("spans"))
    # spans that don't overlap, each with the end of the one before
    merged = """aggregate(spans, cast(array() as array<struct<start:int,end:int,kind:string>>), (s, x) ->
        if(size(s) > 0 and x.start < s[size(s) - 1].end, if(x.end <= s[size(s) - 1].end, s, concat(slice(s, 1, size(s) - 1), array(struct(s[size(s) - 1].start as start, x.end as end, s[size(s) - 1].kind as kind)))), concat(s, array(x))))"""
    blocks = f"transform(sequence(0, cast(char_length(text) div {_CUT} as int)), b -> substr(text, {_CUT} * b + 1, {_CUT}))"

    def cut(a: str, e: str) -> str:
        """SQL: code points from `a` up to `e`, from the blocks that hold them."""
        return f"if({e} <= {a}, '', array_join(transform(sequence(cast({a} div {_CUT} as int), cast(({e} - 1) div {_CUT} as int)), b -> substr(bs[b], greatest({a} - {_CUT} * b, 0) + 1, least({e} - {_CUT} * b, {_CUT}) - greatest({a} - {_CUT} * b, 0))), ''))"

    clean = f"""transform(array({blocks}), bs -> transform(array({merged}), m -> concat(
        array_join(transform(m, (x, i) -> concat({cut("if(i = 0, 0, m[i - 1].end)", "x.start")}, '[', upper(x.kind), ']')), ''),
        {cut("m[size(m) - 1].end", "char_length(text)")}))[0])[0]"""
    text = F.when(F.col(f"row.`{text_col}`").isNull(), None).when(F.size("spans") == 0, F.col("text")).otherwise(F.expr(clean))
    return found.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
