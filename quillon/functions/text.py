"""Scalar helpers over tags and terms, as column expressions that stay in the JVM.

`fold` is full case folding from the JVM's case mappings; all keys of terms come from it. Where compatibility forms
matter (titles), `alnum_key` applies an Arrow function.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..schema import MULTI_VALUE_TAGS

HAN = "[\\u3400-\\u9fff\\uf900-\\ufaff]"
DASHES = "\\-\\u2010-\\u2015\\u2212"
#: Unicode's white space, which is what `(?U)\\s` matches.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def bind(c: Column, f) -> Column:
    """f(c) with c evaluated once, however often f names it."""
    return F.transform(F.array(c), f)[0]


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.trim(c, F.lit(BLANKS))


def values(tag: str, fields: str = "fields") -> Column:
    """The tag's values, stripped, without blank ones; an empty array if there are none."""
    own = F.coalesce(F.element_at(F.col(fields), tag), F.array().cast("array<string>"))
    return F.filter(F.transform(own, strip), lambda x: x != "")


def text(tag: str, fields: str = "fields") -> Column:
    return F.array_join(values(tag, fields), "; " if tag in MULTI_VALUE_TAGS else " ")


def either(*columns: Column) -> Column:
    """The first that isn't empty, else empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns], F.lit(""))


def either_values(*columns: Column) -> Column:
    return F.coalesce(*[bind(c, lambda x: F.when(F.size(x) > 0, x)) for c in columns], F.array().cast("array<string>"))


def record_id() -> Column:
    name = F.element_at(F.split("source_file", "/"), -1)
    return either(text("UT"), text("DI"), F.concat(name, F.lit("#"), F.col("source_index"), F.lit("@"), F.substring(F.sha1("source_file"), 1, 8)))


def keywords_text() -> Column:
    return F.concat_ws("; ", *[F.when(text(t) != "", text(t)) for t in ("DE", "ID")])


def completeness() -> Column:
    filled = F.size(F.filter(F.map_values("fields"), lambda v: F.exists(v, lambda x: strip(x) != "")))
    return filled * 100 + F.length(text("AB")) + F.length(text("CR"))


def payload() -> Column:
    """What a classifier is shown of a record."""
    parts = {"title": text("TI"), "abstract": text("AB"), "author_keywords": text("DE"), "keywords_plus": text("ID"), "document_type": text("DT"), "year": text("PY"), "wos_categories": either(text("WC"), text("SC"))}
    return F.struct(record_id().alias("record_id"), *[c.alias(n) for n, c in parts.items()])


def publication_year(py: Column | None = None) -> Column:
    """Four ASCII digits from 1000 on, else null."""
    py = text("PY") if py is None else py
    return bind(py, lambda x: F.when(x.rlike("^[1-9][0-9]{3}$"), x.try_cast("int")))


def first_year(c: Column) -> Column:
    """The first year of 1800 to 2199 that stands alone, as text."""
    return F.regexp_extract(c, r"(?U)\b((?:18|19|20|21)[0-9]{2})\b", 1)


def first_doi(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, r"(?i)(10\.[0-9]{4,9}/[^\s\[\]<>;,]+)", 1), "[.、；]+$", "")


def counted(tags: tuple[str, ...] = ("TC", "Z9")) -> Column:
    """The citation count that a record states, or null: no count is not a count of 0."""
    return F.coalesce(*[F.nullif(F.regexp_extract(F.regexp_replace(text(t), ",", ""), "([0-9]+)", 1), F.lit("")).try_cast("long") for t in tags])


def citations() -> Column:
    return F.coalesce(counted(), F.lit(0).cast("long"))


def title_language(title: Column) -> Column:
    return F.when(title.rlike(HAN), "中文").otherwise("英文")


def fold(c: Column) -> Column:
    """Full case folding: the lower case of the upper case of the lower case, but for the two letters that this would change.

    A final sigma is folded to a sigma; a dotless i, whose upper case is an I, stays. Cherokee letters, which fold to
    upper case, come out in lower case. (The translations stand between the case mappings, which the optimizer would
    take for one otherwise.) Of ASCII alone it is the lower case, which most texts get at once.
    """
    return bind(c, folded)


def folded(x: Column) -> Column:
    """`fold` of what is at hand already (a column, an element), which need not be kept to be named several times."""
    return F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(_fold(x))


def _fold(c: Column) -> Column:
    away = "\ufdd0"  # a code point that no text has
    upper = F.upper(F.translate(F.lower(c), "ı", away))
    return F.translate(F.lower(F.translate(upper, away, "ı")), "ς", "σ")


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends. Words of printable ASCII with one space between, as most texts are, stay as they are."""
    return bind(c, squeezed)


def squeezed(x: Column) -> Column:
    """`squeeze` of what is at hand already."""
    return F.when(x.rlike(r"\A[!-~]++(?: [!-~]++)*+\z"), x).otherwise(F.trim(F.regexp_replace(x, f"[{BLANKS.replace(' ', '')}][{BLANKS}]*| [{BLANKS}]+", " ")))


def term_key(c: Column) -> Column:
    """Squeezed and folded; of ASCII without white space that is the lower case."""
    plain = lambda x: (F.octet_length(x) == F.char_length(x)) & ~x.rlike("[\t-\r ]")
    return bind(c, lambda x: F.when(plain(x), F.lower(x)).otherwise(fold(squeeze(x))))


def compact(c: Column) -> Column:
    """Letters of a term without spaces and hyphens; null if others than a-z are in it or it is shorter than 3."""
    c = F.regexp_replace(fold(c), f"(?U)[\\s{DASHES}]+", "")
    return bind(c, lambda x: F.when(x.rlike("^[a-z]{3,}$"), x))


# Words that are no plurals, and plurals of their own.
INVARIANT = ("news", "series", "species", "diabetes", "physics", "economics", "mathematics", "statistics", "ethics", "politics", "genetics", "mechanics", "dynamics", "bias", "status", "virus", "aids", "sars", "mers")
IRREGULAR = {"analyses": "analysis", "diagnoses": "diagnosis", "theses": "thesis", "hypotheses": "hypothesis", "crises": "crisis", "matrices": "matrix", "indices": "index", "children": "child", "women": "woman", "men": "man", "mice": "mouse", "geese": "goose", "teeth": "tooth", "feet": "foot", "buses": "bus", "gases": "gas", "viruses": "virus"}
IRREGULAR_ENDINGS = ("analyses", "diagnoses", "theses", "hypotheses", "crises", "matrices", "indices", "viruses")


def singular(c: Column) -> Column:
    """The singular of a compact English term, by rule and list."""
    return bind(c, _singular)


def _singular(c: Column) -> Column:
    words = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    rule = F.when(c.isin(*INVARIANT), c).when(words[c].isNotNull(), words[c])
    for ending in IRREGULAR_ENDINGS:
        rule = rule.when(c.endswith(ending), F.regexp_replace(c, f"{ending}$", IRREGULAR[ending]))
    rule = rule.when(c.rlike("^.*[^aeiou]ies$") & (F.length(c) > 4), F.regexp_replace(c, "ies$", "y"))
    rule = rule.when(c.rlike("(ches|shes|sses|xes|zes)$") & (F.length(c) > 4), F.regexp_replace(c, "es$", ""))
    return rule.when(c.rlike("s$") & ~c.rlike("(ss|us|is|as)$") & (F.length(c) > 3), F.regexp_replace(c, "s$", "")).otherwise(c)


def has_dash(c: Column) -> Column:
    return c.rlike(f"[{DASHES}]")


def sentence_case(c: Column) -> Column:
    """Hyphens between letters as spaces, none at the ends, capital first letter; hyphens beside digits stay."""
    c = F.regexp_replace(c, f"(?<=\\p{{L}})[{DASHES}]+(?=\\p{{L}})", " ")
    c = squeeze(F.regexp_replace(c, f"^[{DASHES}]+|[{DASHES}]+$", ""))
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def canonical(target: Column, variants: Column) -> Column:
    """The most readable spelling among a target and its equal variants, in sentence case."""
    root = compact(target)
    forms = F.filter(F.transform(F.concat(F.array(target), variants), strip), lambda v: (v != "") & (compact(v) == root))
    ranked = F.array_sort(F.transform(forms, lambda v: F.struct(has_dash(v).alias("a"), (~v.contains(" ")).alias("b"), F.length(v).alias("c"), fold(v).alias("d"), v.alias("v"))))
    return sentence_case(F.when(root.isNotNull(), ranked[0]["v"]).otherwise(strip(target)))


def scope_changes(a: Column, b: Column) -> Column:
    """Whether one keyword is likely broader than the other, which a merge must not hide."""
    return bind(F.struct(a.alias("a"), b.alias("b"), compact(a).alias("x"), compact(b).alias("y")), lambda z: _scope_changes(z["a"], z["b"], z["x"], z["y"]))


def _scope_changes(a: Column, b: Column, x: Column, y: Column) -> Column:
    words = lambda c: F.array_distinct(F.regexp_extract_all(fold(c), F.lit(r"(?U)(\w+)"), F.lit(1)))
    p, q = words(a), words(b)
    inside = lambda s, t: (F.size(F.array_except(s, t)) == 0) & (F.size(s) < F.size(t))
    tokens = (F.size(p) > 0) & (F.size(q) > 0) & (inside(p, q) | inside(q, p))
    both = x.isNotNull() & y.isNotNull()
    return F.when(both & (singular(x) == singular(y)), False).when(both & (x.contains(y) | y.contains(x)), True).otherwise(tokens)


def split_terms(c: Column) -> Column:
    for mark in "；\r\n":
        c = F.replace(c, F.lit(mark), F.lit(";"))
    return F.filter(F.transform(F.split(c, ";"), strip), lambda x: x != "")


def clean_term(c: Column) -> Column:
    return bind(c, cleaned)


def cleaned(x: Column) -> Column:
    """`clean_term` of what is at hand already."""
    return F.trim(squeezed(x), F.lit(" ,，.。"))


def distinct_terms(raw: Column, normal=None) -> Column:
    """Terms of all values, split at semicolons and cleaned; of equal folded ones the first."""
    parts = F.filter(F.transform(F.flatten(F.transform(raw, lambda v: F.split(F.replace(v, F.lit("；"), F.lit(";")), ";"))), cleaned), lambda x: x != "")
    return first_of_each(F.transform(parts, normal) if normal else parts)["v"]


def first_of_each(terms: Column) -> Column:
    """Structs (k: folded, v: term) of the first term of each folded form, in order."""
    return first_of_each_key(F.transform(terms, lambda x: F.struct(folded(x).alias("k"), x.alias("v"))), "k")


def first_of_each_key(items: Column, key: str) -> Column:
    """The first struct of each value of a field, in order; items and keys are computed once, not once for each item."""
    first = lambda own, keys: F.filter(own, lambda p, i: F.array_position(keys, p[key]) == i + 1)
    return bind(items, lambda own: bind(own[key], lambda keys: F.when(F.size(F.array_distinct(keys)) == F.size(keys), own).otherwise(first(own, keys))))


def normal_doi(c: Column) -> Column:
    c = fold(strip(c))
    for prefix in (r"https://doi\.org/", r"http://doi\.org/", "doi:", "doi "):
        c = F.regexp_replace(c, f"^{prefix}", "")
    return F.regexp_replace(strip(c), r"\.+$", "")


def _mapped(s, change):
    """`change` of every text of a series, of a text that repeats once."""
    known: dict[str, str] = {}
    return s.map(lambda x: None if x is None else known[x] if x in known else known.setdefault(x, change(x)))


@F.pandas_udf(StringType())
def _alnum(s):
    import unicodedata

    return _mapped(s, lambda x: "".join(filter(str.isalnum, unicodedata.normalize("NFKC", x).casefold())))


@F.pandas_udf(StringType())
def _compatible(s):
    import unicodedata

    return _mapped(s, lambda x: unicodedata.normalize("NFKC", x).casefold())


def _plain_or(c: Column, plain, other) -> Column:
    """`plain(c)` in the JVM for texts of ASCII alone, for which `other` (an Arrow function) gets a null instead."""
    ascii_ = lambda x: x.rlike(r"^[\x00-\x7F]*$")
    return F.coalesce(bind(c, lambda x: F.when(ascii_(x), plain(x))), other(bind(c, lambda x: F.when(~ascii_(x), x))))


def alnum_key(c: Column, exact: bool = True) -> Column:
    """Letters and digits of a text in compatibility form, case folded: exact, by an Arrow function for texts beyond ASCII, else natively."""
    native = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    return _plain_or(c, lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]+", ""), _alnum) if exact else native


def surname(exact: bool = True) -> Column:
    first = F.coalesce(F.get(values("AU"), 0), F.lit(""))
    return alnum_key(F.substring_index(F.substring_index(first, ",", 1), " ", 1), exact)


def title_sort_key(c: Column) -> Column:
    """A title for sorting: compatibility form and full case folding, without signs at the beginning."""
    return F.regexp_replace(_plain_or(c, F.lower, _compatible), r"^[^\p{L}\p{N}]+", "")


def reference_key(c: Column) -> Column:
    doi = F.regexp_extract(c, r"(?i)\bDOI\s*[: ]\s*(10\.[0-9]{4,9}/\S+)", 1)
    return F.when(doi != "", F.concat(F.lit("doi:"), fold(F.regexp_replace(doi, "[.,; ]+$", "")))).otherwise(F.concat(F.lit("ref:"), fold(squeeze(c))))


# Fixed values (in the function below): names of countries in rankings.
def country_name(c: Column) -> Column:
    """The country's name in rankings."""
    key = F.trim(F.regexp_replace(fold(c), "[^a-z]+", " "))
    return (
        F.when(c.rlike(r"(?i)\bUSA$"), "USA")
        .when((c == "中国") | key.isin("china", "peoples r china", "people s r china", "people s republic of china", "pr china", "p r china"), "China")
        .when(key.isin("usa", "u s a", "us", "united states", "united states of america"), "USA")
        .when(key.isin("uk", "u k", "united kingdom", "england", "scotland", "wales", "northern ireland"), "United Kingdom")
        .otherwise(c)
    )


# countries' names in the vocabulary, which differ from those in rankings.
COUNTRY_ALIASES = {"pr china": "China", "peoples r china": "China", "people's republic of china": "China", "中国": "China", "usa": "United States", "us": "United States", "united states of america": "United States", "uk": "United Kingdom"}
ABBREVIATIONS = {"univ": "university", "hosp": "hospital", "dept": "department"}


def identity_key(kind: str, c: Column) -> Column:
    """What spellings of one country, organisation, author or journal share."""
    key = F.regexp_replace(term_key(c), "&", " and ")
    if kind == "countries":
        aliases = F.create_map(*[F.lit(x) for pair in COUNTRY_ALIASES.items() for x in pair])
        return term_key(F.coalesce(aliases[F.regexp_replace(key, "^[ .]+|[ .]+$", "")], c))
    if kind == "organizations":
        for short, long in ABBREVIATIONS.items():
            key = F.regexp_replace(key, rf"(?U)\b{short}\b\.?(?=\s|$)", long)
    return F.regexp_replace(key, r"(?U)[\s.,\-]+", "")


def address_groups(c: Column) -> Column:
    """The author groups of one address value."""
    return F.split(c, r"\s+(?=\[[^\]]+\]\s)")


def trailing_countries(c: Column) -> Column:
    groups = F.filter(address_groups(c), lambda g: g.contains(","))
    names = F.transform(groups, lambda g: F.regexp_replace(strip(F.element_at(F.split(g, ","), -1)), "^[ .]+|[ .]+$", ""))
    return F.filter(names, lambda n: (n != "") & ~n.contains("@") & (F.length(n) <= 60))


def integer_or_text(c: Column) -> Column:
    """A value as (number, text): the number if it is a whole one that a long holds, else the text. One of both is null."""
    number = F.when(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(c).try_cast("long"))
    return F.struct(number.alias("number"), F.when(number.isNull(), c).alias("text"))


def string_list(c: Column) -> Column:
    """What an answer gives as a list: a JSON array's texts, a plain text as the only one; stripped, without blank ones."""
    listed = F.from_json(c, "array<string>")
    own = F.when(F.ltrim(c).startswith("[") & listed.isNotNull(), listed).when(c.isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    return F.filter(F.transform(own, strip), lambda x: x != "")


def spreadsheet_safe(c: Column) -> Column:
    """Without control characters, at most 32,700 characters, and no formula."""
    c = F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")
    c = F.when(F.length(c) > 32700, F.concat(F.substring(c, 1, 32680), F.lit("…（内容过长，已截断）"))).otherwise(c)
    return F.when(c.rlike("^[=+\\-@]"), F.concat(F.lit("'"), c)).otherwise(c)
