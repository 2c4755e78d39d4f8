"""Names within fields: countries, organisations and journals replaced where they stand, everything else untouched.

A field value is cut into author groups (an address has one for each bracket, a name is one), and each group offers the
places where a name of a kind can stand: an organisation up to the first comma, a country in the last comma parts. Places
are rows that are joined with the mapping by key, so a mapping may be of any size; only values with a hit are rebuilt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

#: Before the white space that parts two author groups of an address: nothing is lost in the cut.
_BETWEEN_GROUPS = r"(?U)(?<!\s)(?=\s+\[[^\]]+\]\s)"
#: A country stands in one of so many last parts of a group.
LAST_PARTS = 3


def author_groups(value: Column) -> Column:
    """The author groups of an address; joined, they are the address."""
    return F.split(value, _BETWEEN_GROUPS)


def _place(before: Column, part: Column, after: Column) -> list[Column]:
    """Structs of a place: the whole part without white space at its ends, then without a full stop too."""
    core = t.strip(part)
    lead, trail = F.regexp_extract(part, r"(?U)^(\s*)", 1), F.regexp_extract(part, r"(?U)\S(\s*)$", 1)
    whole = F.struct(F.concat(before, lead).alias("before"), core.alias("core"), F.concat(trail, after).alias("after"))
    stopped = F.struct(whole["before"].alias("before"), F.when(core.endswith("."), F.regexp_replace(core, r"\.$", "")).alias("core"), F.concat(F.lit("."), trail, after).alias("after"))
    return [whole, stopped]


def _country_places(group: Column) -> list[Column]:
    found = []
    for back in range(1, LAST_PARTS + 1):
        # the group without its last `back` parts, the part, and the rest
        before = F.regexp_extract(group, rf"(?s)^(.*?)[^,]*(?:,[^,]*){{{back - 1}}}$", 1)
        part = F.regexp_extract(group, rf"(?s)([^,]*)(?:,[^,]*){{{back - 1}}}$", 1)
        after = F.regexp_extract(group, rf"(?s)((?:,[^,]*){{{back - 1}}})$", 1)
        found += _place(before, part, after)
    return found


def _organization_places(group: Column) -> list[Column]:
    head = r"(?s)^(\s*\[[^\]]*\])?([^,]*)(.*)$"
    return _place(*(F.regexp_extract(group, head, k) for k in (1, 2, 3)))


def _places(kind: str, is_address: bool, group: Column) -> Column:
    """Array of (before, core, after), those that come first go first."""
    if not is_address:
        own = _place(F.lit(""), group, F.lit(""))
    else:
        own = {"countries": _country_places, "organizations": _organization_places}[kind](group)
    return F.array(*own)


def replace_names(df: DataFrame, row_key: str, fields: list[tuple[str, str, bool]], mapping: DataFrame, array_of) -> DataFrame:
    """(row_key, changes): for each row with a hit a map from field to its new array.

    `fields` has (field, kind, whether its values are addresses), `array_of(field)` gives its array column, and `mapping`
    (kind, key, target) has each key of a kind once. A null target or a null value changes nothing.
    """
    def cut(name: str, kind: str, is_address: bool) -> Column:
        groups = lambda v: author_groups(v) if is_address else F.array(v)
        rows = F.transform(array_of(name), lambda v, i: F.transform(groups(v), lambda g, j: F.struct(F.lit(name).alias("field"), F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), _places(kind, is_address, g).alias("places"))))
        return F.coalesce(F.flatten(rows), F.array().cast("array<struct<field:string,kind:string,i:int,j:int,places:array<struct<before:string,core:string,after:string>>>>"))

    groups = df.select(row_key, F.explode(F.concat(*[cut(*f) for f in fields])).alias("g")).select(row_key, "g.*")
    places = groups.select(row_key, "field", "kind", "i", "j", F.posexplode("places").alias("nth", "place")).where("place.core <> ''")
    known = mapping.where("target is not null").select("kind", F.col("key").alias("_key"), "target")
    hits = places.withColumn("_key", t.term_key(F.col("place.core"))).join(known, ["kind", "_key"]).where("target <> place.core")
    best = hits.groupBy(row_key, "field", "i", "j").agg(F.min_by(F.concat("place.before", "target", "place.after"), "nth").alias("new"))
    by_field = best.groupBy(row_key, "field").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("i", "j").alias("at"), "new"))).alias("new"))
    found = by_field.groupBy(row_key).agg(F.map_from_entries(F.collect_list(F.struct("field", "new"))).alias("_new"))

    def rebuilt(name: str, is_address: bool) -> Column:
        new = F.element_at("_new", name)
        groups = lambda v: author_groups(v) if is_address else F.array(v)
        value = lambda v, i: F.array_join(F.transform(groups(v), lambda g, j: F.coalesce(new[F.struct(i.alias("i"), j.alias("j"))], g)), "")
        return F.when(new.isNotNull(), F.transform(array_of(name), lambda v, i: F.when(v.isNotNull(), value(v, i))))

    entries = F.filter(F.array(*[F.struct(F.lit(name).alias("k"), rebuilt(name, is_address).alias("v")) for name, _, is_address in fields]), lambda e: e["v"].isNotNull())
    return df.join(found, row_key).select(row_key, F.map_from_entries(entries).alias("changes"))
