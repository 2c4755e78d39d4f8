"""Duplicate candidates, decisions and their application; all matching is exact after normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.numbering import numbered
from ..session import checkpoint_folder

PRESETS = {"quick": ("identifiers",), "journal": ("title", "year", "authors", "source"), "strict": ("title", "year", "authors", "abstract"), "loose": ("title", "year")}


def profile(records: DataFrame, exact: bool = True) -> DataFrame:
    """What the operators here need of records: keys, identifiers, completeness, DOI."""
    parts = {"title": t.text("TI"), "year": t.text("PY"), "authors": t.either(t.text("AU"), t.text("AF")), "source": t.text("SO"), "abstract": t.text("AB")}
    doi, ut = t.normal_doi(t.text("DI")), t.fold(t.strip(t.text("UT")))
    ids = F.array_compact(F.array(F.when(doi != "", F.concat(F.lit("doi:"), doi)), F.when(ut != "", F.concat(F.lit("ut:"), ut))))
    columns = ["record_key", "ord", "source_kind", "source_file", t.record_id().alias("record_id"), t.text("TI").alias("title"), t.text("PY").alias("year"), t.text("DI").alias("di"), doi.alias("doi"), t.text("UT").alias("ut"), ids.alias("identifiers"), t.completeness().alias("completeness"), t.surname(exact).alias("first_author")]
    return records.select(*columns, *[t.alnum_key(c, exact).alias(f"n_{n}") for n, c in parts.items()])


def match_key(preset: str):
    """The exact key of a preset as a struct, null if a part is empty; of quick, the sorted identifiers."""
    if preset not in PRESETS:
        raise ValueError(f"unknown preset: {preset}")
    if preset == "quick":
        return F.array_sort("identifiers")
    parts = [F.col(f"n_{n}") for n in PRESETS[preset]]
    filled = parts[0] != ""
    for p in parts[1:]:
        filled &= p != ""
    return F.when(filled, F.struct(*parts))


def connected(pairs: DataFrame, node: str, key: str) -> DataFrame:
    """(node, component): nodes that share keys, directly or through others; the least node names the component.

    Labels go from nodes to keys and back; each round both are cut short through the label's own label, so the rounds
    grow with the logarithm of a chain. Each round is a checkpoint, not lineage.
    """
    checkpoint_folder(pairs.sparkSession)
    links = pairs.select(F.col(node).alias("n"), F.col(key).alias("k")).distinct().checkpoint()
    labels = links.groupBy("n").agg(F.min("n").alias("c")).checkpoint()
    while True:
        by_key = links.join(labels, "n").groupBy("k").agg(F.min("c").alias("kc"))
        low = links.join(by_key, "k").groupBy("n").agg(F.min("kc").alias("low"))
        hook = labels.join(low, "n").groupBy(F.col("c").alias("n")).agg(F.min("low").alias("hook"))
        step = labels.join(low, "n").join(hook, "n", "left").select("n", "c", F.least("low", F.coalesce("hook", "low")).alias("new"))
        tops = step.select(F.col("n").alias("top"), F.col("new").alias("top_new"))
        step = step.join(tops, step["new"] == tops["top"], "left").select("n", "c", F.least("new", F.coalesce("top_new", "new")).alias("new")).checkpoint()
        labels = step.select("n", F.col("new").alias("c"))
        if step.where("new <> c").isEmpty():
            return labels.select(F.col("n").alias(node), F.col("c").alias("component"))


def preference():
    """Order within a group: Web of Science first, then the most complete, then title and key."""
    return F.struct((F.lower("source_kind") != "wos").alias("other"), (-F.col("completeness")).alias("less"), t.fold(F.col("title")).alias("title"), F.col("record_key").alias("record_key"))


def members(profiles: DataFrame, preset: str) -> DataFrame:
    """Groups of two or more as rows, one a member: group_id, record_key, primary (the preferred member), doi_conflict, size, status, sort_title.

    What a group needs is a minimum, a count and two extremes, so groups of any size are aggregated before the shuffle; its
    members come back by a join that adaptive execution splits where a key is hot. No group is ever an array.
    """
    if preset == "quick":
        pairs = profiles.select("record_key", F.explode("identifiers").alias("identifier"))
        keyed = profiles.join(connected(pairs, "record_key", "identifier"), "record_key").withColumn("group_key", F.col("component"))
    else:
        # whole abstracts are no keys to shuffle; parts are letters and digits, so the bar tells them apart
        digest = F.sha2(F.concat_ws("|", *[F.col(f"n_{n}") for n in PRESETS[preset]]).cast("binary"), 256)
        keyed = profiles.withColumn("group_key", F.when(match_key(preset).isNotNull(), digest)).where("group_key is not null")
    known = F.when(F.col("di") != "", F.col("doi"))
    groups = keyed.groupBy("group_key").agg(F.min(preference()).alias("first"), (F.min(known) != F.max(known)).alias("doi_conflict"), F.count("*").alias("size")).where("size > 1")
    first = F.col("first.record_key")
    groups = groups.select("group_key", F.sha1(first).alias("group_id"), first.alias("primary"), F.coalesce("doi_conflict", F.lit(False)).alias("doi_conflict"), "size", F.lit("pending").alias("status"), F.col("first.title").alias("sort_title"))
    return keyed.select("group_key", "record_key").join(groups, "group_key").drop("group_key")


def candidates(profiles: DataFrame, preset: str) -> DataFrame:
    """The groups of `members`, one a row with its members (preferred first) as an array: for showing, not for hot keys."""
    rows = members(profiles, preset).join(profiles.select("record_key", preference().alias("_order")), "record_key")
    own = F.transform(F.array_sort(F.collect_list("_order")), lambda x: x["record_key"])
    return rows.groupBy("group_id", "primary", "doi_conflict", "size", "status", "sort_title").agg(own.alias("record_keys")).select("group_id", "record_keys", "primary", "doi_conflict", "size", "status", "sort_title")


def as_members(groups: DataFrame) -> DataFrame:
    """Rows of members, whether groups come as such or with arrays."""
    return groups.withColumn("record_key", F.explode("record_keys")).drop("record_keys") if "record_keys" in groups.columns else groups


def _one_each(groups: DataFrame) -> DataFrame:
    """One row a group."""
    return groups if "record_keys" in groups.columns else groups.where("record_key = primary")


def run_statistics(groups: DataFrame) -> DataFrame:
    return _one_each(groups).agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).cast("long").alias("duplicates"), F.count_if("doi_conflict").alias("conflicts"))


def auto_review(groups: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Accepts groups without conflicting DOIs, ignores the others; a member that isn't among `records` is an error."""
    if records is not None:
        missing = as_members(groups).select("group_id", "record_key").join(records.select("record_key"), "record_key", "left_anti").first()
        if missing is not None:
            raise ValueError(f"{missing.record_key} of group {missing.group_id} isn't among the records")
    return groups.withColumn("status", F.when(F.col("status") != "pending", F.col("status")).when(F.col("doi_conflict"), "ignored").otherwise("deduped"))


def decide(groups: DataFrame, group_id: str, status: str, primary: str | None = None) -> DataFrame:
    """Sets one group's status, and its primary if given."""
    if status not in ("pending", "deduped", "ignored"):
        raise ValueError(f"unknown status: {status}")
    own = F.col("group_id") == group_id
    if primary is not None:
        if as_members(groups.where(own)).where(F.col("record_key") == primary).isEmpty():
            raise ValueError("the primary isn't in the group")
        groups = groups.withColumn("primary", F.when(own, primary).otherwise(F.col("primary")))
    return groups.withColumn("status", F.when(own, status).otherwise(F.col("status")))


def apply_review(groups: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """record_key of all that accepted groups exclude, with those excluded before; refuses pending groups."""
    if not groups.where("status = 'pending'").isEmpty():
        raise ValueError("groups are still pending")
    rows = as_members(groups)
    if not rows.groupBy("group_id", "primary").agg(F.max(F.col("record_key") == F.col("primary")).alias("has")).where("not has").isEmpty():
        raise ValueError("a primary isn't in its group")
    own = rows.where("status = 'deduped' and record_key <> primary").select("record_key")
    return (own if excluded is None else own.union(excluded.select("record_key"))).distinct()


def duplicate_log(groups: DataFrame, profiles: DataFrame, reason: str) -> DataFrame:
    """Every excluded record with the one kept for it."""
    merged = as_members(groups).where("status = 'deduped' and record_key <> primary").select("record_key", "primary")
    gone = profiles.select("record_key", F.col("record_id").alias("duplicate_record_id"), F.col("source_file").alias("duplicate_source"))
    kept = profiles.select(F.col("record_key").alias("primary"), F.col("record_id").alias("kept_record_id"), F.col("source_file").alias("kept_source"))
    return merged.join(gone, "record_key").join(kept, "primary").select("duplicate_record_id", "kept_record_id", F.lit(reason).alias("reason"), "duplicate_source", "kept_source")


def doi_conflict_rows(profiles: DataFrame) -> DataFrame:
    """Records of titles of a year with more than one DOI: title (the first by ord), year, ord, record_id, doi."""
    own = profiles.where("n_title <> '' and year <> '' and doi <> ''")
    mixed = own.groupBy("n_title", "year").agg(F.min_by("title", "ord").alias("title"), F.min("doi").alias("_least"), F.max("doi").alias("_most")).where("_least <> _most")
    return own.select("n_title", "year", "ord", "record_id", "doi").join(mixed.select("n_title", "year", "title"), ["n_title", "year"])


def doi_conflicts(profiles: DataFrame) -> DataFrame:
    """Those rows by title and year with their record ids and DOIs as arrays: for a report, not for hot titles."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ord", "record_id"))), lambda x: x["record_id"])
    return doi_conflict_rows(profiles).groupBy("n_title", "year", "title").agg(ids.alias("record_ids"), F.array_sort(F.collect_set("doi")).alias("dois")).select("title", "year", "record_ids", "dois")


#: What a change of terms of a kind changes in a profile; keywords are in no key.
KIND_PARTS = {"authors": "authors", "journals": "source"}


def needs_new_review(before: DataFrame, after: DataFrame, kind: str | None = None, preset: str | None = None) -> bool:
    """Whether candidate sets appear that no ignored group of the earlier review covers.

    A change of a `kind` of terms that the `preset` doesn't look at can't make any, so nothing is compared then.
    """
    if kind is not None and preset is not None and KIND_PARTS.get(kind) not in PRESETS[preset]:
        return False
    sized = lambda g, name: as_members(g).select("record_key", F.col("group_id").alias(name), F.count("*").over(Window.partitionBy("group_id")).alias(f"{name}_size"))
    new, old = sized(after, "new"), sized(before.where("status = 'ignored'"), "old")
    both = new.join(old, "record_key").groupBy("new", "new_size", "old", "old_size").count()
    same = both.where("count = new_size and count = old_size").select("new")
    return not new.select("new").distinct().join(same, "new", "left_anti").isEmpty()


#: Records (by number) in one block of the running best of a slot.
BLOCK = 1 << 16


def _best_before(events: DataFrame) -> DataFrame:
    """Adds `best` to events (slot, pos, asks, own): the greatest `own` of the slot's records with a lesser pos.

    Blocks of records are scanned by themselves, then the blocks' maxima, so that a slot is never scanned by one task.
    """
    events = events.withColumn("block", F.floor(F.col("pos") / BLOCK))
    inside = Window.partitionBy("slot", "block").orderBy("pos", F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = events.groupBy("slot", "block").agg(F.max("own").alias("most"))
    before = F.max("most").over(Window.partitionBy("slot").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    joined = events.join(blocks.select("slot", "block", before.alias("earlier")), ["slot", "block"])
    return joined.withColumn("best", F.greatest(F.max("own").over(inside), "earlier")).drop("block", "earlier")


def _roots(parents: DataFrame) -> DataFrame:
    """(pos, slot): the record at which a chain of parents ends; each step doubles what a record looks ahead."""
    links = parents.select("pos", F.col("parent").alias("slot")).checkpoint()
    while True:
        ahead = links.select(F.col("pos").alias("_pos"), F.col("slot").alias("_slot"))
        step = links.join(ahead, links["slot"] == ahead["_pos"]).select("pos", "slot", "_slot").checkpoint()
        links = step.select("pos", F.col("_slot").alias("slot"))
        if step.where("slot <> _slot").isEmpty():
            return links


def legacy_dedupe(profiles: DataFrame) -> DataFrame:
    """The order-dependent dedupe: record_key, kept (null for survivors), reason, slot (a survivor's output position).

    In input order, a record joins the slot of its first known key (UT, DOI, title and year; the last only if DOI and first
    author don't differ from the slot's record) or opens one; a more complete record takes the slot over.

    A key belongs to the slot of the first record that has it, whatever happens later. So joins by UT and DOI are known at
    once, and those by title depend only on which record the slot has by then: the most complete of the members before.
    All decisions are made at once from the present guess of the others, until none changes. Each depends on earlier
    records alone, so this ends at the one outcome of the fold, after as many rounds as decisions hang on one another.
    """
    year = F.when((F.col("n_title") != "") & (F.col("year") != ""), F.concat("n_title", F.lit("|"), "year")).otherwise("")
    plain = profiles.select("record_key", "ord", F.col("completeness").cast("long").alias("completeness"), "doi", "first_author", F.upper(t.strip(F.col("ut"))).alias("ut_key"), year.alias("title_year"))
    checkpoint_folder(profiles.sparkSession)
    # written first, as a sort by ranges looks at its rows twice, and keys come from whole records
    rows = numbered(plain.checkpoint(), [F.col("ord"), F.col("record_key")], "pos")
    for name, key in (("by_ut", "ut_key"), ("by_doi", "doi"), ("by_title", "title_year")):
        first = rows.where(F.col(key) != "").groupBy(F.col(key).alias("_key")).agg(F.min("pos").alias(name))
        rows = rows.join(first, F.col(key) == F.col("_key"), "left").drop("_key")
    known = lambda c: F.when(F.col(c) < F.col("pos"), F.col(c))
    sure = F.coalesce(known("by_ut"), known("by_doi"))
    reason = F.when(F.col("by_ut") < F.col("pos"), "UT").when(F.col("by_doi") < F.col("pos"), "DOI").otherwise("TI+PY")
    own = F.struct("completeness", (-F.col("pos")).alias("_first"), F.coalesce("doi", F.lit("")).alias("doi"), F.coalesce("first_author", F.lit("")).alias("first_author"), "record_key")
    rows = rows.select("pos", "ord", sure.alias("sure"), F.when(sure.isNull(), known("by_title")).alias("maybe"), reason.alias("reason"), own.alias("own")).checkpoint()
    guess = rows.where("maybe is not null").select("pos", F.lit(True).alias("joins")).checkpoint()
    while True:
        parent = F.coalesce("sure", F.when(F.col("joins"), F.col("maybe")), "pos")
        roots = _roots(rows.join(guess, "pos", "left").withColumn("parent", parent))
        placed = rows.join(roots, "pos")
        asked = rows.where("maybe is not null").join(roots.select(F.col("pos").alias("maybe"), "slot"), "maybe")
        asks = asked.select("slot", "pos", F.lit(True).alias("asks"), F.lit(None).cast(rows.schema["own"].dataType).alias("own"), F.col("own").alias("mine"))
        events = placed.select("slot", "pos", F.lit(False).alias("asks"), "own", F.col("own").alias("mine")).unionByName(asks)
        differ = lambda c: (F.col(f"best.{c}") != "") & (F.col(f"mine.{c}") != "") & (F.col(f"best.{c}") != F.col(f"mine.{c}"))
        seen = _best_before(events).withColumn("fits", ~(differ("doi") | differ("first_author")))
        new = seen.where("asks").select("pos", F.col("fits").alias("new")).join(guess, "pos").checkpoint()
        if new.where("new <> joins").isEmpty():
            break
        guess = new.select("pos", F.col("new").alias("joins"))
    merged = seen.where("not asks and pos <> slot").join(rows.select("pos", "reason"), "pos")
    better = F.col("mine.completeness") > F.col("best.completeness")
    log = merged.select(F.when(better, F.col("best.record_key")).otherwise(F.col("mine.record_key")).alias("record_key"), F.when(better, F.col("mine.record_key")).otherwise(F.col("best.record_key")).alias("kept"), "reason", F.lit(None).cast("long").alias("slot"))
    left = placed.groupBy("slot").agg(F.max("own")["record_key"].alias("record_key")).join(rows.select(F.col("pos").alias("slot"), "ord"), "slot")
    return left.select("record_key", F.lit(None).cast("string").alias("kept"), F.lit(None).cast("string").alias("reason"), F.col("ord").cast("long").alias("slot")).unionByName(log)


def last_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
