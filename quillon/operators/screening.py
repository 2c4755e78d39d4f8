"""Two-stage relevance screening: policies as column expressions, caching as a join, scoring by an injected client."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

# The policy and its thresholds, both inclusive.
LEAST_CONFIDENCE, LEAST_IRRELEVANT = 0.60, 0.75
CONSERVATIVE_NOTE = "below the thresholds for exclusion: kept as relevant"
DECISIONS = ("relevant", "irrelevant", "uncertain")
STAGE_TWO_TASKS = 8
RESULT = "record_id string, decision string, confidence double, reason string, missing array<string>, error string"


def cache_key(version: str, model: str, policy: str, query: str, payload: Column) -> Column:
    """Hash of all that a result depends on; the record's id is no part of it."""
    return F.sha2(F.to_json(F.struct(F.lit(model).alias("model"), payload.alias("payload"), F.lit(policy).alias("policy"), F.lit(query.strip()).alias("query"), F.lit(version).alias("version"))), 256)


def checked_probability(p: Column) -> Column:
    return F.when((p >= 0) & (p <= 1), p).otherwise(F.raise_error(F.concat(F.lit("not a probability: "), F.coalesce(p.cast("string"), F.lit("null")))).cast("double"))


def stage_one_decision(choice: Column, confidence: Column, irrelevant: Column) -> Column:
    """An exclusion stands only with enough confidence and probability; else the record stays as relevant."""
    weak = (choice == "irrelevant") & ((confidence < LEAST_CONFIDENCE) | (irrelevant < LEAST_IRRELEVANT))
    return F.when(weak, "relevant").otherwise(choice)


def with_stage_one(df: DataFrame, choice: str = "choice", confidence: str = "confidence", irrelevant: str = "p_irrelevant") -> DataFrame:
    """Adds decision and missing (notes) to raw stage-one answers."""
    c = F.col(choice)
    decision = stage_one_decision(c, F.col(confidence), F.col(irrelevant))
    note = F.when(c == "uncertain", F.array(F.lit("evidence is missing or contradictory"))).when((c == "irrelevant") & (decision == "relevant"), F.array(F.lit(CONSERVATIVE_NOTE))).otherwise(F.array().cast("array<string>"))
    return df.withColumn("decision", decision).withColumn("missing", note)


# What stage two may call its decisions.
STAGE_TWO_NAMES = {"relevant": "relevant", "irrelevant": "irrelevant", "uncertain": "uncertain", "相关": "relevant", "存疑": "uncertain", "不相关": "irrelevant", "include": "relevant", "exclude": "irrelevant"}
#: Lists of texts in an answer: whatever isn't a list is a list of one.
STAGE_TWO_LISTS = {"matched_criteria": "matched", "evidence": "evidence", "missing_information": "missing"}


def parse_stage_two(df: DataFrame, answer: str) -> DataFrame:
    """decision, confidence (kept in 0 to 1), reason, exclusion_reason, matched, evidence, missing and error from JSON text.

    Text that is no JSON object, a decision of another name and a confidence that is no number are errors.
    """
    names = F.create_map(*[F.lit(x) for pair in STAGE_TWO_NAMES.items() for x in pair])
    j = F.from_json(answer, "map<string, string>")
    decision = names[F.lower(F.trim(j["decision"]))]
    given = F.coalesce(j["confidence"], F.lit("0"))
    listed = {name: t.string_list(j[key]) for key, name in STAGE_TWO_LISTS.items()}
    found = df.withColumn("_given", given).withColumn("_confidence", F.expr("try_cast(_given as double)"))
    good = decision.isNotNull() & F.col("_confidence").isNotNull()
    none = F.array().cast("array<string>")
    found = found.withColumn("decision", F.when(good, decision).otherwise("uncertain")).withColumn("confidence", F.when(good, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_confidence")))).otherwise(0.0))
    found = found.withColumn("reason", F.coalesce(j["reason"], F.lit(""))).withColumn("exclusion_reason", F.coalesce(j["exclusion_reason"], F.lit("")))
    for name, own in listed.items():
        found = found.withColumn(name, F.when(good, own).otherwise(none))
    return found.withColumn("error", F.when(good, "").otherwise("unreadable answer")).drop("_given", "_confidence")


def needs_stage_two() -> Column:
    return (F.col("decision") == "uncertain") | (F.coalesce("error", F.lit("")) != "") | F.array_contains("missing", CONSERVATIVE_NOTE)


def request_plan(attempt: int) -> dict:
    """What the attempts on one record send: a short answer, then a longer one, then no abstract."""
    return ({"tokens": 1200, "abstract": True}, {"tokens": 4000, "abstract": True}, {"tokens": 4000, "abstract": False})[attempt]


#: Answers of a server after which asking again makes sense.
RETRIED = frozenset({408, 409, 425, 429, 500, 502, 503, 504})


class AnswerError(Exception):
    """A client's failure: an HTTP status, if there is one, and whether the answer was cut off."""

    def __init__(self, message: str, status: int | None = None, truncated: bool = False):
        super().__init__(message)
        self.status, self.truncated = status, truncated

    def retried(self) -> bool:
        return self.truncated or self.status is None or self.status in RETRIED


def back_off(attempt: int, first: float = 1.0, most: float = 30.0) -> float:
    """Seconds to wait before attempt number `attempt` (from 1): doubled each time, up to a bound."""
    return min(most, first * 2 ** (attempt - 1))


def classify(df: DataFrame, client: Callable[[dict, dict], dict], tasks: int | None = None, attempts: int = 3, wait: float = 1.0, at_once: int | None = None) -> DataFrame:
    """Asks `client(payload, plan)` for every row of (record_id, payload ...), `at_once` rows at a time over all tasks.

    Each of `tasks` partitions has a pool of threads for its share of `at_once`; the shares add up to it, so that many
    requests are under way and never more, if all tasks run. With `at_once` alone, one task serves up to eight of them;
    without it each task asks one request after the other.

    A failure that is worth another attempt waits longer each time; a cut-off answer (`AnswerError`) asks by the next plan,
    other failures by the same; a status outside RETRIED ends it. A row that fails for good is uncertain, confidence 0,
    with the error.
    """
    if at_once is not None:
        if at_once < 1:
            raise ValueError("at least one request at a time is needed")
        tasks = min(at_once, tasks or -(-at_once // STAGE_TWO_TASKS))
    if tasks is not None:
        df = df.repartition(tasks)

    def ask(row: dict) -> tuple:
        error, plan = "", 0
        for k in range(attempts):
            if k:
                time.sleep(back_off(k, wait))
            try:
                a = client(row, request_plan(min(plan, 2)))
                return row["record_id"], a["decision"], float(a["confidence"]), a.get("reason", ""), list(a.get("missing", [])), ""
            except AnswerError as e:
                error, plan = str(e) or type(e).__name__, plan + e.truncated
                if not e.retried():
                    break
            except Exception as e:
                error, plan = str(e) or type(e).__name__, plan + 1
        return row["record_id"], "uncertain", 0.0, "", [], error

    def run(batches):
        share = 1
        if at_once is not None:
            share = at_once // tasks + (TaskContext.get().partitionId() < at_once % tasks)
        with ThreadPoolExecutor(share) as pool:
            for batch in batches:
                yield pd.DataFrame(list(pool.map(ask, batch.to_dict("records"))), columns=["record_id", "decision", "confidence", "reason", "missing", "error"])

    return df.mapInPandas(run, RESULT)


def classify_stage_two(df: DataFrame, client: Callable[[dict, dict], dict], **options) -> DataFrame:
    """`classify` with the cap of stage two, eight requests at a time unless another is given."""
    return classify(df, client, **{"at_once": STAGE_TWO_TASKS, **options})


def split_by_cache(df: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of rows (record_id, cache_key ...): hits carry the current record's id."""
    hits = df.select("record_id", "cache_key").join(cache.drop("record_id"), "cache_key").withColumn("cached", F.lit(True))
    return hits, df.join(cache, "cache_key", "left_anti")


def updated_cache(cache: DataFrame, results: DataFrame) -> DataFrame:
    """The cache with new results instead of old ones of their key; failures are not kept."""
    new = results.where(F.coalesce("error", F.lit("")) == "").select(*cache.columns).dropDuplicates(["cache_key"])
    return cache.join(new, "cache_key", "left_anti").select(*cache.columns).unionByName(new)


def resolve(one: DataFrame, two: DataFrame) -> DataFrame:
    """Stage two decides where it was asked and succeeded; where it failed, stage one stays with a note."""
    b = two.select("record_id", *[F.col(c).alias(f"b_{c}") for c in ("decision", "confidence", "reason", "missing", "error")])
    rows = one.join(b, "record_id", "left")
    asked, good = F.col("b_decision").isNotNull(), F.col("b_decision").isNotNull() & (F.coalesce("b_error", F.lit("")) == "")
    notes = lambda *more: F.array_distinct(F.filter(F.concat("missing", *more), lambda x: F.trim(x) != ""))
    first_failed = F.coalesce("error", F.lit("")) != ""
    none = F.array().cast("array<string>")
    missing = F.when(good, notes("b_missing", F.when(first_failed, F.array(F.lit("stage one failed; stage two decided"))).otherwise(none))).when(asked, notes(F.array(F.lit("stage two failed; stage one stays")))).otherwise(F.col("missing"))
    error = F.when(good, "").when(asked, F.concat_ws("；", F.when(first_failed, F.col("error")), "b_error")).otherwise(F.col("error"))
    return rows.select(
        "record_id", F.when(good, F.col("b_decision")).otherwise(F.col("decision")).alias("decision"), F.when(good, F.col("b_confidence")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(asked, F.concat_ws(" ", "reason", "b_reason")).otherwise(F.col("reason")).alias("reason"), missing.alias("missing"), error.alias("error"), asked.alias("reviewed"),
    )


def year_rule(df: DataFrame, start: int | None, end: int | None, year: str = "py") -> DataFrame:
    """Rows outside the years as decided ones: irrelevant, confidence 1, without asking anybody."""
    from .filters import partition_by_year

    out = partition_by_year(df, start, end, year).where("year_status = 'excluded'")
    return out.select("record_id", F.lit("irrelevant").alias("decision"), F.lit(1.0).alias("confidence"), F.concat(F.lit("year "), F.col(year)).alias("reason"), F.array().cast("array<string>").alias("missing"), F.lit("").alias("error"))


def review(results: DataFrame, ticked: DataFrame) -> DataFrame:
    """Adds final_decision and human_modified: of uncertain rows, ticked ones are irrelevant, the others relevant."""
    rows = results.join(ticked.select("record_id", F.lit(True).alias("_t")), "record_id", "left")
    unsure = F.col("decision") == "uncertain"
    return rows.withColumn("final_decision", F.when(unsure & F.col("_t").isNotNull(), "irrelevant").when(unsure, "relevant").otherwise(F.col("decision"))).withColumn("human_modified", unsure).drop("_t")


def restored_draft(known: DataFrame, ticked: DataFrame, results: DataFrame) -> DataFrame:
    """The ticked record_ids of a draft that was made for the rows `known`, as far as they are still uncertain.

    A draft of other rows than those that are uncertain now is void: then none is ticked.
    """
    unsure = results.where("decision = 'uncertain'").select("record_id").distinct()
    asked = known.select("record_id").distinct()
    differ = asked.join(unsure, "record_id", "left_anti").unionByName(unsure.join(asked, "record_id", "left_anti"))
    void = differ.agg((F.count("*") > 0).alias("_void"))  # one row
    return ticked.select("record_id").distinct().join(unsure, "record_id", "left_semi").join(F.broadcast(void)).where("not _void").drop("_void")


def sorted_review(results: DataFrame, by: str = "confidence", descending: bool = True) -> DataFrame:
    """Rows as a table shows them: numbers by value, others folded, nulls last; ids decide ties."""
    kind = results.schema[by].dataType.simpleString()
    key = t.fold(F.col(by)) if kind == "string" else F.col(by)
    return results.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "record_id")


def decision_counts(results: DataFrame, final: str = "final_decision") -> DataFrame:
    counts = [F.count_if(F.col(final) == d).alias(d) for d in DECISIONS]
    return results.agg(F.count("*").alias("total"), *counts, F.count_if(F.col("decision") == "uncertain").alias("initially_uncertain"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("failures"))


def complete(records: DataFrame, results: DataFrame) -> DataFrame:
    """Records with their results; an error if one has none."""
    rows = records.join(results, "record_id", "left")
    return rows.withColumn("decision", F.coalesce("decision", F.raise_error(F.concat(F.lit("no result for "), "record_id")).cast("string")))
