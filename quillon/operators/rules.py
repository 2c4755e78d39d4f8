"""Rules of a vocabulary: what a specification states, checked and as a table.

A specification states pairs: that a term of a kind is written as a target, or (keywords only) that it is left out. The
three forms of a specification differ in how they nest pairs; `statements` flattens them, and all checks are made on the
flat list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

KINDS = ("countries", "organizations", "authors", "journals", "keywords")
TABLE = "kind string, key string, target string"
#: A term on one line, without the separators of lists.
_TERM = re.compile(r"\s*[^\s;；][^;；\r\n]*")


def folded(term: str) -> str:
    """The key of a term, as `text.term_key` has it."""
    return " ".join(map(str.casefold, term.split()))


def _is_term(x: object) -> bool:
    return isinstance(x, str) and _TERM.fullmatch(x) is not None


def _sections(spec: dict) -> list[tuple[object, list, list]]:
    """(kind, rules, exclusions) of a list of projects, of a single one, or of a table of kinds."""
    if "projects" in spec:
        projects = spec["projects"]
    elif "objectType" in spec:
        projects = [spec]
    else:
        projects = [{"objectType": kind, "rules": spec[kind]} for kind in KINDS if kind in spec]
    if not isinstance(projects, list) or not all(isinstance(p, dict) for p in projects):
        raise ValueError("projects are no list of objects")
    return [(p.get("objectType"), p.get("rules", []), p.get("exclude", p.get("exclusionKeys", []))) for p in projects]


def statements(spec: dict) -> Iterator[tuple[str, str, str | None]]:
    """(kind, term, target) of every pair, a target with itself included; a target of None leaves the term out."""
    sections = _sections(spec)
    kinds = [kind for kind, _, _ in sections]
    if not set(kinds) <= set(KINDS) or len(set(kinds)) < len(kinds):
        raise ValueError(f"kinds are some of {KINDS}, each once: {kinds}")
    for kind, rules, exclusions in sections:
        for rule in rules:
            target = rule.get("target", rule.get("primaryOutputText"))
            stated = rule["variants"] if rule.get("variants") is not None else [rule.get("primaryKey", target), *rule.get("secondaryKeys", [])]
            if not _is_term(target):
                raise ValueError(f"no valid target: {target!r}")
            if not isinstance(stated, list) or not all(isinstance(v, str) and v.strip() for v in stated):
                raise ValueError(f"variants of {target} are texts that aren't blank")
            yield from ((kind, term, target.strip()) for term in chain([target], stated))
        if kind == "keywords":
            yield from ((kind, term, None) for term in exclusions if term.strip())


def compile_rules(spec: dict) -> list[tuple[str, str, str | None]]:
    """(kind, key, target) of each key once; a key with two targets, or with one and an exclusion, is a ValueError."""
    targets: dict[tuple[str, str], set] = {}
    for kind, term, target in statements(spec):
        targets.setdefault((kind, folded(term)), set()).add(target)
    clashes = sorted(key for (_, key), own in targets.items() if len(own) > 1)
    if clashes:
        raise ValueError(f"more than one decision on {', '.join(clashes)}")
    return [(kind, key, own.pop()) for (kind, key), own in targets.items()]


def rules_table(spark, spec: dict) -> DataFrame:
    return spark.createDataFrame(compile_rules(spec), TABLE)


def checked_rules(pairs: DataFrame) -> DataFrame:
    """Rules from a table of pairs (kind, term, target), however many; a key with two decisions is an error of the query."""
    keyed = pairs.select("kind", t.term_key(F.col("term")).alias("key"), F.struct("target").alias("own"))
    found = keyed.groupBy("kind", "key").agg(F.min("own").alias("own"), F.max("own").alias("other"))
    clash = F.raise_error(F.concat(F.lit("more than one decision on "), "key")).cast("string")
    return found.select("kind", "key", F.when(F.col("own") == F.col("other"), F.col("own.target")).otherwise(clash).alias("target"))


def checked_pair(target: str, variant: str) -> tuple[str, str]:
    """The key of a variant and its target, stripped."""
    if not _is_term(target) or not _is_term(variant) or "\t" in target + variant:
        raise ValueError("a pair has two terms on one line, without semicolons")
    return folded(variant), target.strip()
