"""Operators on small record tables, with expected values from the survey's fixtures and brute force."""

import csv
import io
import itertools
import json
import os
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as t
from quillon.operators import dedupe, filters, metrics, network, screening, terms, vocabulary
from quillon.schema import records
from quillon.sources import bibliography, sinks
from quillon.workspace import Workspace

THREE = [
    {"TI": "One", "PY": "2024", "TC": "12", "AU": ["Li, A", "li, a", "Wang, B"], "SO": "J", "AB": "x", "C1": ["[Li, A] Peking Univ, Beijing, Peoples R China", "[Wang, B] Tsinghua Univ, Beijing 100084, Peoples R China."]},
    {"TI": "Two", "PY": "2023", "TC": "3", "AU": ["Li, A"], "SO": "j", "AB": "y", "C1": ["[Li, A] MIT, Boston, MA 02139 USA"]},
    {"TI": "Three", "AU": ["Li, A"], "C3": ["Peking Univ"], "C1": ["北京大学"]},
]


def papers(df):
    return df.select("record_key", "ord", "source_kind", t.publication_year().alias("py"), t.counted().alias("tc"), t.text("TI").alias("ti"))


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_trend_and_rankings(spark):
    df = records(spark, THREE)
    assert rows(metrics.annual_trend(papers(df))) == [(2023, 1, 3), (2024, 1, 12)]
    rank = lambda d, **k: [tuple(r) for r in metrics.rank_terms(terms.explode_terms(df, d, **k)).collect()]
    assert rank("authors") == [("Li, A", 3, 15), ("Wang, B", 1, 12)]
    assert rank("countries")[0] == ("China", 2, 12) and ("USA", 1, 3) in rank("countries")
    assert rank("institutions")[0] == ("Peking Univ", 2, 12)
    assert rank("journals") == [("J", 2, 15)]
    with pytest.raises(ValueError):
        terms.dimension_terms("nothing")


def test_cited_dimensions(spark):
    df = records(spark, [{"TI": "a", "CR": ["Smith J, 2001, NATURE, V1, P2, DOI 10.1234/ABC.", "Smith J, 2002, DOI 10.1/x", "[Anonymous], 1999, SCIENCE, V3"]}, {"TI": "b", "CR": ["smith j, 2001, NATURE,  V1, P2, DOI 10.1234/abc"]}])
    one = lambda c: [x for r in df.orderBy("ord").select(c.alias("c")).collect() for x in r.c]
    assert one(terms.dimension_terms("cited_reference_authors")) == ["Smith J", "Smith J", "[Anonymous]", "smith j"]
    assert one(terms.dimension_terms("cited_journals")) == ["NATURE", "SCIENCE", "NATURE"]
    assert [x.key for x in one(terms.cited_terms("cited_authors"))] == ["smith j", "smith j"]
    assert [x.key for x in one(terms.cited_terms("cited_articles"))] == ["doi:10.1234/abc", "ref:[anonymous], 1999, science, v3", "doi:10.1234/abc"]


def test_dimensions_are_counted_in_one_pass(spark, capsys):
    df = records(spark, [{"TI": "a", "DE": ["x; Y；y", " \u00a0z ."], "SO": "J", "CR": ["A, 2001, N, V1", "A, 2001, N, V1", "B"]}, {"TI": "b", "DE": "X", "CR": "a, 2001, n, v1"}, {"TI": "c"}])
    names = ["keywords", "journals", "authors", "cited_refs", "cited_journals", "cited_reference_authors"]
    by_hand = [(n, len(x), len({r.key for r in x}), len({r.record_key for r in x})) for n in names for x in [terms.explode_terms(df, n).collect()] if x]
    found = terms.dimension_counts(df, names)
    assert sorted(rows(found)) == sorted(by_hand) and ("keywords", 4, 3, 2) in by_hand and ("cited_refs", 4, 2, 2) in by_hand
    capsys.readouterr()
    terms.explode_terms(df, "keywords").explain(True)
    optimized = capsys.readouterr().out.split("Optimized Logical Plan")[1].split("Physical Plan")[0]
    assert optimized.count("array_position") == 1  # no copy of the terms in an inferred filter or for each term


def test_scalar_helpers(spark):
    df = records(spark, [{"TI": ["A", "B"], "DE": ["x; y", " "], "ID": "z", "PY": " 2020 ", "TC": "no", "Z9": "1,234", "DI": "HTTPS://doi.org/doi:10.1/X..", "source_file": "/a/b.ris", "AU": ["Ｌi Xin, A"]}, {"TI": "", "PY": "20200"}])
    r = df.orderBy("ord").select(t.text("TI").alias("ti"), t.text("DE").alias("de"), t.keywords_text().alias("kw"), t.publication_year().alias("py"), t.counted().alias("tc"), t.citations().alias("c"), t.normal_doi(t.text("DI")).alias("doi"), t.record_id().alias("id"), t.surname().alias("s"), t.completeness().alias("n"), t.alnum_key(t.text("TI")).alias("k")).collect()
    assert (r[0].ti, r[0].kw, r[0].py, r[0].tc, r[0].doi, r[0].s, r[0].k) == ("A B", "x; y; z", 2020, 1234, "10.1/x", "li", "ab")
    assert (r[1].py, r[1].tc, r[1].c, r[1].n) == (None, None, 0, 100) and r[1].id.startswith("memory#2@")
    words = spark.createDataFrame([(x,) for x in ("Analyses", "bio-analyses", "cities", "boxes", "news", "viruses", "class", "IL-6", "Water-Waste", "ab")], "w string")
    got = {r.w: (r.s, r.y) for r in words.select("w", t.singular(t.compact(F.col("w"))).alias("s"), t.sentence_case(F.col("w")).alias("y")).collect()}
    assert [got[w][0] for w in ("Analyses", "bio-analyses", "cities", "boxes", "news", "viruses", "class", "IL-6", "ab")] == ["analysis", "bioanalysis", "city", "box", "news", "virus", "class", None, None]
    assert got["Water-Waste"][1] == "Water waste" and got["IL-6"][1] == "Il-6"
    pairs = spark.createDataFrame([("cancer", "lung cancer"), ("water waste", "waterwaste"), ("cell", "mouse"), ("Papers", "paper")], "a string, b string")
    assert [r.s for r in pairs.select(t.scope_changes(F.col("a"), F.col("b")).alias("s")).collect()] == [True, False, False, False]
    odd = spark.createDataFrame([("=1+1",), ("ok\x01",), ("x" * 40000,)], "v string").select(t.spreadsheet_safe(F.col("v")).alias("v")).collect()
    assert odd[0].v == "'=1+1" and odd[1].v == "ok" and len(odd[2].v) < 32700


def test_years_and_scopes(spark):
    df = papers(records(spark, [{"TI": "a", "PY": "2014"}, {"TI": "b", "PY": "2020"}, {"TI": "c"}]))
    status = {r.ti: r.year_status for r in filters.partition_by_year(df, 2015, 2024).collect()}
    assert status == {"a": "excluded", "b": "included", "c": "unknown"}
    assert {r.ti for r in filters.in_years(df, 2015, 2024).collect()} == {"b", "c"}
    assert {r.year_status for r in filters.partition_by_year(df, None, None).collect()} == {"included"}
    assert filters.year_range(" 2015", "") == (2015, None) and filters.format_range(2015, 2015) == "2015 年"
    for bad in (("15", ""), ("2020", "2019"), ("２０２０", "")):
        with pytest.raises(ValueError):
            filters.year_range(*bad)
    out = df.where("ti = 'a'").select("record_key")
    assert filters.scope(df, "raw").count() == 3 and filters.scope(df, "deduped", out).count() == 2 and filters.scope(df, "classified", out, df.where("ti = 'b'")).count() == 1
    assert filters.search(df, " B ", "ti").count() == 1 and filters.titled(df).count() == 3
    with pytest.raises(ValueError):
        filters.by_source_and_language(df, [])
    assert filters.by_source_and_language(df, ["wos"], "英文").count() == 3 and filters.by_source_and_language(df, ["wos"], "中文").count() == 0


def test_dense_trends(spark):
    df = spark.createDataFrame([(1992, 5, "a"), (2016, None, "b"), (None, 1, "a")], "py int, tc long, source string")
    got = rows(metrics.dense_trend(df))
    assert len(got) == 25 and {r[0]: r[2:] for r in got}[1992] == (1, 5) and {r[0]: r[2:] for r in got}[2000] == (0, 0)
    assert len(rows(metrics.dense_trend(df, "source"))) == 50 and len(rows(metrics.dense_trend(df, None, 2010, 2020))) == 11
    names = spark.createDataFrame([("x", "s", 1992, 1), ("x", "s", 2016, 2), ("y", "s", 2000, 9), ("x", "s", None, 0)], "term string, source string, py int, tc long")
    got = rows(metrics.yearly_ranking(names, 1))
    assert len(got) == 25 and {r[0] for r in got} == {"x"}
    assert rows(metrics.plot_ranking(names, 1, "citations")) == [("y", "全部", 1, 9)]


def test_fits(spark):
    df = spark.createDataFrame([(1992 + k, float(k + 1), "s") for k in range(5)], "x int, y double, g string")
    a = metrics.linear_fit(df, "x", "y").first()
    assert (round(a.slope, 9), round(a.intercept, 9), round(a.r2, 9)) == (1, 1, 1)
    q = metrics.quadratic_fit(df.withColumn("y", F.pow(F.col("x") - 1992, 2.0) * 2 + 3), "x", "y").first()
    assert [round(v, 6) for v in (q.a, q.b, q.c, q.r2)] == [2, 0, 3, 1]
    assert metrics.linear_fit(df.withColumn("y", F.lit(4.0)), "x", "y").first().r2 == 1
    fitted = {r.x: r.fitted for r in metrics.loess(df, "x", "y", "g").collect()}
    assert all(abs(fitted[1992 + k] - (k + 1)) < 1e-3 for k in range(5))
    share = metrics.share_of_total(spark.createDataFrame([(1,), (3,)], "n int"), "n")
    assert sorted(r.share for r in share.collect()) == [0.25, 0.75]


PAIR = [{"TI": "Same Title!", "PY": "2020", "AU": "Li, A", "SO": "J", "AB": "first", "DI": "10.1/a"}, {"TI": "same title", "PY": "2020", "AU": "LI, A", "SO": "j", "AB": "second one", "DI": "10.1/b", "source_kind": "scopus"}]


def test_presets(spark):
    p = dedupe.profile(records(spark, PAIR)).persist()
    count = lambda preset: dedupe.candidates(p, preset).count()
    assert [count(x) for x in ("quick", "strict", "journal", "loose")] == [0, 0, 1, 1]
    g = dedupe.candidates(p, "loose").first()
    assert g.doi_conflict and g.primary == p.where("source_kind = 'wos'").first().record_key
    with pytest.raises(ValueError):
        dedupe.match_key("none")


def test_review_cycle(spark):
    clean = [{**r, "TI": f"Other {k}", "DI": "10.1/same"} for k in range(1) for r in PAIR]
    p = dedupe.profile(records(spark, PAIR + clean)).persist()
    groups = dedupe.candidates(p, "loose")
    with pytest.raises(ValueError):
        dedupe.apply_review(groups)
    done = dedupe.auto_review(groups)
    assert {r.status for r in done.collect()} == {"deduped", "ignored"}
    gone = dedupe.apply_review(done)
    assert gone.count() == 1 and dedupe.duplicate_log(done, p, "loose").count() == 1
    assert tuple(dedupe.run_statistics(groups).first()) == (2, 2, 1)
    first = groups.first()
    assert dedupe.apply_review(dedupe.decide(done, first.group_id, "deduped", first.record_keys[1]), gone).count() >= 1
    with pytest.raises(ValueError):
        dedupe.decide(groups, first.group_id, "deduped", "foreign")
    assert not dedupe.needs_new_review(done, done.where("status = 'ignored'")) and dedupe.needs_new_review(done, done)
    c = dedupe.doi_conflicts(p).collect()
    assert len(c) == 1 and list(c[0].dois) == ["10.1/a", "10.1/b"]


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    for n_keys in (8, 60):
        links = sorted({(rng.randrange(60), rng.randrange(n_keys)) for _ in range(60)})
        up = list(range(60))

        def root(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for (a, k), (b, m) in itertools.combinations(links, 2):
            if k == m:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
        got = {r.n: r.component for r in dedupe.connected(spark.createDataFrame(links, "n int, k int"), "n", "k").collect()}
        assert got == {a: root(a) for a, _ in links}


def brute_legacy(items):
    kept, alias, log = [], {}, []
    for r in items:
        keys = [(k, r[k]) for k in ("ut", "doi", "ty") if r[k]]
        at = None
        for k in keys:
            if k in alias and not (k[0] == "ty" and any(kept[alias[k]][c] and r[c] and kept[alias[k]][c] != r[c] for c in ("doi", "first"))):
                at = alias[k]
                break
        if at is None:
            at = len(kept)
            kept.append(r)
        elif r["n"] > kept[at]["n"]:
            log.append((kept[at]["id"], r["id"]))
            kept[at] = r
        else:
            log.append((r["id"], kept[at]["id"]))
        for k in keys:
            alias.setdefault(k, at)
    return [r["id"] for r in kept], sorted(log)


def test_legacy_dedupe_equals_a_fold(spark):
    rng = random.Random(4)
    rows_, brute = [], []
    for k in range(120):
        ut, doi, ty, first = (rng.choice(["", "", *(f"{p}{i}" for i in range(12))]) for p in ("u", "d", "t", "a"))
        n = rng.randint(1, 5)
        rows_.append((f"k{k:03d}", k, n, doi, first, ut, ty, "2020" if ty else ""))
        brute.append({"id": f"k{k:03d}", "ut": ut.upper(), "doi": doi, "ty": ty, "first": first, "n": n})
    df = spark.createDataFrame(rows_, "record_key string, ord long, completeness int, doi string, first_author string, ut string, n_title string, year string")
    got = dedupe.legacy_dedupe(df).collect()
    kept = [r.record_key for r in sorted((r for r in got if r.kept is None), key=lambda r: r.slot)]
    log = sorted((r.record_key, r.kept) for r in got if r.kept is not None)
    assert (kept, log) == brute_legacy(brute)


def test_legacy_dedupe_of_hot_keys_and_chains(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "BLOCK", 7)
    for seed, keys, texts in ((1, 2, 2), (2, 40, 3), (3, 400, 2)):
        rng = random.Random(seed)
        rows_, brute = [], []
        for k in range(250):
            ut, doi = (rng.choice(["", *(f"{p}{i}" for i in range(keys))]) for p in "ud")
            ty, first = rng.choice(["", "hot", "hot", "hot", "t2"]), rng.choice(["", *(f"a{i}" for i in range(texts))])
            rows_.append((f"k{k:03d}", k, n := rng.choice([k, rng.randint(1, 400)]), doi, first, ut, ty, "2020" if ty else ""))
            brute.append({"id": f"k{k:03d}", "ut": ut.upper(), "doi": doi, "ty": ty, "first": first, "n": n})
        df = spark.createDataFrame(rows_, "record_key string, ord long, completeness int, doi string, first_author string, ut string, n_title string, year string")
        got = dedupe.legacy_dedupe(df.repartition(3)).collect()
        kept = [r.record_key for r in sorted((r for r in got if r.kept is None), key=lambda r: r.slot)]
        assert (kept, sorted((r.record_key, r.kept) for r in got if r.kept is not None)) == brute_legacy(brute)
    assert dedupe.legacy_dedupe(df.limit(0)).collect() == []


def test_legacy_dedupe_makes_keys_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    profiles = dedupe.profile(records(spark, [{"TI": "a", "PY": "2020"}, {"TI": "A", "PY": "2020"}, {"TI": "b", "PY": "2020"}]))
    found = dedupe.legacy_dedupe(profiles.mapInPandas(passed, profiles.schema))
    assert found.where("kept is null").count() == 2 and seen.value == 3


def test_members_of_a_hot_group_are_rows(spark):
    rows = spark.range(3000).selectExpr("format_string('k%06d', id) record_key", "id ord", "'wos' source_kind", "'T' title", "if(id < 2, '10.1/a', '') di", "if(id < 2, '10.1/a', '') doi", "array('x') identifiers", "cast(id % 50 as int) completeness", "if(id < 2900, 't', '') n_title", "if(id < 2900, '2020', '') n_year")
    own = dedupe.members(rows, "loose")
    assert "collect_list" not in own._jdf.queryExecution().toString()
    got = own.collect()
    assert len(got) == 2900 and {(r.primary, r.size, r.doi_conflict) for r in got} == {("k000049", 2900, False)}
    done = dedupe.auto_review(own, rows.select("record_key"))
    assert dedupe.apply_review(done).count() == 2899 and tuple(dedupe.run_statistics(done).first()) == (1, 2899, 0)
    assert dedupe.apply_review(dedupe.decide(done, got[0].group_id, "deduped", "k000000")).where("record_key = 'k000000'").isEmpty()
    assert not dedupe.needs_new_review(own.withColumn("status", F.lit("ignored")), own) and dedupe.needs_new_review(own.withColumn("status", F.lit("ignored")), dedupe.members(rows.where("ord < 2800"), "loose"))


def test_keys_equal_compatibility_forms_of_all_characters(spark):
    import unicodedata

    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    own = ["".join(chars[k : k + 97]) for k in range(0, len(chars), 97)] + [*chars[:700], "", None, "ASCII Only 1\n", "ﬁne Straße"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(own)], "k int, c string").repartition(4)
    got = {r.k: r.a for r in df.select("k", t.alnum_key(F.col("c")).alias("a")).collect()}
    assert all(got[k] == (None if x is None else "".join(filter(str.isalnum, unicodedata.normalize("NFKC", x).casefold()))) for k, x in enumerate(own))


def test_vocabulary_merge(spark):
    df = records(spark, [{"TI": "x", "DE": ["waterwaste; water waste", "water-waste", "papers; paper"], "C1": ["[Li, A] Peking Univ, Beijing, Peoples R China [Wang, B] MIT, Boston, USA"], "CO": ["PR China"]}, {"TI": "y", "DE": "unrelated"}])
    merged, report = vocabulary.merge(df, {"organizations": [{"target": "北京大学", "variants": ["Peking Univ"]}], "countries": [{"target": "中国", "variants": ["Peoples R China"]}]})
    r = merged.where(t.text("TI") == "x").select(F.element_at("fields", "DE").alias("de"), F.element_at("fields", "C1").alias("c1"), "raw_block").first()
    assert list(r.de) == ["Water waste", "Paper"] and r.c1[0].startswith("[Li, A] 北京大学, Beijing, 中国 [Wang, B] MIT") and r.raw_block.startswith("PT J")
    assert tuple(vocabulary.report_totals(df, report).first()) == (2, 1)
    assert df.where(t.text("TI") == "x").select(t.values("DE").alias("d")).first().d[0] == "waterwaste; water waste"


def test_a_merge_reads_records_a_few_times(spark):
    rows_ = [{"TI": "x", "DE": ["b; c", "d"], "AU": ["Li, A"], "SO": "Fine J", "C3": ["Peking Univ"], "C1": ["[Li, A] Peking Univ, Beijing, Peoples R China"]}, {"TI": "y", "DE": "unrelated", "C1": ["MIT, Boston, USA"]}]
    df = records(spark, rows_)
    df = df.mapInPandas(lambda batches: batches, df.schema)
    spec = {"keywords": [{"target": "A", "variants": ["b"]}], "journals": [{"target": "Fine", "variants": ["Fine J"]}], "organizations": [{"target": "PKU", "variants": ["Peking Univ"]}], "countries": [{"target": "CN", "variants": ["Peoples R China"]}]}
    merged, report = vocabulary.merge(df, spec)
    found = {(r.tag, tuple(r.after)) for r in report.collect() if r.before != r.after}
    assert {("DE", ("A", "c", "d")), ("SO", ("Fine",)), ("C3", ("PKU",)), ("C1", ("[Li, A] PKU, Beijing, CN",))} <= found
    assert report._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") <= 13  # each change once, none on a table that others have changed


def test_vocabulary_rules(spark):
    assert vocabulary.compile_rules({"keywords": [{"target": "A", "variants": ["b", "C  d"]}]}) == [("keywords", "a", "A"), ("keywords", "b", "A"), ("keywords", "c d", "A")]
    assert ("keywords", "x", None) in vocabulary.compile_rules({"objectType": "keywords", "rules": [{"primaryOutputText": "A", "primaryKey": "a", "secondaryKeys": ["b"]}], "exclusionKeys": ["x"]})
    for bad in ({"keywords": [{"target": "A", "variants": ["x"]}, {"target": "B", "variants": ["x"]}]}, {"projects": [{"objectType": "none"}]}, {"keywords": [{"target": ""}]}, {"objectType": "keywords", "rules": [{"target": "A", "variants": ["x"]}], "exclude": ["X"]}):
        with pytest.raises(ValueError):
            vocabulary.compile_rules(bad)


def test_replacement_joins_distinct_spellings(spark):
    df = spark.createDataFrame([(1, ["b;a", "B", "x\u2003y", "c；A"] + ["a"] * 500), (2, ["d", "d"]), (3, ["gone"])], "k int, v array<string>")
    mapping = spark.createDataFrame([("a", "B"), ("x y", "Z"), ("gone", None)], "key string, target string")
    assert {r.k: r.v for r in vocabulary.replace_terms(df, "k", "v", mapping).collect()} == {1: ["b", "Z", "c"], 2: ["d", "d"], 3: []}
    rows_in = vocabulary.changed_terms(df, "k", "v", mapping)
    assert "Window" not in rows_in._jdf.queryExecution().optimizedPlan().toString() and rows_in.count() == 2


def test_spellings_are_checked_once_each(spark):
    counts = spark.createDataFrame([("Word",), ("word",), ("x1",)] * 50, "term string").groupBy("term").agg(F.count("*").alias("count"))
    plan = vocabulary.keyword_groups(counts, sentence=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "[a-z]{3,}" not in plan[plan.index("Aggregate [term#") :]  # the check stays above the counting of occurrences


def test_replacement_keeps_untouched_arrays(spark):
    df = spark.createDataFrame([(1, ["a; a", "b"]), (2, ["x", "A", "gone"])], "k int, v array<string>")
    mapping = spark.createDataFrame([("x", "a"), ("gone", None)], "key string, target string")
    assert {r.k: list(r.v) for r in vocabulary.replace_terms(df, "k", "v", mapping).collect()} == {1: ["a; a", "b"], 2: ["a"]}


def replaced(spark, value, kind, mapping):
    from quillon.operators import addresses

    df = spark.createDataFrame([(1, [value])], "k int, v array<string>")
    table = spark.createDataFrame([(kind, *pair) for pair in mapping.items()], "kind string, key string, target string")
    found = addresses.replace_names(df, "k", [("v", kind, True)], table, F.col).collect()
    return found[0].changes["v"][0] if found else value


def test_addresses(spark):
    m = {"taiwan": "China", "peking univ": "PKU", "strasse": "Street"}
    assert replaced(spark, "[A] X, Taipei, Taiwan. [B] Y, Taiwan [C] Z, USA", "countries", m) == "[A] X, Taipei, China. [B] Y, China [C] Z, USA"
    assert replaced(spark, "[A]  Peking Univ, Beijing", "organizations", m) == "[A]  PKU, Beijing"
    assert replaced(spark, " A, Taiwan , B, C", "countries", m) == " A, China , B, C" and replaced(spark, "Taiwan, A, B, C", "countries", m) == "Taiwan, A, B, C"
    assert replaced(spark, "Straße", "organizations", m) == "Street"


def test_rules_and_terms_share_their_keys(spark):
    df = records(spark, [{"TI": "x", "DE": ["Straße; other"], "SO": ["ﬁne J."]}])
    merged, report = vocabulary.merge(df, {"keywords": [{"target": "Street", "variants": ["STRASSE"]}], "journals": [{"target": "Fine", "variants": ["Fine J"]}]})
    r = merged.select("fields").first().fields
    assert r["DE"] == ["Street", "other"] and r["SO"] == ["Fine."] and {x.tag for x in report.collect()} == {"DE", "SO"}


def test_rules_from_a_table(spark):
    from quillon.operators import rules

    pairs = spark.createDataFrame([("authors", "A  b", "C"), ("authors", "a B", "C"), ("keywords", "x", None)], "kind string, term string, target string")
    assert {tuple(r) for r in rules.checked_rules(pairs).collect()} == {("authors", "a b", "C"), ("keywords", "x", None)}
    with pytest.raises(Exception, match="more than one decision"):
        rules.checked_rules(pairs.union(spark.createDataFrame([("keywords", "X", "y")], pairs.schema))).collect()


def test_inventory_and_suggestions(spark):
    entries = spark.createDataFrame([(f"t{k:03d}", k) for k in range(185)], "term string, count int")
    assert [r["count"] for r in vocabulary.plan_batches(entries).groupBy("batch").count().orderBy("batch").collect()] == [90, 90, 5]
    asked = []
    vocabulary.suggest(entries, lambda batch, refs: asked.append((batch, refs)) or [])
    assert sorted(x for b, _ in asked for x in b) == [f"t{k:03d}" for k in range(185)] and all(not set(b) & set(r) and len(r) <= 30 for b, r in asked)
    assert vocabulary.suggest(entries.limit(0), lambda b, r: 1 / 0) == []
    s = spark.createDataFrame([("Water waste", "waterwaste"), ("cancer", "lung cancer"), ("Own", "taken"), ("p", "q"), ("r", "q")], "target string, variant string")
    staged = {(r.target, r.variant): r.verdict for r in vocabulary.stage_suggestions(s, spark.createDataFrame([("taken", "Else")], "key string, target string")).collect()}
    assert staged == {("Water waste", "waterwaste"): "accepted", ("cancer", "lung cancer"): "scope", ("Own", "taken"): "conflict", ("p", "q"): "conflict", ("r", "q"): "conflict"}
    assert vocabulary.grounded(s, spark.createDataFrame([("WATERWASTE",), ("water  waste",)], "term string")).count() == 1
    calls = []
    good, bad = vocabulary.accept_most(list(range(799)), lambda items: calls.append(1) or 500 not in items)
    assert bad == [500] and len(good) == 798 and len(calls) < 40
    assert vocabulary.accept_most([1, 2, 3], lambda items: True) == ([1, 2, 3], [])


def test_catalog(spark):
    catalog = spark.createDataFrame([("authors", "T", "v1"), ("authors", "T", "v2"), ("keywords", "K", "v")], "kind string, target string, variant string")
    rules = spark.createDataFrame([("authors", "v1", "Own")], "kind string, key string, target string")
    assert {tuple(r) for r in vocabulary.overlay(catalog, rules, rules.limit(0).select("kind", "key")).collect()} == {("authors", "v1", "Own"), ("authors", "v2", "T")}
    new = vocabulary.remember(catalog, spark.createDataFrame([("authors", "N", "V2")], "kind string, target string, variant string"), spark.createDataFrame([("authors", "v1")], "kind string, variant string"))
    assert {tuple(r) for r in new.collect()} == {("authors", "N", "V2")}
    r2 = vocabulary.upsert_pair(rules, "authors", "New", "V1")
    assert {tuple(r) for r in r2.collect()} == {("authors", "v1", "New")}
    left, exclusions = vocabulary.remove_pair(r2, rules.limit(0).select("kind", "key"), "authors", "v1", True)
    assert left.count() == 0 and exclusions.count() == 1
    with pytest.raises(ValueError):
        vocabulary.upsert_pair(rules, "authors", "a;b", "c")


@pytest.mark.parametrize("change, preset, expected", [({}, "quick", (False, False)), ({"DE": "other words"}, "quick", (False, True)), ({"DE": "Water-waste"}, "quick", (False, False)), ({"AU": "Else, X"}, "journal", (True, False)), ({"SO": "Other"}, "quick", (False, False))])
def test_impact(spark, change, preset, expected):
    base = {"TI": "t", "PY": "2020", "AU": "Li, A", "SO": "J", "DE": "water waste", "DI": "10.1/x"}

    def side(row):
        df = records(spark, [row])
        return dedupe.profile(df, exact=False).select("record_key", dedupe.match_key(preset).cast("string").alias("match_key")).join(df.select("record_key", vocabulary.signature().alias("signature")), "record_key")

    a, b = side(base), side({**base, **change})
    assert tuple(vocabulary.impact(a, b, a.select("record_key")).first()) == expected


def bridge(spark, docs):
    return spark.createDataFrame([(k, k, 2020 + k, tc, p, x, x.lower()) for k, (xs, tc) in enumerate(docs) for p, x in enumerate(xs)], "record_key int, ord int, py int, tc long, pos int, term string, key string")


def test_network(spark, tmp_path):
    df = bridge(spark, [(["Climate", "water"], 12), (["climate", "energy", "Water"], 3), (["climate"], None)])
    n = network.build(df, "keywords", 1, 80)
    nodes = {r.label: (r.id, r.documents, r.citations, r.total_link_strength) for r in n.nodes.collect()}
    assert nodes == {"Climate": (1, 3, 15, 3), "water": (2, 2, 15, 3), "energy": (3, 1, 3, 2)}
    assert {tuple(r) for r in n.edges.collect()} == {(1, 2, 2), (1, 3, 1), (2, 3, 1)}
    assert {r.id: r.covered for r in network.citation_coverage(df, n.nodes).collect()} == {1: 2, 2: 2, 3: 1}
    assert {r.id: r.total_link_strength for r in network.subgraph(n, [1, 2]).nodes.collect()} == {1: 2, 2: 2}
    for bad in (lambda: network.build(df, "keywords", 4, 80), lambda: network.build(df.limit(0), "cited_authors"), lambda: network.build(df, "journals", 1), lambda: network.select_nodes(df, 0, 80), lambda: network.subgraph(n, [1])):
        with pytest.raises(ValueError):
            bad()
    data = sinks.network_json(n, "t")
    assert data["network"]["items"][0]["weights"]["Total link strength"] == 3 and data["network"]["items"][0]["scores"]["Avg. pub. year"] == 2021
    a, b = (sinks.save_network(spark, data, f"file://{tmp_path}", "keywords", datetime(2024, 1, 2)) for _ in range(2))
    assert a != b and bibliography.read_network(spark, a)[1].count() == 3
    text, links = sinks.map_and_network(data)
    assert text.split("\n")[0] == "id\tlabel\tweight<Citations>\tweight<Documents>\tweight<Total link strength>\tscore<Avg. pub. year>" and links.split("\n")[0] == "1\t2\t2"
    assert sinks.save_state(spark, data, f"file://{tmp_path}/s.json") and not sinks.save_state(spark, data, f"file://{tmp_path}/s.json", data)
    assert network.merge_parameters({"a": 1}, {"b": 2, "json": 3}, {"c": 4}) == {"a": 1, "b": 2, "c": 4}
    assert [r.year for r in network.year_palette(n.nodes, 3).collect()] == sorted(r.year for r in network.year_palette(n.nodes, 3).collect())


def test_coupling(spark):
    docs = [("A", ["r1", "r2"]), ("A", ["r1"]), ("C", ["r1", "r3"]), ("B", ["r9"])]
    df = bridge(spark, [([j], 1) for j, _ in docs])
    refs = spark.createDataFrame([(k, r) for k, (_, rs) in enumerate(docs) for r in rs], "record_key int, ref string")
    n = network.build(df, "journals", 1, 80, refs)
    names = {r.id: r.label for r in n.nodes.collect()}
    assert [(names[r.source_id], names[r.target_id], r.strength) for r in n.edges.collect()] in ([("A", "C", 2)], [("C", "A", 2)])


def test_cooccurrence_equals_brute_force(spark):
    rng = random.Random(5)
    docs = [([f"k{x}" for x in rng.sample(range(12), rng.randint(1, 6))], 1) for _ in range(60)]
    df = bridge(spark, docs)
    nodes = network.select_nodes(df, 2, 10)
    label = {r.id: r.label for r in nodes.collect()}
    chosen = set(label.values())
    expected = {}
    for xs, _ in docs:
        for a, b in itertools.combinations(sorted(set(xs) & chosen), 2):
            expected[a, b] = expected.get((a, b), 0) + 1
    assert {tuple(sorted((label[r.source_id], label[r.target_id]))): r.strength for r in network.cooccurrence(df, nodes).collect()} == expected


def lowest_aggregate(df) -> str:
    """The aggregation that is nearest to the rows."""
    return [x for x in df._jdf.queryExecution().sparkPlan().toString().split("\n") if "Aggregate(" in x][-1]


def test_rank_hashes_rows_and_keeps_the_first_spelling(spark):
    rows = [(k, o, 2020, 1, p, x, x.lower()) for k, o, p, x in [(1, 5, 0, "Ab"), (2, -3, 1, "AB"), (2, -3, 0, "aB"), (3, 1 << 60, 0, "ab"), (4, 7, 2, "c")]]
    df = spark.createDataFrame(rows, "record_key int, ord long, py int, tc long, pos int, term string, key string")
    found = metrics.rank_terms(df)
    assert [tuple(r) for r in found.collect()] == [("aB", 4, 4), ("c", 1, 1)] and "HashAggregate(" in lowest_aggregate(found)


def test_nodes_of_keys_once_a_record_are_hashed(spark):
    df = bridge(spark, [(["Climate", "water"], 12), (["climate", "energy", "Water"], 3), (["climate"], None)]).withColumn("py", F.when(F.col("ord") < 2, F.col("py")))
    once = network.select_nodes(df, 1, 80, once=True)
    assert "HashAggregate(" in lowest_aggregate(once) and sorted(map(tuple, once.collect())) == sorted(map(tuple, network.select_nodes(df, 1, 80).collect()))
    assert {r.id: r.covered for r in network.citation_coverage(df, once, once=True).collect()} == {r.id: r.covered for r in network.citation_coverage(df, once).collect()} == {1: 2, 2: 2, 3: 1}
    assert network.select_nodes(df.withColumn("py", F.lit(None).cast("int")), 1, 80, once=True).first().avg_year is None


def test_cooccurrence_of_300_nodes_without_lists_of_rows(spark):
    rng = random.Random(8)
    docs = [([f"k{x:03}" for x in rng.sample(range(300), 9)] * 2, 1) for _ in range(200)] + [([f"k{x:03}" for x in range(300)], 1)]
    df = bridge(spark, docs)
    nodes = network.select_nodes(df, 1, 300).checkpoint()
    ids, expected = {r.label: r.id for r in nodes.collect()}, {}
    for xs, _ in docs:
        for pair in itertools.combinations(sorted({ids[x] for x in xs}), 2):
            expected[pair] = expected.get(pair, 0) + 1
    edges = network.cooccurrence(df, nodes)
    assert {(r.source_id, r.target_id): r.strength for r in edges.collect()} == expected and len(expected) == 44850
    assert "collect_" not in edges._jdf.queryExecution().sparkPlan().toString()


def test_subgraph_makes_nothing_anew(spark):
    df = bridge(spark, [(["a", "b", "c"], 1), (["a", "b"], 1)])
    nodes = network.select_nodes(df, 1, 80)
    sub = network.subgraph(network.Network(nodes, network.cooccurrence(df, nodes)), [1, 2])
    assert sorted(map(tuple, sub.edges.collect())) == [(1, 2, 2)]
    assert not any("Aggregate(" in x._jdf.queryExecution().sparkPlan().toString() for x in (sub.edges, sub.nodes.select("id")))


def test_shuffles_of_read_tables_grow_with_them(spark):
    from quillon.plans import lenses

    assert lenses.fine(spark.range(0, 90, 1, 9)) == 54 and lenses.fine(spark.range(0, 9, 1, 1)) == 6


def test_records_of_orders_have_only_the_fields_asked_for(spark):
    from quillon.plans import catalog, lenses

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    own = lenses.bibliography(spark, d, ("PY", "DE"))
    whole = {r.record_key: r.fields for r in lenses.bibliography(spark, d).select("record_key", "fields").collect()}
    assert {r.record_key: r.fields for r in own.select("record_key", "fields").collect()} == {k: {"PY": f["PY"], "DE": f["DE"]} for k, f in whole.items()}
    assert "s_name" not in own._jdf.queryExecution().optimizedPlan().toString()
    plan = catalog.QUERIES["cited_author_nodes"](spark, d)._jdf.queryExecution().sparkPlan().toString()
    assert not [x for x in plan.split("\n") if "Aggregate(" in x and "record_key" in x]  # authors are counted without being gathered by record


def test_squeezing_plain_words_changes_nothing(spark):
    texts = ["", " ", "a", "a b", " a", "a ", "a  b", "a\tb", "a\u00a0b", "ä b", "ä  b", "a\n", "a\x1fb", "a\x7fb", "x" * 5000 + " y"]
    got = [r.s for r in spark.createDataFrame(list(enumerate(texts)), "n int, t string").orderBy("n").select(t.squeeze(F.col("t")).alias("s")).collect()]
    assert got == [re.sub(f"[{t.BLANKS}]+", " ", x).strip(" ") for x in texts]


def test_a_network_makes_its_bridge_once(spark):
    seen, before = spark.sparkContext.accumulator(0), spark.sparkContext._jsc.getPersistentRDDs().size()

    def passed(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = bridge(spark, [(["a", "b", "c"], 1), (["a", "b"], 1)])
    found = network.build(df.mapInPandas(passed, df.schema), "keywords", 2, 25)
    assert sorted(map(tuple, found.edges.collect())) == [(1, 2, 2)] and seen.value == 5
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


@pytest.mark.parametrize("choice, confidence, p, decision", [("irrelevant", 0.42, 0.65, "relevant"), ("irrelevant", 0.80, 0.74, "relevant"), ("irrelevant", 0.60, 0.75, "irrelevant"), ("uncertain", 0.9, 0.9, "uncertain"), ("relevant", 0.1, 0.1, "relevant")])
def test_stage_one(spark, choice, confidence, p, decision):
    r = screening.with_stage_one(spark.createDataFrame([(choice, confidence, p)], "choice string, confidence double, p_irrelevant double")).first()
    assert r.decision == decision and bool(r.missing) == (choice != decision or choice == "uncertain")


def test_two_stages_cache_and_review(spark):
    df = spark.createDataFrame([("a", "t1"), ("b", "t2"), ("c", "t3")], "record_id string, title string")

    def client(row, plan):
        if row["title"] == "t3":
            raise OSError("down")
        return {"decision": "uncertain" if row["title"] == "t2" else "relevant", "confidence": 0.7, "reason": f"{plan['tokens']}"}

    one = screening.classify(df, client, tasks=2)
    got = {r.record_id: r for r in one.collect()}
    assert got["c"].decision == "uncertain" and got["c"].error == "down" and got["a"].reason == "1200"
    two = screening.classify(df.join(one.where(screening.needs_stage_two()), "record_id", "left_semi"), lambda r, p: {"decision": "irrelevant", "confidence": 1} if r["record_id"] == "b" else 1 / 0, tasks=screening.STAGE_TWO_TASKS)
    final = {r.record_id: r for r in screening.resolve(one, two).collect()}
    assert final["b"].decision == "irrelevant" and final["b"].error == "" and "division" in final["c"].error and not final["a"].reviewed
    keyed = df.withColumn("cache_key", screening.cache_key("1", "m", "p", " q ", F.struct("title")))
    cache = screening.updated_cache(spark.createDataFrame([], "cache_key string, decision string"), one.join(keyed.select("record_id", "cache_key"), "record_id"))
    hits, misses = screening.split_by_cache(keyed, cache)
    assert hits.count() == 2 and [r.record_id for r in misses.collect()] == ["c"]
    done = screening.review(screening.resolve(one, two), spark.createDataFrame([("c",)], "record_id string"))
    assert {r.record_id: r.final_decision for r in done.collect()} == {"a": "relevant", "b": "irrelevant", "c": "irrelevant"}
    assert screening.decision_counts(done).first().failures == 1
    parsed = screening.parse_stage_two(spark.createDataFrame([('{"decision": " Include", "confidence": 3}',), ("junk",)], "a string"), "a").collect()
    assert (parsed[0].decision, parsed[0].confidence, parsed[1].error) == ("relevant", 1.0, "unreadable answer")
    with pytest.raises(Exception, match="no result"):
        screening.complete(df, done.where("record_id = 'a'")).collect()
    with pytest.raises(Exception, match="not a probability"):
        spark.createDataFrame([(1.5,)], "p double").select(screening.checked_probability(F.col("p"))).collect()


RIS = "TY  - JOUR\nTI  - {0}\nPY  - 2020\nN1  - Cited By: {1}\nDB  - Scopus\nER  -\n"


def test_import_export_and_workspace(spark, tmp_path):
    src = tmp_path / "in"
    (src / "sub").mkdir(parents=True)
    (src / "a.ris").write_text(RIS.format("One", 4))
    (src / "sub" / "b.txt").write_text("FN Clarivate\nVR 1.0\nPT J\nTI Two\nAU X, Y\n   Z, W\nDE a; b\nPY 2021\nER\n\nEF\n")
    (src / "bad.csv").write_text("x,y\n1,2\n")
    (src / "ignore.pdf").write_text("")
    paths, warnings = bibliography.expand_inputs(spark, [f"file://{src}", f"file://{src}/A.ris".replace("A.ris", "a.ris"), f"file://{tmp_path}/none"])
    assert [p.rsplit("/", 1)[1] for p in paths] == ["a.ris", "bad.csv", "b.txt"] and len(warnings) == 1
    found = bibliography.read_bibliography(spark, paths)
    assert [r.t for r in found.records.orderBy("ord").select(t.text("TI").alias("t")).collect()] == ["One", "Two"]
    assert {r["format"] for r in found.files.collect()} == {"ris", "wos_tagged", None} and found.header.startswith("FN Clarivate")
    with pytest.raises(Exception, match="none of the known"):
        bibliography.read_bibliography(spark, paths, strict=True)
    out = sinks.export_tagged(found.records, f"file://{tmp_path}/out.txt")
    text = (tmp_path / "out.txt").read_bytes().decode()
    assert text.startswith("FN Clarivate Analytics Web of Science\nVR 1.0\nPT J\n") and text.endswith("ER\n\nEF\n") and "AU X, Y\n   Z, W\n" in text and "DE a; b\n" in text and "\r" not in text
    again = bibliography.read_bibliography(spark, [out])
    assert again.records.count() == 2
    old = found.records.withColumn("fields", F.map_filter("fields", lambda k, v: k != "TC"))
    filled = bibliography.backfill_citations(old, found.records)
    assert sorted(r.c or 0 for r in filled.select(t.counted().alias("c")).collect()) == [0, 4]
    j = found.records.select(bibliography.record_json().alias("j"))
    assert bibliography.from_record_json(j, "j").select("record_key").exceptAll(found.records.select("record_key")).isEmpty()
    w = Workspace(spark, f"file://{tmp_path}/ws")
    w.save("p", {"records": found.records}, name="My project", scope={"y": 1})
    w.save("p", {"excluded": found.records.limit(1).select("record_key")})
    assert w.active("p").count() == 1 and w.list() == [{"project": "p", "name": "My project", "generation": 2}] and w.ready("p", 2, {"y": 1})
    w.mark_stale("p", "dedupe")
    assert not w.ready("p", 2, {"y": 1})
    w.archive("p")
    assert w.list() == []
    with pytest.raises(ValueError):
        sinks.export_tagged(found.records.limit(0), f"file://{tmp_path}/none.txt")


def test_pairs_files(spark, tmp_path):
    p = tmp_path / "pairs.txt"
    p.write_bytes("目标\t变体\nA\tb\n".encode("gb18030"))
    pairs = bibliography.read_pairs(spark, f"file://{p}")
    assert pairs.count() == 2
    assert open(sinks.write_pairs(pairs, f"file://{tmp_path}/out.txt").removeprefix("file://")).read() == "A\tb\n目标\t变体\n"
    p.write_text("A\tb\nbroken\n")
    with pytest.raises(ValueError, match="line 2"):
        bibliography.read_pairs(spark, f"file://{p}")
    csv = sinks.write_csv(pairs, f"file://{tmp_path}/x.csv").removeprefix("file://")
    assert open(csv, "rb").read().startswith(b"\xef\xbb\xbftarget,variant\n")


def test_screening_export(spark, tmp_path):
    df = records(spark, [{"TI": "=Danger", "PY": "2020", "AF": "Full, Name", "FX": "Fund"}, {"TI": "No", "UT": "WOS:2"}])
    rows_ = df.withColumn("record_id", t.record_id()).withColumn("decision", F.lit("uncertain")).withColumn("final_decision", F.when(F.col("ord") == 0, "relevant").otherwise("irrelevant"))
    rows_ = rows_.withColumn("confidence", F.lit(0.5)).withColumn("human_modified", F.lit(True)).withColumn("reason", F.lit("r")).withColumn("missing", F.array(F.lit("m"))).withColumn("error", F.lit(""))
    flat = sinks.flat_rows(rows_)
    assert len(flat.columns) == 30 and flat.where(F.col("最终分类") == "相关").first()["题名"] == "'=Danger" and flat.first()["作者"] == "Full, Name"
    log = spark.createDataFrame([("a", "b")], "x string, y string")
    paths = sinks.export_screening(rows_, log, f"file://{tmp_path}/e")
    assert (tmp_path / "e" / "relevant.txt").exists() and spark.read.json(paths["audit"]).count() == 2
    views = spark.read.option("header", True).csv(paths["views"])
    assert {r.view: r["count"] for r in views.groupBy("view").count().collect()} == {"all": 2, "relevant": 1, "irrelevant": 1, "review": 2}
    assert sinks.run_info(rows_, log, model="m") == {"model": "m", "records": 2, "relevant": 1, "irrelevant": 1, "uncertain_at_first": 2, "duplicates": 1, "failures": 0}
    assert sinks.run_info(rows_.withColumn("error", F.when(F.col("ord") == 0, "down")))["failures"] == 1 and sinks.run_info(rows_.limit(0))["records"] == 0
    assert sinks.error_scan(flat) == {} and sinks.error_scan(flat.withColumn("题名", F.lit("x #N/A"))) == {"题名": 2}
    assert json.loads((tmp_path / "e" / "run_info.json").read_text())["broken_cells"] == {}


def test_single_files_are_whole_or_absent(spark, tmp_path):
    rows_ = spark.range(5000).selectExpr("id", "concat('a,\"', id, '\n') text", "if(id % 2 = 0, null, 'x') other").repartition(7).orderBy(F.desc("id"))
    path = sinks.write_csv(rows_, f"file://{tmp_path}/t.csv").removeprefix("file://")
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([["id", "text", "other"], *([k, f'a,"{k}\n', "x" if k % 2 else None] for k in range(4999, -1, -1))])
    assert open(path, encoding="utf-8-sig", newline="").read() == out.getvalue()
    with pytest.raises(Exception, match="bad"):
        sinks.write_lines(spark.range(3).select(F.raise_error(F.lit("bad")).cast("string")), f"file://{tmp_path}/t.csv")
    assert open(path, encoding="utf-8-sig", newline="").read() == out.getvalue() and sorted(x.name for x in tmp_path.iterdir() if not x.name.startswith(".")) == ["t.csv"]
    now = datetime(2024, 5, 6, 7, 8)
    assert sinks.preferred_export_dir("/app", None, now) == "/app/output/2405060708" == sinks.preferred_export_dir("/app/", "/app/x/../output/old", now)
    assert sinks.preferred_export_dir("/app", "/elsewhere", now) == "/elsewhere" and sinks.preferred_export_dir("/app", "/app/output2", now) == "/app/output2"


def test_streaming_import(spark, tmp_path):
    from quillon.streaming import ingest

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.ris").write_text(RIS.format("One", 4))

    def run():
        q = ingest.append_records(ingest.stream_records(ingest.stream_files(spark, f"file://{src}")), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
        q.awaitTermination()
        return spark.read.parquet(f"file://{tmp_path}/out").count()

    assert run() == 1
    (src / "b.ris").write_text(RIS.format("Two", 5))
    assert run() == 2 and run() == 2


def test_import_stats(spark):
    files = spark.createDataFrame([("wos", None), ("wos", "broken")], "source string, error string")
    r = spark.createDataFrame([("wos",), ("wos",)], "source_kind string")
    assert json.loads(metrics.import_stats(files, r, r.limit(1)).toJSON().first()) == {"source": "wos", "uploaded": 2, "success": 1, "failed": 1, "records": 2, "retained": 1, "deduped": 1}


def test_small_operators(spark):
    from quillon.operators import filters, screening
    from quillon.sources import sinks

    df = spark.createDataFrame([(" 12 ", '[" a", "", "b"]'), ("x1", "plain"), (None, None), ("99999999999999999999", "[broken")], "c string, l string")
    got = df.select(t.integer_or_text(F.col("c")).alias("x"), t.string_list(F.col("l")).alias("l")).collect()
    assert [(r.x.number, r.x.text, list(r.l)) for r in got] == [(12, None, ["a", "b"]), (None, "x1", ["plain"]), (None, None, []), (None, "99999999999999999999", ["[broken"])]
    titles = spark.createDataFrame([("“ﬁne”",), ("Straße",)], "c string").select(t.title_sort_key(F.col("c")).alias("k")).collect()
    assert [r.k for r in titles] == ["fine”", "strasse"]
    results = spark.createDataFrame([(1, "uncertain", 0.2), (2, "uncertain", None), (3, "relevant", 0.9)], "record_id int, decision string, confidence double")
    ids = lambda *n: spark.createDataFrame([(k,) for k in n], "record_id int")
    assert [r.record_id for r in screening.restored_draft(ids(1, 2), ids(2, 3), results).collect()] == [2]
    assert screening.restored_draft(ids(1), ids(1), results).count() == 0
    assert [r.record_id for r in screening.sorted_review(results).collect()] == [3, 1, 2]
    meta = {"generation": 1, "start_year": 2000, "end_year": None}
    assert filters.restorable(meta, meta, results, ids(1, 2, 3)) and not filters.restorable(meta, meta, results, ids(1, 2)) and not filters.restorable(meta, {**meta, "generation": 2}, results, ids(1, 2, 3))
    assert sinks.plot_rows(spark.createDataFrame([(2, 5), (1, 4)], "x int, y int"), "x", "y", names={"y": "papers"}).collect()[0].asDict() == {"x": 1, "papers": 4}


def test_reviews_by_kind_and_members(spark):
    groups = lambda *sets: spark.createDataFrame([(f"g{k}", list(s), "pending", False) for k, s in enumerate(sets)], "group_id string, record_keys array<string>, status string, doi_conflict boolean")
    before = groups(["a", "b"]).withColumn("status", F.lit("ignored"))
    after = groups(["b", "a"], ["c", "d"])
    assert dedupe.needs_new_review(before, after) and not dedupe.needs_new_review(before, groups(["b", "a"]))
    assert dedupe.needs_new_review(before, after, "journals", "journal") and not dedupe.needs_new_review(before, after, "journals", "loose") and not dedupe.needs_new_review(before, after, "keywords", "journal")
    keys = spark.createDataFrame([(k,) for k in "abc"], "record_key string")
    assert dedupe.auto_review(groups(["a", "b"]), keys).first().status == "deduped"
    with pytest.raises(ValueError, match="isn't among"):
        dedupe.auto_review(after, keys)


def test_provenance_and_halving(spark):
    pairs = spark.createDataFrame([("b", "x"), ("A", "y")], "target string, variant string")
    got = vocabulary.with_provenance(pairs, spark.createDataFrame([("a", "Y", "same")], "target string, variant string, reason string")).collect()
    assert [(r.target, r.ai, r.ai_reason) for r in got] == [("A", True, "same"), ("b", False, None)]
    s = spark.createDataFrame([("one", "ones"), ("two", "twos"), ("cancer", "lung cancer")], "target string, variant string")
    good, bad = vocabulary.stage_and_accept(s, spark.createDataFrame([], "key string, target string"), lambda own: ("two", "twos") not in own)
    assert [r.variant for r in good.collect()] == ["ones"] and {(r.variant, r.verdict) for r in bad.collect()} == {("twos", "invalid"), ("lung cancer", "scope")}


def test_clients_are_asked_again(spark):
    from quillon.operators import screening

    def client(row, plan):
        if row["n"] == 400:
            raise screening.AnswerError("bad request", 400)
        if row["n"] == 503:
            raise screening.AnswerError("busy", 503)
        if row["n"] == 1 and plan["tokens"] < 4000:
            raise screening.AnswerError("cut off", truncated=True)
        return {"decision": "relevant", "confidence": 1}

    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 400), ("d", 503)], "record_id string, n int")
    got = {r.record_id: (r.decision, r.error) for r in screening.classify(df, client, tasks=2, wait=0.01).collect()}
    assert got == {"a": ("relevant", ""), "b": ("relevant", ""), "c": ("uncertain", "bad request"), "d": ("uncertain", "busy")}
    assert [screening.back_off(k) for k in (1, 2, 3, 9)] == [1, 2, 4, 30]


def test_import_of_nothing_usable(spark, tmp_path):
    from quillon.sources.bibliography import read_bibliography
    from quillon.sources.formats import FormatError

    for n in (1, 2):
        (tmp_path / f"{n}.txt").write_text("no format")
    with pytest.raises(FormatError, match="none of the files"):
        read_bibliography(spark, [f"file://{tmp_path}/1.txt", f"file://{tmp_path}/2.txt"])
