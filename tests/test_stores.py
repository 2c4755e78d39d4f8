"""Stores and reviews: keyed results, the catalog of projects, suggestions by group testing, requests under a cap."""

import os
import random
import subprocess
import sys
import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from quillon.operators import screening, vocabulary
from quillon.sources import kv
from quillon.workspace import Workspace

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture
def store(spark, tmp_path):
    s = kv.KeyedStore(spark, f"file://{tmp_path}/kv", buckets=8)
    s.put(spark.createDataFrame([(f"k{k}", k, 1) for k in range(200)] + [("k0", 99, 0), (None, 5, 5)], "cache_key string, n long, at int"))
    return s


def test_keyed_store_equals_a_join(spark, store):
    with pytest.raises(ValueError):
        kv.KeyedStore(spark, store.path + "-none").table()
    plain = {f"k{k}": (k, 1) for k in range(200)} | {"k0": (0, 1)}
    assert {r.cache_key: (r.n, r.at) for r in store.table().collect()} == plain
    new = spark.createDataFrame([("k3", -3, 2), ("new", 1, 2), ("ü", 2, 2), ("", 3, 2)], "cache_key string, n long, at int")
    before = store.manifest()
    assert store.put(new) == 2
    after = store.manifest()
    touched = {b for b in after["files"] if after["files"][b] != before["files"].get(b)}
    assert 1 <= len(touched) <= 4 and len(after["files"]) == 8
    plain |= {r.cache_key: (r.n, r.at) for r in new.collect()}
    assert {r.cache_key: (r.n, r.at) for r in store.table().collect()} == plain
    asked = spark.createDataFrame([("k3", 1), ("k3", 2), ("ü", 3), ("missing", 4), (None, 5)], "cache_key string, place int")
    found = store.lookup(asked)
    assert sorted((r.place, r.n) for r in found.collect()) == [(1, -3), (2, -3), (3, 2)]
    assert len(found.inputFiles()) <= 3 < len(store.table().inputFiles())
    assert store.vacuum() == 0 and store.put(spark.createDataFrame([(f"k{k}", k, 3) for k in range(200)] + [("new", 1, 3), ("ü", 1, 3), ("", 1, 3)], "cache_key string, n long, at int")) == 3
    assert store.vacuum() == 2 and store.table().count() == 203


def test_data_source_reads_only_the_buckets_asked_for(spark, store):
    kv.register(spark)
    df = spark.read.format("quillon_keyed").load(store.path)
    assert df.count() == 200
    assert [tuple(r) for r in df.where("cache_key = 'k7'").collect()] == [("k7", 7, 1)]
    assert sorted(r.n for r in df.where("cache_key in ('k1', 'k2', 'x') and n > 1").collect()) == [2]
    assert df.where("cache_key = 'k1' and cache_key = 'k2'").count() == 0
    reader = lambda *filters: (r := kv.KeyedReader(store.manifest(), df.schema), list(r.pushFilters(list(filters))))[0]
    files = sum(len(own) for own in store.manifest()["files"].values())
    assert len(reader().partitions()) == files and len(reader(EqualTo(("n",), 3)).partitions()) == files
    one = reader(EqualTo(("cache_key",), "k7")).partitions()
    assert len(one) == 1 and sum(b.num_rows for b in reader().read(one[0])) == 1
    assert len(reader(In(("cache_key",), ("k1", "k2", "k3"))).partitions()) <= 3


def test_catalog_and_scan_of_all_projects(spark, tmp_path):
    w = Workspace(spark, f"file://{tmp_path}/ws")
    assert w.catalog().collect() == [] and w.list() == []
    rows = lambda *n: spark.createDataFrame([(k,) for k in n], "record_key int")
    w.save("a", {"records": rows(1, 2)}, name="A", query="q1", skip_dedupe=True, other="kept")
    w.save("a", {"records": rows(1, 2, 3)})
    w.save("b", {"records": rows(4).withColumn("more", F.lit("x")), "excluded": rows(4)}, query="b")
    w.save("c", {})
    w.save_view("a", query="q2", year_start="2001", foreign=1)
    w.save_view("b", query="late")
    w.mark_stale("b", "dedupe")
    got = {r.project: r for r in w.catalog().collect()}
    assert set(got) == {"a", "b", "c"} and (got["a"].name, got["a"].generation) == ("A", 2)
    assert got["a"].settings == {"query": "q2", "year_start": "2001", "other": "kept"} and got["a"].view_applied
    assert got["b"].stale == ["dedupe"] and got["b"].settings == {"query": "late"} and got["c"].settings == {}
    w.save("b", {}, query="newest")  # a newer project has no view
    assert {r.project: r.settings.get("query") for r in w.catalog().collect()}["b"] == "newest"
    union = sorted((p, r.record_key) for p in "ab" for r in w.load(p, "records").collect())
    assert sorted((r.project, r.record_key) for r in w.scan("records").collect()) == union
    assert {r.project for r in w.scan("records", "generation > 1 and project <> 'b'").collect()} == {"a"}
    for f in Path(tmp_path).glob("ws/*/records/*/*.parquet"):
        f.unlink()
    assert w.catalog().count() == 3 and len(w.list()) == 3  # no table is opened
    with pytest.raises(ValueError):
        w.scan("groups")


def one_by_one(n, bad):
    kept, refused = [], []
    for k in range(n):
        (kept if not bad([*kept, k]) else refused).append(k)
    return refused


@pytest.mark.parametrize("seed", [1, 2])
def test_refused_pairs_are_those_of_one_after_the_other(spark, seed):
    rng = random.Random(seed)
    n = 60
    clashes = [(0, 7)] if seed == 1 else [tuple(sorted(rng.sample(range(n), 2))) for _ in range(4)] + [(9, 9), (59, 59)]
    items = spark.range(n).selectExpr("id pos", "concat('t', id) target", "concat('v', id) variant")
    pairs = spark.createDataFrame(clashes, "a long, b long")

    def check(tests):
        own = tests.select("test", "pos")
        both = own.join(pairs, own["pos"] == pairs["a"]).select("test", "b").join(own.select(F.col("test").alias("t2"), F.col("pos").alias("p2")), (F.col("test") == F.col("t2")) & (F.col("b") == F.col("p2")))
        return both.select("test").distinct()

    got = sorted(r.pos for r in vocabulary.refused_pairs(items, check).collect())
    assert got == one_by_one(n, lambda own: any(a in own and b in own for a, b in clashes))


def test_few_validations_for_many_suggestions(spark):
    items = spark.range(799).selectExpr("id pos", "concat('t', id) target", "concat('v', id) variant")
    jobs, sets = [], []

    def check(tests):
        found = tests.where("pos = 500").select("test").distinct()
        jobs.append(1)
        sets.append(tests.select("test").distinct().count())
        return found

    assert [r.pos for r in vocabulary.refused_pairs(items, check).collect()] == [500]
    assert sum(sets) < 40 and len(jobs) < 9


def test_rule_conflicts_of_sets(spark):
    rules = spark.createDataFrame([("old", "water"), ("k", None)], "key string, target string")
    check = vocabulary.rule_conflicts(rules)
    rows = [(1, "a", "b"), (1, "c", "d"), (2, "a", "b"), (2, "c", "B"), (3, "a", "b"), (3, "b", "c"), (4, "fire", "old"), (5, "water", "old"), (6, "x", "water"), (7, "old", "y"), (8, "s", "S")]
    tests = spark.createDataFrame([(k, i, a, b) for i, (k, a, b) in enumerate(rows)], "test int, pos long, target string, variant string")
    assert sorted(r.test for r in check(tests).collect()) == [2, 3, 4, 6, 7]


def test_requests_run_at_the_cap(spark, tmp_path):
    folder = str(tmp_path)

    def client(row, plan):
        me = f"{folder}/{row['record_id']}"
        Path(me).touch()
        time.sleep(0.3)
        seen = len([x for x in os.listdir(folder) if not x.endswith("seen")])
        Path(f"{me}.{seen}.seen").touch()
        os.remove(me)
        return {"decision": "relevant", "confidence": 1, "reason": threading.current_thread().name}

    df = spark.range(12).selectExpr("cast(id as string) record_id")
    for cap, options in ((2, {"at_once": 2}), (3, {"at_once": 3, "tasks": 2}), (8, {})):
        got = screening.classify_stage_two(df, client, **options).collect()
        assert len(got) == 12
        seen = [int(x.split(".")[1]) for x in os.listdir(folder)]
        assert max(seen) == cap, (cap, seen)
        for x in os.listdir(folder):
            os.remove(f"{folder}/{x}")
    with pytest.raises(ValueError):
        screening.classify(df, client, at_once=0)


def test_stage_two_answers(spark):
    rows = ['{"decision": "相关", "confidence": "0.5", "missing_information": [" a ", "", 3], "evidence": "one", "reason": "r"}', '{"decision": "yes"}', "[]", '{"decision": "exclude", "confidence": -1, "exclusion_reason": "e", "missing_information": ""}', '{"decision": "relevant", "confidence": "much"}', None]
    got = screening.parse_stage_two(spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, a string"), "a").orderBy("k").collect()
    assert [(r.decision, r.confidence, r.error) for r in got] == [("relevant", 0.5, ""), ("uncertain", 0.0, "unreadable answer"), ("uncertain", 0.0, "unreadable answer"), ("irrelevant", 0.0, ""), ("uncertain", 0.0, "unreadable answer"), ("uncertain", 0.0, "unreadable answer")]
    assert got[0].missing == ["a", "3"] and got[0].evidence == ["one"] and got[3].exclusion_reason == "e" and got[3].missing == []


def test_changes_by_tag(spark):
    report = spark.createDataFrame([("r1", "DE", ["a", "b"], ["a"]), ("r2", "DE", ["x"], ["y", "z"]), ("r1", "SO", None, ["j"])], "record_key string, tag string, before array<string>, after array<string>")
    assert {tuple(r) for r in vocabulary.report_by_tag(report).collect()} == {("DE", 2, 2, 2), ("SO", 1, 0, 1)}


def test_a_plain_local_session_has_a_checkpoint_folder(tmp_path):
    code = "from quillon.session import session, checkpoint_folder; s = session(master='local[1]'); a = checkpoint_folder(s); assert a == checkpoint_folder(s); assert s.range(3).checkpoint().count() == 3"
    env = {k: v for k, v in os.environ.items() if k != "SPARK_CONF_DIR"} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(ROOT)}
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env=env, capture_output=True)
