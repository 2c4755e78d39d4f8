"""Queries against their SQL on the smallest tables, and the entry module without the optional subpackage."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from quillon.plans import catalog

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, tables, name):
    got = catalog.QUERIES[name](spark, DATA)
    expected = tables.sql(catalog.SQL[name])
    columns = sorted(got.columns)
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    assert sorted((tuple(rounded(r[c]) for c in columns) for r in got.collect()), key=repr) == sorted((tuple(rounded(r[i]) for i in at) for r in expected.fetchall()), key=repr)


DEDUPE = ["apply_exclusions", "auto_review", "dedupe_journal", "dedupe_loose", "dedupe_statistics", "dedupe_strict", "doi_conflicts", "duplicate_log", "import_stats", "preferred_record"]


@pytest.mark.parametrize("name", DEDUPE)
def test_keys_beyond_ascii_equal_sql(spark, tmp_path, name):
    """Titles that only compatibility forms or case folding make equal."""
    texts = ["Straße – 1", "STRASSE 1", "straße 1!", "Oﬃce", "office", "Café", "CAFÉ.", "x²", "x2", "№ 5", "no 5", "№5"]
    docs = [(5 * i, f"{x}\n{'same' if i % 2 else i}", "de", "web", len(x)) for i, x in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    columns = catalog.QUERIES[name](spark, str(tmp_path)).columns
    expected = con.sql(catalog.SQL[name])
    at = [expected.columns.index(c) for c in columns]
    assert sorted((tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in expected.fetchall()), key=repr)


def test_queries_without_sql_run(spark):
    for name in set(catalog.QUERIES) - set(catalog.SQL):
        assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_imports_without_the_optional_parts():
    code = "import sys; sys.modules['quillon.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'annual_trend' in e.queries() and not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
