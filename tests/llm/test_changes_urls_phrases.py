"""Changes applied in order, URL filters and collocations against brute force, on odd and skewed rows."""

import datetime as dt
import os
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import change_applier, collocations, url_filters
from quillon.llm import queries as llm_queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", ["op11_changes", "op12_url_filters", "op13_collocations"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    got, expected = llm_queries.QUERIES[name](spark, DATA), con.sql(llm_queries.SQL[name])
    at = [expected.columns.index(c) for c in sorted(got.columns)]
    assert len(at) == len(expected.columns)
    assert sorted((tuple(r[c] for c in sorted(got.columns)) for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in expected.fetchall()), key=repr)


# --- changes -------------------------------------------------------------------------------------------------------


def simulated(rows, batches, wait=8):
    """Row after row, as the docstring says. rows: (client, n, day, order, op, values, batch); result by place in `rows`."""
    state = defaultdict(lambda: {"next": 1, "held": {}, "values": (None, None)})
    out, latest, last = {}, None, {}

    def apply(client, batch, missed):
        s = state[client]
        while s["next"] in s["held"]:
            k = s["held"].pop(s["next"])
            _, _, _, _, op, values, _ = rows[k]
            old = s["values"]
            s["values"] = values if op == "I" else tuple(v if v is not None else o for v, o in zip(values, old)) if op == "U" else (None, None) if op == "D" else old
            out[k] = ("applied", batch, missed, *s["values"])
            last[client] = k
            missed = 0
            s["next"] += 1

    for batch in range(1, batches + 2):
        for client, s in state.items():
            while s["held"] and (batch > batches or min(rows[k][2] for k in s["held"].values()) + wait <= latest):
                n = min(s["held"])
                missed, s["next"] = n - s["next"], n
                apply(client, batch, missed)
        own = sorted((r[2], r[3], k) for k, r in enumerate(rows) if r[6] == batch)
        for _, _, k in own:
            client, n = rows[k][:2]
            if n < state[client]["next"] or n in state[client]["held"]:
                out[k] = ("rejected", batch, 0, None, None)
            else:
                state[client]["held"][n] = k
                apply(client, batch, 0)
        days = [r[2] for r in rows if r[6] <= batch]
        latest = max(days, default=latest)
    return {k: (*v, last.get(rows[k][0]) == k and rows[k][4] != "D") for k, v in out.items()}


@pytest.mark.parametrize("seed", range(40))
def test_wheel_equals_simulation(seed):
    rng = random.Random(seed)
    rows = []
    for k in range(rng.randrange(1, 250)):
        day = rng.randrange(60)
        rows.append((f"c{min(rng.randrange(6), rng.randrange(6))}", rng.randrange(1, 40), day, k, "U", (None, None), day // 6 + 1))
    expected = simulated(rows, 10)
    wheel, applied, seen = change_applier.Wheel(), {}, None
    for batch in range(1, 12):
        touched = set()
        latest = seen if batch < 11 else change_applier.END
        if latest is not None:
            for c in wheel.due(latest, 8):
                touched.add(c)
                applied |= {(c, n): (batch, missed * (n == lo)) for lo, hi, missed in wheel.jump(c, latest, 8) for n in range(lo, hi + 1)}
        own = [r for r in rows if r[6] == batch]
        for c in {r[0] for r in own}:
            touched.add(c)
            mine = [r for r in own if r[0] == c]
            runs = wheel.arrive(c, np.array([r[1] for r in mine]), np.array([r[2] for r in mine], np.int32))
            applied |= {(c, n): (batch, 0) for lo, hi, _ in runs for n in range(lo, hi + 1)}
        for c in touched:
            wheel.file(c)
        assert all(wheel.filed[c] == wheel.held[c][1].min() for c in wheel.held) and set(wheel.filed) == set(wheel.held)
        seen = max([r[2] for r in own], default=seen) if seen is None else max([seen, *(r[2] for r in own)])
    assert applied == {(rows[k][0], rows[k][1]): v[1:3] for k, v in expected.items() if v[0] == "applied"}


SCHEMA = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, city string, balance double, day string, `n` long, `a.b` long"


def changed(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    day = F.unix_date(F.col("valid_at").cast("date"))
    return change_applier.apply_changes(df, day, F.least(F.lit(10), 1 + F.floor((day - 19723) * 10 / 160)), change_applier.digits_crc32(F.col("change_id")) % 11 != 0, batches=10, buckets=3)


def test_changes_equal_simulation_with_a_hot_client_and_odd_rows(spark):
    rng = random.Random(3)
    rows = []
    for k in range(900):
        client = rng.choice([None, 7, 7, 7, 7, 1, 2, 3])
        at = None if rng.random() < 0.02 else dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(160))
        rows.append((k, client, rng.choice([None, *range(0, 400, 2)]), rng.choice(["I", "U", "U", "U", "D", None]), at, rng.choice([None, "x", "é" * 3000]), rng.choice([None, 1.5, -2.25]), "d", 1, 2))
    rows += rows[:50]  # repeated
    got = {r.change_id: r for r in changed(spark, rows).collect()}
    ranks = defaultdict(set)
    for r in rows:
        ranks[r[1]].add(r[2])
    order = {(c, s): k + 1 for c, own in ranks.items() for k, s in enumerate(sorted(own, key=lambda x: (x is not None, x)))}
    plain = []
    for r in rows[:900]:
        if r[4] is not None and zlib.crc32(str(r[0]).encode()) % 11:
            day = (r[4] - dt.datetime(1970, 1, 1)).days
            plain.append((r[1], order[r[1], r[2]], day, r[0], r[3], r[5:7], max(1, min(10, 1 + (day - 19723) * 10 // 160))))
    expected = simulated(plain, 10)
    assert len(got) == len(plain)
    for k, r in enumerate(plain):
        x = got[r[3]]
        assert (x.status, x.batch, x.missed, x.city, x.balance, x.current) == expected[k], r


def test_changes_of_an_empty_table(spark):
    assert changed(spark, []).collect() == []


# --- URL filters ---------------------------------------------------------------------------------------------------


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((k for k in (rest.find(c) for c in "/?#") if k >= 0), default=len(rest))
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min((k for k in (tail.find(c) for c in "?#") if k >= 0), default=len(tail))]
    fit = []
    for verdict, text in rules:
        h, slash, p = text.partition("/")
        if host and (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fit.append((len(text), len(h), verdict == "block", text, verdict))
    best = max(fit, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


def test_url_filters_equal_brute_force(spark):
    rng = random.Random(5)
    names = ["org", "com", "example.org", "a.example.org", "b.a.example.org", "xample.org", "co.uk", "x.co.uk"]
    ends = ["", "/", "/e", "/en", "/en/", "/en/1", "/en/12", "/é/ü", "/a//b", "/en/1?q", "/" + "y" * 300]
    rules = [(rng.choice(["allow", "block"]), rng.choice(names) + rng.choice([e for e in ends if "?" not in e])) for _ in range(40)] + [("block", "dup.org/"), ("allow", "dup.org/")]
    urls = [None, "", "://", "http://", "nothing", "http:///en/", "http://dup.org/x", "http://EXAMPLE.org?q=/en/1", "x://y://example.org/en/", "http://" + "a." * 20000 + "example.org/en/1" + "z" * 50000, "http://Éxample.ORG/en\n/1#f", "http://u@example.org:80/"]
    urls += [f"{rng.choice(['http', ''])}://{rng.choice(['', 'www.', 'a.b.'])}{rng.choice(names).upper()}{rng.choice(ends)}{rng.choice(['', '#x', '?y#z'])}" for _ in range(400)]
    rows = [(k if k % 9 else None, u, "clash") for k, u in enumerate(urls + urls[:100] + ["http://www.example.org/en/1"] * 300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = Counter(tuple(r) for r in url_filters.judge(pages, url_filters.rule_table(spark, rules)).collect())
    assert got == Counter((i, *judged(u, rules)) for i, u, _ in rows)


def test_url_filters_without_pages_or_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert [tuple(r) for r in url_filters.judge(pages, none, default="block").collect()] == [(1, "a.org", "/", None, "block")]
    assert url_filters.judge(pages.limit(0), url_filters.rule_table(spark, [("block", "org/")])).collect() == []
    with pytest.raises(ValueError):
        url_filters.judge(pages, url_filters.rule_table(spark, [("maybe", "org/")]))
    with pytest.raises(ValueError):
        url_filters.judge(pages, url_filters.rule_table(spark, [("block", "a." * 200 + "org/")]))


# --- collocations --------------------------------------------------------------------------------------------------


def phrases(rows, least, share, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\v\f\r":
            low = low.replace(c, ".")
        for piece in low.split("."):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            totals[lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    counts[lang][tuple(words[i : i + m])] += 1
    found = []
    for lang, own in counts.items():
        frequent = {p: a for p, a in own.items() if a >= least and len(p) > 1}
        inside = Counter()
        for p, a in frequent.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        rows = []
        for p, a in frequent.items():
            score, k = min((1000 * a * totals[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            if 100 * inside[p] < share * a:
                rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        found += [(lang, k, p.decode(), -a, left, right, totals[lang], -score) for k, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return found


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words = ["a", "B", "the", "of", "é", "Ñ", "ß", "x-y", "1", "zz", "\x01", "ünïcode"]
    rows = [(None, None), ("en", ""), ("en", " \t.. ,\n"), ("und", "a b"), ("en", "aa " * 30000)]
    for _ in range(150):
        own = [rng.choice(words[: rng.randrange(1, len(words) + 1)]) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "; ", "! "]) for _ in range(rng.randrange(1, 120))]
        rows.append((rng.choice(["en", "en", "de", None]), "".join(own)))
    return rows + [("en", "the cat sat of the x-y mat")] * 60


@pytest.mark.parametrize(("share", "top", "small"), [(100, 2000, False), (60, 7, True)])
def test_collocations_equal_brute_force(spark, texts, monkeypatch, share, top, small):
    if small:  # small shards and lots
        monkeypatch.setattr(collocations, "LOT", 50)
    docs = spark.createDataFrame([(*r, 1) for r in texts], "lang string, text string, ids long").repartition(3)
    got = [tuple(r) for r in collocations.collocations(docs, least=20, share=share, top=top).collect()]
    assert sorted(got) == sorted(phrases(texts, 20, share, top))


def test_frequent_words_and_pairs_by_joins(spark, texts):
    docs = spark.createDataFrame(texts, "lang string, text string").repartition(3)
    counted = lambda *n: sorted(tuple(r) for r in collocations.count_phrases(docs, least=20, words_sent=n[0], pairs_sent=n[1])[1].selectExpr("cast(ids as string) ids", "a").collect())
    assert counted(0, 0) == counted(0, 1 << 20) == counted(1 << 20, 0) == counted(1 << 20, 1 << 20)


def test_bitmaps_of_small_lots_equal_counts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(collocations, "LOT", 9)
    words, counts, lengths, blocks, masks = collocations.shard_bitmaps([b"a b a b a. b a", b"c\ta b c a a a a a a a a a"])
    assert isinstance(words, pa.Array) and dict(zip(words.to_pylist(), counts.tolist())) == {"a": 14, "b": 4, "c": 2}
    own = collocations.Bitmaps(np.arange(3), lengths, blocks, masks)
    got = Counter()
    for pairs, n in own.pairs():
        got.update(dict(zip(pairs.tolist(), n.tolist())))
    name = words.to_pylist()
    assert {(name[p >> 31], name[p & (1 << 31) - 1]): n for p, n in got.items()} == {("a", "b"): 3, ("b", "a"): 3, ("c", "a"): 2, ("b", "c"): 1, ("a", "a"): 8}


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_scores_are_exact(spark):
    rng = random.Random(1)
    rows = [(10**12 - 1, 3 * 10**12 * k, 3 * 10**12, 10**12) for k in range(1, 100)]
    for _ in range(300):
        n = rng.randrange(1, 10 ** rng.randrange(3, 14))
        first, rest = rng.randrange(1, n + 1), rng.randrange(1, n + 1)
        rows.append((rng.randrange(1, min(first, rest) + 1), n, first, rest))
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = df.select("*", collocations._score(*(F.col(c) for c in "anlr")).alias("s")).collect()
    assert all(r.s == 1000 * r.a * r.n // (r.l * r.r) for r in got)
