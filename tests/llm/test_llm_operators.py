"""The operators against the libraries they follow, or brute force, on small tables with odd rows."""

import hashlib
import io
import os
import random
import re
import time
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("quillon.llm.queries")
import public_tokenizers  # noqa: E402
import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from quillon.llm import _chunks, _shared, jaccard_join, language_id, line_dedup, media, merkle, packing, pii, sp_codec, token_counts, warc_zip  # noqa: E402

TEXTS = [None, "", " ", "it's they're 'd", "a <|endoftext|> b<|startoftext|>", "x" * 5000, "naïve café É\n\n  two", "日本語 text 😀", "tab\tand\x0bstrange\x1cspaces ", "Same text here. " * 40, "Same text here. " * 40, "a   b \n \n c"]
SCHEMA = "doc_id long, text string, n_tokens string, id string, spans int"


def table(spark, texts=TEXTS):
    """The texts with columns whose names clash with the operators' own, a null id and a repeated row."""
    rows = [(i, t, "clash", "clash", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "null id", None, None, None), rows[-1]], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(rows):
    return {r.doc_id: r for r in rows}


ALPHABETS = ["abcdefg hijklmnop", "eaeiotns  \n", "éüß ñabc.,;:!?'\"()_", "日本語 한국 😀🎉abc", "aaa   ", "\t\x00\x0b▁ x", "0123456789-+.@", "ñéΣσς²½ﬁ", " 's 't <|>"]


def fuzz(n, seed, most=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(rng.choice(ALPHABETS)) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("name, fine, coarse", [("word_bpe_49k.json", _chunks.WORDS_FINE, _chunks.WORDS_COARSE), ("byte_bpe_50k.json", _chunks.SPACED_FINE, _chunks.SPACED_COARSE)])
def test_chunks_never_cut_a_token(name, fine, coarse):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    for text in [*fuzz(3000, 1), *(t for t in TEXTS if t)]:
        whole = tok.encode(text, add_special_tokens=False).ids
        assert whole == [i for c in _chunks.split(text, fine, coarse) for i in tok.encode(c, add_special_tokens=False).ids], text


def test_cache_keeps_answers_when_full():
    cache = _chunks.Cache(lambda ps: [p.upper() for p in ps], most=10, longest=3)
    for n in range(50):
        assert cache.of([f"k{n % 13}", "long one", f"k{n % 7}"]) == [f"K{n % 13}", "LONG ONE", f"K{n % 7}"]


def test_token_counts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = token_counts.token_counts(table(spark), path, limit=100, table_size=3)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and got.count() == len(TEXTS) + 2
    for i, r in by_id(got.collect()).items():
        text = "null id" if i is None else TEXTS[i] or ""
        n = len(tok.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 100)
    assert token_counts.token_counts(empty(spark), path).count() == 0


def test_token_counts_of_repeated_texts_with_newlines(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = ["Page 1\n\x0c", "a\n\u00a0b"] * 40 + ["the internationalisation of antidisestablishmentarianism 12345"] * 6 + ["", "日本語\n\u3000"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, path).collect()}
    assert got == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_prefix_table_equals_the_library():
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), sp_codec.prefix_table(path)
    rng = random.Random(2)
    pieces = [lib.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    for text in [*fuzz(4000, 3), *("".join(rng.choice(pieces) for _ in range(rng.randint(1, 8))) for _ in range(4000))]:
        ids = lib.encode(text)
        assert own.encode(text) == ids and own.decode(ids).decode() == lib.decode(ids), text
    for _ in range(2000):
        ids = [rng.randint(0, 31999) if rng.random() < 0.5 else rng.randint(0, 262) for _ in range(rng.randint(0, 12))]
        assert own.decode(ids).decode() == lib.decode(ids), ids


def test_sp_codec(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sp_codec.sp_encode(table(spark), path)
    assert got.count() == len(TEXTS) + 2
    for i, r in by_id(got.collect()).items():
        ids = lib.encode("null id" if i is None else TEXTS[i] or "")
        assert (list(r.ids), r.n_tokens, r.decoded) == (ids, len(ids), lib.decode(ids))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    again = sp_codec.sp_decode(got.select("doc_id", "ids"), path)
    assert sorted(r.decoded for r in again.collect()) == sorted(r.decoded for r in got.collect())
    assert sp_codec.sp_encode(empty(spark), path).count() == 0


PAGES = "page_id long, url string, html string, payload_digest string, type string"


def test_warc_round_trip(spark):
    big = "é" * 600
    htmls = [None, "", "small", "small", big, big, big, "x" * 999, "x" * 999, "y" * 1000, "y" * 1000]
    rows = [(i, f"http://h/{i} \r\nx", h, "clash", "clash") for i, h in enumerate(htmls)]
    got = warc_zip.warc_round_trip(spark.createDataFrame([*rows, (None, None, big, None, None)], PAGES)).collect()
    assert len(got) == len(htmls) + 1
    for r in got:
        payload = (big if r.page_id is None else htmls[r.page_id] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        first = {4: 6, 5: 6, 9: 10}.get(r.page_id)
        assert (r.record_type, r.refers_to) == (("response", None) if first is None else ("revisit", first))
    assert warc_zip.warc_round_trip(spark.createDataFrame([], PAGES)).count() == 0


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


@pytest.mark.parametrize("limit", [None, 0])
def test_zip_and_zip64_directories(limit, monkeypatch):
    if limit is not None:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", limit)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("first", b"abc" * 10)
        z.writestr("dir/second", b"defg")
        z.writestr("packed", b"h" * 100, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"a comment PK"
    data = out.getvalue()
    assert limit is None or b"PK\6\6" in data
    at, n = warc_zip.member_range(Bytes(data), len(data), "dir/second")
    assert data[at : at + n] == b"defg"
    with pytest.raises(ValueError):
        warc_zip.member_range(Bytes(data), len(data), "packed")
    with pytest.raises(KeyError):
        warc_zip.member_range(Bytes(data), len(data), "none")


def brute_lines(rows, words):
    rows = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    runs, first, gone = [], {}, {}
    for i, t in rows:
        s = [(n, x) for n, x in enumerate(t.split("\n")) if x.strip(" \t\r\f")]
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                run = tuple(x for _, x in s[a:b])
                if sum(len(x.split()) for x in run) >= words:
                    first.setdefault(run, (i, a))
                    runs.append((i, a, run, [n for n, _ in s[a:b]]))
    for i, a, run, lines in runs:
        if first[run] != (i, a):
            gone.setdefault(i, set()).update(lines)
    out = {}
    for i, t in rows:
        kept = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, ()))
        out[i] = (kept if kept.strip(" \t\r\f\n") or not gone.get(i) else "", len(gone.get(i, ())))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    pool = ["a", "b b", "c c c", "d d d d", "e e e e e", "f", "g g", "", "h h h h h h", " "]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.8 else f"u{rng.random()}" for _ in range(rng.randint(0, 14)))) for i in range(60)]
    rows += [(None, rows[3][1]), (100, None), (101, ""), (102, rows[5][1])]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in [*rows, rows[7]]], "doc_id long, text string, n_lines int, k string")
    got = line_dedup.dedup_lines(df, min_words=5)
    assert set(got.columns) == {"doc_id", "text", "k", "n_lines", "n_deleted", "deleted"} and got.count() == len(rows) + 1
    expected = brute_lines(rows, 5)
    for r in got.collect():
        assert ((r.text or ""), r.n_deleted) == expected[r.doc_id], r.doc_id
    assert got.where("doc_id = 100").first().text is None
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_merkle(spark):
    got = merkle.edit_probe(table(spark)).collect()
    assert len(got) == len(TEXTS) + 2
    order = [(None, "null id"), *enumerate(TEXTS), (len(TEXTS) - 1, TEXTS[-1])]
    follower = {i: order[(k + 1) % len(order)][1] or "" for k, (i, _) in enumerate(order)}
    prints = {}
    for r in got:
        text = "null id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        k = len(text) // 4
        assert r.n_chars == len(text) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id != len(TEXTS) - 1:  # the repeated row is its own next
            assert r.edited_sha256 == hashlib.sha256((text[: len(text) - k] + follower[r.doc_id][:k]).encode()).hexdigest()
        prints.setdefault(text, set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in prints.values()) and len({f for v in prints.values() for f in v}) == len(prints)
    assert merkle.edit_probe(empty(spark)).count() == 0


def brute_tree(text):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    paragraphs = []
    for p in text.split("\n"):
        leaves = [h(x) for x in re.findall(r"(?:[^ \t\n\x0b\f\r]+[ \t\n\x0b\f\r]*){1,4}|[ \t\n\x0b\f\r]+", p)]
        paragraphs.append((h("p" + "".join(leaves)), leaves))
    sections = [paragraphs[k : k + 8] for k in range(0, len(paragraphs), 8)]
    digests = [h("s" + "".join(d for d, _ in s)) for s in sections]
    return h("r" + "".join(digests)), list(zip(digests, sections))


def written(tree):
    return tree[0] + "/" + ";".join(f"{d[:8]}:" + ",".join(f"{p[:8]}:" + "".join(x[:8] for x in leaves) for p, leaves in s) for d, s in tree[1])


def brute_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    sa, sb = ({d: s for d, s in t[1]} for t in (a, b))
    common = set(sa) & set(sb)
    n = sum(len(x) for d in common for _, x in sa[d])
    pa, pb = ({p: x for d, s in t.items() if d not in common for p, x in s} for t in (sa, sb))
    n += sum(len(pa[p]) for p in set(pa) & set(pb))
    la, lb = ({y for p, x in u.items() if p not in v for y in x} for u, v in ((pa, pb), (pb, pa)))
    return min(2 * (len(la & lb) + n) / (2 * n + len(la) + len(lb) + 1e-9), 1 - 1e-6)


def test_merkle_equals_a_tree_in_python(spark):
    rng = random.Random(12)
    words = ["a", "b", "cc", "é", "日本", "", " ", "\t"]
    pool = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(12)]
    texts = [*TEXTS[1:8], *("\n".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(60))]
    pairs = [(a, b) for a, b in zip(texts, texts[1:])] + [(t, t) for t in texts[:3]]
    df = spark.createDataFrame(pairs, "x string, y string").select("x", "y", merkle.fingerprint("x").alias("a"), merkle.fingerprint("y").alias("b"))
    for r in df.select("*", merkle.likeness("a", "b").alias("l"), merkle.edits("a", "b").alias("e")).collect():
        a, b = brute_tree(r.x), brute_tree(r.y)
        assert (r.a, r.b) == (written(a), written(b)), r.x
        assert abs(r.l - brute_likeness(a, b)) < 1e-9
        own, other = ([p for _, s in t[1] for p, _ in s] for t in (a, b))
        get = lambda s, k: s[k] if k < len(s) else None
        assert [tuple(e) for e in r.e] == [(k // 8, k) for k in range(max(len(own), len(other))) if get(own, k) != get(other, k)]


def test_merkle_edits(spark):
    lines = [f"line {i} of some words" for i in range(30)]
    other = [*lines[:13], "changed", *lines[14:]]
    df = spark.createDataFrame([("\n".join(lines), "\n".join(other)), ("same", "same")], "x string, y string")
    got = df.select(merkle.fingerprint("x").alias("a"), merkle.fingerprint("y").alias("b")).select(merkle.edits("a", "b").alias("e"), merkle.likeness("a", "b").alias("l")).collect()
    assert [tuple(x) for x in got[0].e] == [(1, 13)] and 0.8 < got[0].l < 1
    assert got[1].e == [] and got[1].l == 1
    with pytest.raises(TypeError, match="numbers"):
        merkle.edit_probe(spark.createDataFrame([("k", "t")], "doc_id string, text string"))
    odd = merkle.fingerprints(spark.createDataFrame([(None, None), (1, None), (1, None)], "doc_id long, text string")).collect()
    assert len(odd) == 3 and len({r.fingerprint for r in odd}) == 1


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_groups(rows, t=80):
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").encode().lower())
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= t * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def jaccard_rows(seed, n, base_n, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 150))] for _ in range(base_n)]
    rows = []
    for i in range(n):
        b = list(rng.choice(base)) if rng.random() < 0.9 else [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, edits)):
            if b:
                k = rng.randrange(len(b))
                b[k : k + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
        rows.append((i, " ".join(b).upper() if rng.random() < 0.1 else "\n".join(b)))
    return rows + [(5000, None), (5001, ""), (5002, " \n"), (5003, "a b"), (5004, "A b"), (5005, "a b c")]


@pytest.mark.parametrize("block", [(256, 512, 8192), (6, 12, 24)])
def test_jaccard_join_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block[0])
    monkeypatch.setattr(jaccard_join, "CELL", block[1])
    monkeypatch.setattr(jaccard_join, "WINDOWED", block[2])
    monkeypatch.setattr(jaccard_join, "PIVOTS", 4)
    rows = jaccard_rows(5, 300, 20, 7)
    got = jaccard_join.jaccard_components(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int").repartition(3))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_groups(rows)


@pytest.mark.parametrize("block", [(256, 512, 8192), (6, 12, 24)])
def test_jaccard_links_are_all_links(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block[0])
    monkeypatch.setattr(jaccard_join, "CELL", block[1])
    monkeypatch.setattr(jaccard_join, "WINDOWED", block[2])
    monkeypatch.setattr(jaccard_join, "PIVOTS", 4)
    rows = jaccard_rows(5, 300, 6, 5)
    members, links = jaccard_join.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    members, links = {r.doc_id: r.cls for r in members.collect()}, [(r.a, r.b) for r in links.collect()]
    assert len(links) == len(set(links)) and all(a < b for a, b in links)
    sets = {i: set(jaccard_join.shingles(t or "").tolist()) for i, t in rows}
    expected = {(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    known = set(links)
    got = {(a, b) for a in sets for b in sets if a < b and members[a] is not None and (members[a] == members[b] or tuple(sorted((members[a], members[b]), key=lambda c: (c is None, c))) in known)}
    assert got == expected and len(links) > len(set(members.values()))


@pytest.mark.parametrize("every", [False, True])
def test_jaccard_join_is_the_same_where_ids_are_not_broadcast(spark, every, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    rows = [(None if i % 7 == 3 else i, t) for i, t in jaccard_rows(5, 300, 20, 7)]
    docs = spark.createDataFrame([*rows, *rows[:40]], "doc_id long, text string").repartition(3)
    if every:
        links = sorted((r.a, r.b) for r in jaccard_join.jaccard_links(docs)[1].collect())
        monkeypatch.undo()
        assert links == sorted((r.a, r.b) for r in jaccard_join.jaccard_links(docs)[1].collect()) and links
    else:
        got = sorted(map(repr, jaccard_join.jaccard_components(docs).collect()))
        monkeypatch.undo()
        assert got == sorted(map(repr, jaccard_join.jaccard_components(docs).collect()))


def near_copies(n, copies, seed=11):
    """Texts of long and short words, each with near copies."""
    rng = random.Random(seed)
    vocabulary = [hashlib.md5(b"%d" % k).hexdigest()[: 1 + k % 9] for k in range(4000)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(300)) for _ in range(n)]
    return [(k * n + i, f"copy{k} {text}" if k else text) for i, text in enumerate(base) for k in range(copies)]


def test_jaccard_join_of_near_copies_writes_less_than_the_texts(spark, monkeypatch):
    rows, sizes = near_copies(40, 5), {}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def stored(df, name, f=jaccard_join.stored):
        out = f(df, name)
        folder = out.stored_at.removeprefix("file://")
        sizes[name] = sum(os.path.getsize(os.path.join(folder, x)) for x in os.listdir(folder) if x.endswith(".parquet"))
        return out

    monkeypatch.setattr(jaccard_join, "stored", stored)
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()} == {i: i % 40 for i, _ in rows}
    assert 4 * max(sizes.values()) < sum(len(t) for _, t in rows)  # the sets have 8 bytes a shingle, more than the texts


def test_long_shingles_come_first():
    text = "a b c d e f g h longest11 of12 these13 words14 here15 i j k"
    s, lengths = jaccard_join.measured_shingles(text)
    assert (s == jaccard_join.shingles(text)).all() and lengths.max() == len("longest11of12these13words14here15") and lengths.min() == 5
    none = np.zeros(0, np.uint64)
    first, _ = jaccard_join.leading(s, 1, none, np.zeros(0, np.int64), lengths)
    assert first.tolist() == jaccard_join.shingles("longest11 of12 these13 words14 here15").tolist()
    for short in ("", "a", "a b c", "a b c d e", "a a a a a a a"):
        s, lengths = jaccard_join.measured_shingles(short)
        assert len(s) == len(lengths) and (s == jaccard_join.shingles(short)).all()


def test_stored_tables_leave_no_shuffle_files(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {x for x in found if "/shuffle_" in x}

    before, kept = files(), spark.conf.get(_shared.CLEANUP, None)
    out = _shared.stored(spark.range(10_000).selectExpr("id % 97 as k").repartition(5, "k").groupBy("k").count(), "counted")
    for _ in range(50):  # deleted by another thread
        if not (left := files() - before):
            break
        time.sleep(0.2)
    assert not left and out.count() == 97 and spark.conf.get(_shared.CLEANUP, None) == kept


def test_jaccard_join_of_unrelated_texts_with_one_template(spark, monkeypatch):
    for name, value in (("BLOCK", 6), ("CELL", 12), ("WINDOWED", 24), ("PIVOTS", 4), ("OFTEN", 1)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(9)
    made = []
    monkeypatch.setattr(jaccard_join, "_by_second", lambda *a, f=jaccard_join._by_second: made.append(1) or f(*a))
    line = lambda k: " ".join(f"l{k}w{j}" for j in range(24))
    pool = [line(k) for k in range(40)]
    rows = [(i, "\n".join(rng.sample(pool, 6))) for i in range(420)]  # makes the lines of the pool more frequent than line 99
    rows += [(1000 + i, line(99) + "\n" + "\n".join(rng.sample(pool, 5))) for i in range(40)]  # of it and nothing else in common
    rows += [(2000 + i, f"{t}\none word more") for i, t in rows[-10:]]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_groups(rows) and made


def test_jaccard_cells_by_a_second_shingle_keep_every_link(spark):
    rng = np.random.default_rng(4)
    common = np.array([5], np.uint64)
    sets = {}
    for c in range(1, 90):
        s = rng.integers(10, 2**62, 20, dtype=np.uint64) if c % 3 else sets[c - 1][rng.random(len(sets[c - 1])) < 0.93]
        sets[c] = np.unique(np.append(s, common))
    shared = spark.sparkContext.broadcast(np.array([(5, 1, 0)], dtype=[("s", np.uint64), ("rank", np.int64), ("p", np.int64)]))
    cells = spark.createDataFrame([(7, c) for c in sets], "cell long, cls long")
    table = spark.createDataFrame([(c, s.tobytes()) for c, s in sets.items()], "cls long, set binary")
    groups = {}
    for r in jaccard_join._by_second(cells, table, shared, 80).collect():
        groups.setdefault(r.cell, set()).add(r.cls)
    met = {(a, b) for own in groups.values() for a in own for b in own if a < b}
    linked = {(a, b) for a in sets for b in sets if a < b and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert linked and linked <= met and max(map(len, groups.values())) < 10


def test_jaccard_keys_that_meet_are_made_anew(spark):
    rows = [(i, t) for i, t in jaccard_rows(3, 120, 12, 5)]
    docs = spark.createDataFrame([(i, t or "") for i, t in rows], "id long, text string")
    found, classes, keys = jaccard_join._classes(docs, bits=10)
    assert keys.taken
    sets = {i: jaccard_join.shingles(t or "").tobytes() for i, t in rows}
    own = {r.id: r.cls for r in found.where("n is not null").collect()}
    assert all((own[a] == own[b]) == (sets[a] == sets[b]) for a in sets for b in sets)


def test_jaccard_null_ids_meet_only_their_own_text(spark):
    rows = [(None if i % 2 else i, t) for i, t in jaccard_rows(7, 200, 10, 4)]
    docs = spark.createDataFrame([(r[0], r[1], k) for k, r in enumerate(rows)], "doc_id long, text string, k long")
    groups = brute_groups([(k, t) for k, (_, t) in enumerate(rows)])
    least = {}
    for k, (_, root) in groups.items():
        least.setdefault(root, []).append(rows[k][0])
    expected = sorted(((rows[k][0], n, min((x for x in least[root] if x is not None), default=None)) for k, (n, root) in groups.items()), key=repr)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()), key=repr)
    assert [(a, n, c) for a, n, c in got if n] == [(a, n, c) for a, n, c in expected if n]


@pytest.mark.parametrize("few", [True, False])
def test_near_duplicate_stage_shuffles_the_documents_once_at_most(spark, few, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 500_000 if few else 0)
    rows = near_copies(20, 3)
    docs = spark.createDataFrame([*rows, rows[0], (rows[0][0], "other text of an id"), (None, rows[1][1]), (None, "a null id"), (None, "a null id")], "doc_id long, text string").repartition(3)
    docs = corpus_pipeline.stored(docs, "docs")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.near_duplicates(spark, docs, "")
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    firsts = [(i, t) for i, t in rows if i < 20]
    assert got == sorted([*firsts, (rows[0][0], "other text of an id"), (None, rows[1][1]), (None, "a null id")], key=repr)  # null ids stay as one of them has no copy
    assert ("BroadcastHashJoin" in plan) == few and ("SortMergeJoin" in plan) != few


def test_jaccard_region_recursion_gives_every_link():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**62, 200, dtype=np.uint64)
    sets = []
    for _ in range(150):
        s = base.copy()
        k = rng.integers(0, 40)
        s[rng.choice(200, k, replace=False)] = rng.integers(0, 2**62, k, dtype=np.uint64)
        sets.append(np.unique(s))
    region = jaccard_join.Region(sets, 80, True)
    region.join(np.arange(len(sets)))
    both = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a in range(len(sets)) for b in range(a + 1, len(sets))}
    assert {tuple(sorted(x)) for x in region.links.made} == {(a, b) for (a, b), n in both.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)}


def test_jaccard_region_recursion_is_exact():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**62, 200, dtype=np.uint64)
    sets = []
    for _ in range(150):
        s = base.copy()
        k = rng.integers(0, 60)
        s[rng.choice(200, k, replace=False)] = rng.integers(0, 2**62, k, dtype=np.uint64)
        sets.append(np.unique(s))
    region = jaccard_join.Region(sets, 80)
    region.join(np.arange(len(sets)))
    expected = jaccard_join.Links(len(sets))
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            n = len(np.intersect1d(sets[a], sets[b]))
            if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                expected.link(a, b)
    roots = lambda u: [u.root(k) for k in range(len(sets))]
    assert roots(region.links) == roots(expected) and len(set(roots(expected))) > 1


def test_jaccard_edges(spark):
    assert jaccard_join.jaccard_components(empty(spark)).count() == 0
    got = jaccard_join.jaccard_components(table(spark)).collect()
    assert len(got) == len(TEXTS) + 2 and by_id(got)[10].component_id == 9 and by_id(got)[None].component_id is None


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.cls: r.label for r in jaccard_join.components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_language_id(spark):
    rng = random.Random(7)
    words = {"aa": ["the", "and", "with", "thing"], "bb": ["der", "und", "mit", "straße"], "cc": ["le", "été", "avec", "que"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 60))), lang) for i, lang in enumerate(rng.choice(list(words)) for _ in range(400))]
    df = spark.createDataFrame([(i, t, None if i % 10 == 0 else lang, "clash") for i, t, lang in rows], "doc_id long, text string, lang string, score string")
    held = language_id.held_out("doc_id")
    model = language_id.fit_language_model(df.where(~held), per_language=60)
    assert (model.weights == 0).mean() > 0.9  # sparse
    odd = spark.createDataFrame([(-1, None, None, None), (-2, "", None, None), (-3, "12 !? ²", None, None)], df.schema)
    got = {r.doc_id: r for r in language_id.predict_language(df.union(odd), model).collect()}
    assert all((got[k].lang_pred, got[k].score) == ("und", 0.0) for k in (-1, -2, -3)) and len(got) == 403
    out = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i].lang_pred == lang for i, lang in out) >= 0.97 * len(out) and all(0 <= r.score <= 1 for r in got.values())
    assert language_id.fit_language_model(df.limit(0)) is None
    assert {r.lang_pred for r in language_id.predict_language(df, None).collect()} == {"und"}


def test_language_id_odd_rows(spark):
    rows = [(None, "the and with thing", "aa")] * 500 + [(1, "der und mit straße", "bb")] * 500 + [(k, f"le été avec que {chr(97 + k % 26)}", "cc") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    model = language_id.fit_language_model(df, per_language=20)
    real = language_id.train
    try:  # equal rows teach once, also those without an id; a language never has more than twice the bound
        language_id.train = lambda found: seen.append(found) or real(found)
        language_id.fit_language_model(df, per_language=20)
    finally:
        language_id.train = real
    languages = [r[0] for r in seen[0]]
    assert languages.count("aa") <= 1 and languages.count("bb") <= 1 and 0 < languages.count("cc") <= 40
    clash = df.select("*", df.doc_id.alias("lang_pred")).withColumnRenamed("lang", "score")
    got = language_id.with_language(clash, model)
    assert set(got.columns) == {"doc_id", "text", "lang_pred", "score"} and got.count() == len(rows) and dict(got.dtypes)["score"] == "double"
    assert language_id.predict_language(empty(spark), model).count() == 0
    assert len(language_id.predict_language(df, model).where("doc_id is null").collect()) == 500


def test_grams_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(13)
    text = "".join(rng.choice("ab c1é  日") for _ in range(3000))
    whole = sorted(np.concatenate(list(language_id.grams(text))).tolist())
    for block in (1, 2, 3, 7, 1000):
        monkeypatch.setattr(language_id, "_BLOCK", block)
        assert sorted(np.concatenate(list(language_id.grams(text))).tolist()) == whole


def test_language_id_refuses_what_it_would_not_learn(spark):
    df = spark.range(1001).selectExpr("id as doc_id", "'' as text", "concat('l', id) as lang")
    with pytest.raises(ValueError, match="1000 languages"):
        language_id.fit_language_model(df)
    assert language_id.fit_language_model(df.where("doc_id < 1000")) is None  # no letters


def test_frequent_pre_tokens_of_a_sample(spark):
    rows = spark.createDataFrame([(f"common words {'rare' if k == 3 else 'often'} {k}",) for k in range(400)], "text string")
    whole, some = token_counts.frequent_pre_tokens(rows, 10), token_counts.frequent_pre_tokens(rows, 10, sample=40)
    assert set(whole) == {"common", "words", "often"} and set(some) <= set(whole) and "common" in some


def long_text(n):
    return " ".join(f"word{k % 977}" for k in range(n)) + "\n" + "no spaces" * n


def test_very_long_texts(spark, tmp_path):
    docs = spark.createDataFrame([(1, long_text(60_000)), (2, "short"), (3, long_text(60_000)), (4, long_text(60_000) + " more")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 1}
    assert {r.doc_id: r.n_deleted for r in line_dedup.dedup_lines(docs).collect()} == {1: 0, 2: 0, 3: 2, 4: 1}
    pieces = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048, search=0).collect()
    assert len({r.doc_id for r in pieces}) == 4 and all(r.length == 2048 for r in pieces if r.piece)
    pages = docs.selectExpr("doc_id page_id", "'u' url", "text html")
    got = {r.page_id: r for r in warc_zip.warc_round_trip(pages).collect()}
    assert got[1].payload_bytes == len(long_text(60_000)) and (got[1].record_type, got[1].refers_to) == ("revisit", 3)
    stored = {r.doc_id: r for r in media.media_columns(docs, directory=f"file://{tmp_path}/long").collect()}
    assert stored[1].media_sha256 == stored[3].media_sha256 != stored[4].media_sha256 and stored[1].n_bytes == len(long_text(60_000))


def test_packing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = packing.pack_documents(table(spark, TEXTS + fuzz(200, 8, 300)), path, 64, keep_ids=True)
    rows, texts = got.collect(), TEXTS + fuzz(200, 8, 300)
    places, pieces = {}, {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 64
    for i, text in enumerate(texts[:-1]):
        ids, own = [*tok.encode(text or "", add_special_tokens=False).ids, 0], sorted(pieces[i], key=lambda r: r.piece)
        assert [x for r in own for x in r.ids] == ids and [r.piece for r in own] == list(range(len(own)))
        assert all(r.length == 64 for r in own[1:]) and own[0].start == 0
    assert len(places) <= 1.02 * sum(r.length for r in rows) / 64 + 1
    assert packing.pack_documents(empty(spark), path).count() == 0


def used_up(packing_, capacity):
    used = {}
    for items, times in packing_:
        assert sum(items) <= capacity and times > 0
        for n in items:
            used[n] = used.get(n, 0) + times
    return used


def test_fillings_use_up_every_item():
    rng = random.Random(9)
    for _ in range(30):
        histogram = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(rng.randint(1, 40))}
        for found in (packing.best_fit(histogram, 100), packing.least_waste(histogram, 100), packing.fillings(histogram, 100, 2000)):
            assert used_up(found, 100) == histogram and sum(n for _, n in found) >= packing.lower_bound(histogram, 100)
    assert packing.best_filling(10, [3, 5, 7], {3: 1, 5: 1, 7: 1}) in ([7, 3],)  # best fit alone finds it
    assert sorted(packing.best_filling(12, [4, 6, 7], {4: 3, 6: 2, 7: 1})) in ([4, 4, 4], [6, 6])  # 7 first would waste 1
    assert packing.fillings({}, 100) == []


def optimum(items, capacity):
    best, bins = [len(items)], []

    def go(k):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for space in set(bins):
            if space >= items[k]:
                i = bins.index(space)
                bins[i] -= items[k]
                go(k + 1)
                bins[i] += items[k]
        bins.append(capacity - items[k])
        go(k + 1)
        bins.pop()

    go(0)
    return best[0]


def test_fillings_are_as_few_as_brute_force_finds():
    rng = random.Random(3)
    for _ in range(400):
        capacity = rng.choice([10, 20, 37, 100])
        items = sorted((rng.randint(1, capacity) if rng.random() < 0.4 else rng.randint(max(1, capacity // 6), capacity // 2 + 1) for _ in range(rng.randint(1, 11))), reverse=True)
        histogram = {n: items.count(n) for n in items}
        found, least = packing.fillings(histogram, capacity), optimum(items, capacity)
        assert used_up(found, capacity) == histogram and packing.lower_bound(histogram, capacity) <= least
        assert sum(n for _, n in found) == least, (capacity, items)


@pytest.mark.parametrize("kind", ["rounds", "whole"])
def test_fillings_at_full_capacity(kind, monkeypatch):
    rng = random.Random(11)
    bounds = {"search": None, "nodes": None, "single": None} if kind == "whole" else {"single": 3}
    fewer = 0
    for _ in range(60):
        items = sorted((rng.choice([rng.randint(300, 1100), rng.randint(520, 759), rng.randint(1, 2048)]) for _ in range(rng.randint(2, 11))), reverse=True)
        histogram = {n: items.count(n) for n in items}
        found, least = packing.fillings(histogram, 2048, **bounds), optimum(items, 2048)
        assert used_up(found, 2048) == histogram
        size = sum(n for _, n in found)
        first = min(sum(n for _, n in f(histogram, 2048)) for f in (packing.best_fit, packing.least_waste))
        assert packing.report(histogram, 2048, **bounds) == {"sequences": size, "lower_bound": packing.lower_bound(histogram, 2048)}
        assert size == least if kind == "whole" else least <= size <= first
        fewer += size < first
    assert packing.fillings({700: 1}, 2048, 0, 0, 1) == [([700], 1)]


def test_rounds_look_at_all_wasteful_sequences(monkeypatch):
    rng = random.Random(5)
    looked = []
    search = packing._search
    monkeypatch.setattr(packing, "ROUND", 500)
    monkeypatch.setattr(packing, "_search", lambda h, c, best, steps: looked.append(sum(n for _, n in best)) or search(h, c, best, steps))
    histogram = dict(Counter(rng.randint(520, 759) for _ in range(400)))
    found = packing.fillings(histogram, 2048, search=3000, single=20)
    assert used_up(found, 2048) == histogram and len(looked) > 1 and all(n <= 20 for n in looked)
    looked.clear()
    few = {520: 9, 759: 9, 1300: 5}
    assert used_up(packing.fillings(few, 2048, search=None, single=2), 2048) == few


def test_the_search_beats_its_incumbents():
    histogram, capacity = {n: 1 for n in (49, 41, 34, 33, 29, 26, 26 + 75, 22, 20, 19)}, 101
    assert sum(n for _, n in packing.fillings(histogram, capacity)) == optimum(sorted(histogram, reverse=True), capacity)
    assert packing.dominated([5, 4], 1, [4, 5, 9, 10], {4: 1, 5: 1, 9: 1, 10: 1}) and not packing.dominated([5, 4], 1, [4, 5], {4: 1, 5: 1})


def test_packing_many_short_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(i, "a") for i in range(4000)] + [(4000, "a b")], "doc_id long, text string")
    got = packing.pack_documents(df, path, 2048).collect()
    assert len(got) == 4001 and len({r.sequence_id for r in got}) == 4 == -(-sum(r.length for r in got) // 2048)


def test_media(spark, tmp_path):
    got = media.media_columns(table(spark), directory=f"file://{tmp_path}/m").collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        data = ("null id" if r.doc_id is None else TEXTS[r.doc_id] or "").encode()
        payload = media.padded(data)
        assert len(payload) % 576 == 0 and (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        image = media.png(payload)
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
    assert len({tuple(r)[1:] for r in got if r.doc_id in (9, 10)}) == 1
    # small ranges, with and without the indexes, give the same members once
    whole = {(r.archive, r.offset, r.member) for r in media.read_archives(spark, f"file://{tmp_path}/m").collect()}
    assert {(r.archive, r.offset, r.member) for r in media.read_archives(spark, f"file://{tmp_path}/m", splitBytes=700, batchBytes=1).collect()} == whole
    for p in (tmp_path / "m").glob("*.idx"):
        p.unlink()
    rows = media.read_archives(spark, f"file://{tmp_path}/m", splitBytes=700).collect()
    assert {(r.archive, r.offset, r.member) for r in rows} == whole and len(rows) == len(got)
    assert media.media_columns(empty(spark)).count() == 0


def test_media_retries_a_member_by_offset(tmp_path):
    class Flaky:
        fails = 2

        def __init__(self, data):
            self.data = data

        def read_at(self, n, at):
            Flaky.fails -= 1
            if Flaky.fails >= 0:
                raise OSError("lost")
            return self.data[at : at + n]

    info = media.tarfile.TarInfo("=1.png")
    info.size = 3
    data = info.tobuf(media.tarfile.GNU_FORMAT) + b"abc"
    store = type("S", (), {"open_input_file": lambda self, path: Flaky(data)})()
    reader = media.MediaReader({"path": "x", "retries": "3"})
    assert reader.member(store, Flaky(data), "x", 0, 512, 3) == ("=1.png", b"abc")
    Flaky.fails = 99
    with pytest.raises(OSError, match="byte 0"):
        media.MediaReader({"path": "x", "retries": "1"}).member(store, Flaky(data), "x", 0, 512, 3)


def brute_pii(t):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in reversed(m[0]) if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_pii(spark):
    rng = random.Random(10)
    parts = ["a@b.c", "@", ".", "%", " ", "-", "1", "23", "456", "+1", "555", "(", "😀", "é", "a.b", "4111111111111111", "1.2.3.4", "300", "0001"]
    texts = TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + ["1 " * 3000, "a" * 100_000 + "@", "+1" + " " * 50_000]
    got = pii.find_pii(table(spark, texts)).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        base = brute_pii("null id" if r.doc_id is None else texts[r.doc_id] or "")
        joined = [f"{k}:{a}:{b}" for a, _, b, k in base]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(r.spans.split(",")) | {""} and r.n_email == sum(k == "email" for *_, k in base)
    assert pii.find_pii(empty(spark)).count() == 0


def test_pii_weak_supervision(spark):
    texts = [f'x password={"%08x" % (i * 7919)}ab{i:012x} and token = "ab{i:020x}" y {i}{i + 12345678}' for i in range(30)] + ["the ratio: something_long here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(pii.find_pii(df).collect())
    assert all(got[i].spans.count("secret:") == 2 for i in range(30)) and got[30].spans == ""
    # of two kinds of spans that no labeler tells apart, the features' words and shapes decide
    assert len(pii.train({((1, 1, 1, 1, 0), (0, 1, 0, 1, 1, 0, 1, 1, 0)): 9, ((-1, -1, 0, -1, 0), (0, 0, 0, 0, 1, 0, 0, 0, 0)): 9})) == 1 + len(pii.FEATURES)
    odds, posterior = pii.estimate({(1, 1, 1, 1, 0): 50, (-1, -1, 0, -1, 0): 50, (1, -1, 0, -1, 0): 5})
    assert posterior[1, 1, 1, 1, 0] > 0.9 and posterior[-1, -1, 0, -1, 0] < 0.1 and odds[1][1] > odds[1][-1]


def test_redact(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd, ip 1.2.3.4!", "k"), (2, None, "k"), (3, "+1 (555) 123-4567", None)], "doc_id long, text string, spans string")
    got = pii.redact(df, weights=[-9.0] + [0.0] * len(pii.FEATURES))
    assert got.columns == df.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: "mail [EMAIL], ip [IP]!", 2: None, 3: "[PHONE]"}


def test_redact_joins_overlapping_spans_and_long_texts(spark, monkeypatch):
    texts = ["password=00000000ab4111111111111111 x", "é" * 5000 + " a@b.cd " + "ü" * 9000 + " 1.2.3.4", "", " ".join(f"u{i}@h.org {i}" for i in range(3000)), "token=4111111111111111zz"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    everything = [9.0] + [0.0] * len(pii.FEATURES)  # every candidate counts
    got = {r.doc_id: r.text for r in pii.redact(df, weights=everything).collect()}
    spans = {r.doc_id: r.spans for r in pii.with_spans(df, everything).select("doc_id", "spans").collect()}
    for i, t in enumerate(texts):
        out, at = [], 0
        for a, e, kind in sorted((x.start, x.end, x.kind) for x in spans[i]):
            if a >= at:
                out.append(t[at:a] + f"[{kind.upper()}]")
            at = max(at, e)
        assert got[i] == "".join(out) + t[at:], i
    assert got[0] == "[SECRET] x" and "card" in {x.kind for x in spans[0]} and got[4] == "[SECRET]"


def test_pipeline_keeps_documents_of_unsure_language(spark, monkeypatch):
    import corpus_pipeline

    flat = language_id.Model(["de", "en", "es", "fr"], np.zeros((language_id.SIZE, 4), np.float32), np.zeros(4), 1.0)
    monkeypatch.setattr(language_id, "fit_language_model", lambda docs: flat)  # every text with a letter has score 1/4
    docs = spark.createDataFrame([(1, "Es is of are.", "en"), (2, "12 34", "en"), (3, None, "de"), (4, "Les fleurs und the rest", "fr"), (4, "Les fleurs und the rest", "fr")], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()) == [1, 4, 4]


def test_pipeline_stages(spark):
    import corpus_pipeline

    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("the", "and", "thing", "word", "tion") for b in ("er", "ing", "ly", "on")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [prose(60) for _ in range(30)]
    near = texts[0].split()
    near[30] = "other"
    passage = prose(60)
    texts += [" ".join(near), f"{prose(20)}\n{passage}", f"{prose(20)}\n{passage}", "12 34", None, f"write to me@here.org {prose(20)}"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        docs = corpus_pipeline.stored(out, name)
        seen[name] = docs.collect()
    ids = {k: {r.doc_id for r in v} for k, v in seen.items()}
    assert ids["language"] == set(range(len(texts))) - {33, 34} == ids["lines"]
    assert {r.doc_id: r.text for r in seen["lines"]}[32].count("\n") == 0
    assert ids["near_duplicates"] == ids["lines"] - {30} == ids["personal_data"] == ids["pack"]
    assert "[EMAIL]" in {r.doc_id: r.text for r in seen["personal_data"]}[35]
    assert all(r.n_chars == len(r.text) for r in seen["personal_data"])


def test_pipeline_on_odd_tables(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars int, _h string, _id long, n_lines int, cls string, spans string, lang_pred string, score string, id string, n string"
    more = ("h", 7, 1, "c", "s", "p", "q", "i", "n")
    prose = "the thing and the word under the bridge near the river with a long story about nothing much at all today"
    rows = [(1, prose, "en", "s", 5, *more), (1, prose, "en", "s", 5, *more), (2, None, None, None, None, *more), (3, "", "en", None, 0, *more), (None, prose + " indeed", "en", "s", 9, *more), (5, "x " * 3000, "en", "s", 6000, *more), (6, "der Fluss und die Brücke " * 9, "de", "s", 1, *more)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        kept = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.stored(stage(spark, docs, ""), name)
            if name != "pack":
                assert out.columns == docs.columns, name
                assert {r._h for r in out.collect()} <= {"h"} and {r._id for r in out.collect()} <= {7}
            docs = out
        assert (docs.count() > 0) == (kept > 0)
        if kept:
            assert {1, 5, 6} == {r.doc_id for r in docs.collect()} - {None}


def test_png_is_read_by_other_means():
    import struct

    for data in (b"", b"abc", "é日".encode() * 700):
        payload = media.padded(data)
        image = media.png(payload)
        assert image[:8] == b"\x89PNG\r\n\x1a\n"
        at, idat, header = 8, b"", None
        while at < len(image):
            n, kind = struct.unpack(">I4s", image[at : at + 8])
            body = image[at + 8 : at + 8 + n]
            assert struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
            header = body if kind == b"IHDR" else header
            idat += body if kind == b"IDAT" else b""
            at += 12 + n
        width, height, depth, colour = struct.unpack(">IIBB", header[:10])
        channels = {0: 1, 2: 3}[colour]
        raw, stride = zlib.decompress(idat), 1 + width * channels
        assert depth == 8 and len(raw) == height * stride and all(raw[k * stride] == 0 for k in range(height))
        assert b"".join(raw[k * stride + 1 : (k + 1) * stride] for k in range(height)) == payload
