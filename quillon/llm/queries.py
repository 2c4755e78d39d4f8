"""The operators' queries over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import change_applier, collocations, jaccard_join, language_id, line_dedup, media, merkle, packing, pii, sp_codec, token_counts, url_filters, warc_zip


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"))


def op3_sp_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_codec.sp_encode(_documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model"), digests_only=True)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.warc_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many went and which, and a digest of the kept text."""
    docs = _documents(spark, sf_dir)
    kept = line_dedup.dedup_lines(docs)
    lines = F.coalesce(F.expr(line_dedup.ranges("deleted")), F.lit(""))
    return kept.select("doc_id", "n_lines", "n_deleted", lines.alias("deleted_lines"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op5_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_probe(_documents(spark, sf_dir))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held = language_id.held_out("doc_id")
    model = language_id.fit_language_model(docs.where(~held))
    found = language_id.predict_language(docs, model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"), 2048)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_documents(spark, sf_dir))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_documents(spark, sf_dir))


def op11_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = spark.read.parquet(f"{sf_dir}/client_changes.parquet")
    h = change_applier.digits_crc32(F.col("change_id"))
    day = F.unix_date(F.col("valid_at").cast("date")) + 5 * (h % 4)
    batch = F.least(F.lit(10), 1 + F.floor((day - 19723) * 10 / 160))
    found = change_applier.apply_changes(changes, day, batch, keep=h % 11 != 0, batches=10)
    return found.select("change_id", "client_id", "status", "batch", "missed", "city", change_applier.cents(F.col("balance")).alias("cents"), "current")


#: The rules of op12.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filters.judge(pages, url_filters.rule_table(spark, URL_RULES))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_warc, op3_sp_codec, op4_line_dedup, op5_merkle, op6_jaccard_join, op7_language_id, op8_packing, op9_media_columns, op10_pii, op11_changes, op12_url_filters, op13_collocations)}
_PAGES = """(select page_id, encode(coalesce(html, '')) p from pages)"""
SQL: dict[str, str] = {
    "op6_jaccard_join": r"""
        with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
        s as (select doc_id, unnest(case when len(ws) >= 5 then list_distinct([array_to_string(ws[i : i + 4], ' ') for i in range(1, len(ws) - 3)]) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) sh from w),
        n as (select doc_id, count(*) n from s group by 1), h as (select sh from s group by sh having count(*) > 1), o as (select s.* from s join h using (sh)),
        p as (select a.doc_id a, b.doc_id b, count(*) i from o a join o b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
        e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 80 * (x.n + y.n - i)), g as (select a, b from e union all select b, a from e),
        c(d, r) as (select a, a from g union select c.d, g.b from c join g on g.a = c.r)
        select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(m.r, w.doc_id) as component_id from w left join n using (doc_id) left join (select d, min(r) r from c group by d) m on m.d = w.doc_id""",
    "op11_changes": r"""
        with recursive base as (select distinct * from client_changes),
        d as (select *, list_reduce([4294967295::bigint] || flatten([[ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(change_id::varchar, '')]),
            lambda a, x: case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end) crc, dense_rank() over (partition by client_id order by seq) n from base),
        h as (select *, xor(crc, 4294967295) h from d), k as (select *, (valid_at::date - date '1970-01-01') + 5 * (h % 4) as day from h where valid_at is not null and h % 11 <> 0),
        r as (select *, least(10, 1 + floor((day - 19723) * 10 / 160))::int batch from k),
        late as (select b, case when b = 11 then 1000000000 else (select max(day) from r where batch < b) end latest from range(1, 12) t(b)),
        firsts as (select client_id, batch, n, min(day) as day from r group by all),
        new as (select client_id, batch, list({'n': n, 'day': day} order by n) arrived from firsts group by all),
        st(b, client_id, nx, held, runs) as (
          select 0::bigint, client_id, 1::bigint, []::struct(n bigint, day bigint)[], []::struct(lo bigint, hi bigint, missed bigint)[] from (select distinct client_id from r)
          union all
          select b, client_id, nx, list_filter(all2, lambda x: x.n >= nx), list_concat(jumped, case when nx > nj then [{'lo': nj, 'hi': nx - 1, 'missed': 0::bigint}] else [] end)
          from (select *, nj + len(list_filter(all2, lambda x, i: x.n = nj + i - 1)) nx from (
            select *, list_sort(list_concat(rest, list_filter(coalesce(fresh, []), lambda x: x.n >= nj and not list_contains(list_transform(rest, lambda y: y.n), x.n)))) all2 from (
              select *, list_filter(held, lambda x: x.n >= nj) rest,
                list_transform(list_filter(range(1, len(done) + 1), lambda i: i = 1 or done[i] <> done[i - 1] + 1),
                  lambda i: {'lo': done[i], 'hi': done[i] + len(list_filter(range(i, len(done) + 1), lambda j: done[j] - done[i] = j - i)) - 1, 'missed': done[i] - coalesce(done[i - 1] + 1, old)}) jumped
              from (select *, list_transform(list_filter(held, lambda x: x.n < nj), lambda x: x.n) done from (
                select *, case when star is null then old else star + 1 + len(list_filter(list_filter(held, lambda x: x.n > star), lambda x, i: x.n = star + i)) end nj from (
                  select late.b, s.client_id, s.nx as old, s.held, list_max(list_transform(list_filter(s.held, lambda x: x.day + 8 <= late.latest), lambda x: x.n)) star, new.arrived as fresh
                  from st s join late on late.b = s.b + 1 left join new on new.batch = late.b and new.client_id is not distinct from s.client_id))))))),
        took as (select b, client_id, u.lo as lo, u.hi as hi, u.missed as missed from (select b, client_id, unnest(runs) u from st where b > 0)),
        firstrow as (select *, row_number() over (partition by client_id, n order by batch, day, change_id) k, max(n) over (partition by client_id) top from r),
        f as (select x.*, y.b, case when x.n = y.lo then y.missed else 0 end missed, y.b is not null and x.k = 1 as ok from firstrow x left join took y on x.client_id is not distinct from y.client_id and x.n between y.lo and y.hi),
        ap as (select change_id, last_value(case when op in ('I', 'D') or (op = 'U' and city is not null) then {'v': case when op = 'D' then null else city end} end ignore nulls) over w city,
            last_value(case when op in ('I', 'D') or (op = 'U' and balance is not null) then {'v': case when op = 'D' then null else balance end} end ignore nulls) over w balance, n = max(n) over (partition by client_id) and coalesce(op <> 'D', true) as cur
          from f where ok window w as (partition by client_id order by n rows between unbounded preceding and current row))
        select f.change_id, f.client_id, case when ok then 'applied' else 'rejected' end as status, case when ok then f.b else f.batch end::int as batch, case when ok then missed else 0 end::bigint as missed, (ap.city).v as city,
          floor(100 * (ap.balance).v + 0.5)::bigint as cents, coalesce(cur, false) as current from f left join ap using (change_id)""",
    "op12_url_filters": r"""
        with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
        p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') path from u),
        r(verdict, h, t) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        b as (select page_id, arg_max({'rule': h || t, 'verdict': verdict}, length(h || t)) b from p join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, t) group by page_id)
        select page_id, host, path, b.rule as rule, coalesce(b.verdict, 'allow') as verdict from p left join b using (page_id)""",
    "op13_collocations": r"""
        with pieces as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents),
        w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') ws from pieces), n as (select lang, sum(len(ws))::hugeint n from w group by 1),
        g as (select lang, ws[i : i + m - 1] p from w, range(1, 6) t(m), range(1, len(ws) - m + 2) s(i)), c as (select lang, p, count(*)::hugeint a from g group by all having count(*) >= 100),
        x as (select c.lang, c.p, c.a, k, l.a l, r.a r, n.n, (1000 * c.a * n.n) // (l.a * r.a) score from c join n using (lang), range(1, 5) t(k) join c l on true join c r on true
          where len(c.p) > k and l.lang = c.lang and r.lang = c.lang and l.p = c.p[1 : k] and r.p = c.p[k + 1 :]),
        best as (select * from x qualify row_number() over (partition by lang, p order by score, k) = 1),
        parts as (select lang, p[i : i + m - 1] p, a from c, range(2, 5) t(m), range(1, len(p) - m + 2) s(i) where len(p) > m), inside as (select lang, p, max(a) f from parts group by all),
        kept as (select best.*, array_to_string(best.p, ' ') phrase from best left join inside using (lang, p) where f is null or 100 * f < 100 * a)
        select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a::bigint a, l::bigint l, r::bigint r, n::bigint n, score::bigint score from kept qualify rank <= 2000""",
    "op2_warc": f"""
        with d as (select page_id, octet_length(p)::bigint n, sha1(p) h from {_PAGES}),
        k as (select *, max(page_id) over (partition by h) m, count(*) over (partition by h) c from d)
        select page_id, n as payload_bytes, h as payload_digest,
          case when n >= 1000 and page_id <> m then 'revisit' else 'response' end as record_type,
          case when n >= 1000 and page_id <> m then m end as refers_to from k""",
}
