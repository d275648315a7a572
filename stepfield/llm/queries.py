"""Registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, html, jaccard, mixing, packing, quality, simhash, spelling, substring, tokens, topk, urls, warc
from .common import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, most=3)
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    folder = scratch.folder("archives")
    files = scratch.keep(warc.write_warc(_table(spark, sf_dir, "pages"), folder), "files")
    return warc.read_warc(files, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    folder = scratch.folder("tokens")
    files = tokens.write_token_files(_table(spark, sf_dir, "documents"), "word_bpe_49k.json", 2, folder, scratch)
    return tokens.read_token_files(files, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.STATISTICS, "base_failed", "kept", "probability")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(_table(spark, sf_dir, "documents"), Scratch(spark)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_topk, op2_simhash, op3_warc, op4_tokens, op5_quality, op6_mixing, op7_urls, op8_html, op9_substring, op10_packing, op11_jaccard, op12_spelling, op13_divergence)
}

_FITS = "(host = '{0}' or ends_with(host, '.{0}')) and starts_with(path, '{1}')"

ORACLE_SQL: dict[str, str] = {
    "op1_topk": """
        with v as (
            select vec_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] as v from embeddings
            where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
        s as (
            select q.vec_id as query_id, c.vec_id, cast(list_sum([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)]) as bigint) as score
            from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 20 = 0),
        r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 20""",
    "op3_warc": """
        with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
        f as (select *, min(page_id) over (partition by payload_digest) as first from p)
        select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
            case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
            case when payload_bytes >= 100 and page_id <> first then first end as refers_to from f""",
    "op7_urls": f"""
        with a as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
        b as (select page_id, regexp_extract(rest, '^[^/?#]*') as h, rest from a),
        c as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
            regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') as path from b),
        d as (select *, case when {_FITS.format("example.org", "/es/")} then 'example.org/es/'
            when {_FITS.format("example.org", "/en/1")} then 'example.org/en/1'
            when {_FITS.format("org", "/")} then 'org/' when {_FITS.format("com", "/fr/")} then 'com/fr/'
            when {_FITS.format("com", "/de/")} then 'com/de/' end as rule from c)
        select page_id, host, path, rule,
            case when rule in ('example.org/es/', 'example.org/en/1', 'com/de/') then 'block' else 'allow' end as verdict from d""",
    "op9_substring": r"""
        with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        s as (select doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) as i from t),
        k as (select doc_id, i, row_number() over (partition by array_to_string(w[i : i + 19], ' ') order by doc_id, i) as nth from s),
        g as (select distinct doc_id, unnest(range(i, i + 20)) as p from k where nth > 1),
        x as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from t),
        m as (select x.doc_id, count(g.p) as n_removed, string_agg(x.word, ' ' order by x.p) filter (where g.p is null) as kept
            from x left join g on x.doc_id = g.doc_id and x.p = g.p group by x.doc_id)
        select t.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed,
            sha256(coalesce(kept, '')) as kept_sha256 from t left join m on t.doc_id = m.doc_id""",
    "op11_jaccard": r"""
        with recursive t as (select row_number() over () as r, doc_id,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        s as (select r, unnest(range(1, greatest(len(w) - 3, 2))) as i, w from t where len(w) > 0),
        d as (select distinct r, array_to_string(w[i : i + 4], ' ') as g from s),
        n as (select r, count(*) as n from d group by r),
        o as (select a.r as a, b.r as b, count(*) as o from d a join d b on a.g = b.g and a.r <> b.r group by all),
        l as (select a, b from o join n x on a = x.r join n y on b = y.r where 100 * o >= 80 * (x.n + y.n - o)),
        c as (select r, r as root from t union select l.b, c.root from c join l on c.r = l.a),
        m as (select c.r, min(t.doc_id) as component_id from c join t on c.root = t.r group by c.r)
        select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id from t left join n on t.r = n.r left join m on t.r = m.r""",
    "op13_divergence": r"""
        with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
        t as (select r, lang, source, unnest(w) as term from d),
        k as (select lang, term, count(*) as total from t group by all having count(distinct r) >= 10),
        c as (select t.lang, t.source, t.term, count(*) as n from t join k on t.lang = k.lang and t.term = k.term group by all),
        g as (select distinct lang, source from d),
        v as (select lang, count(*) as v, sum(total) as size from k group by lang),
        x as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, k.total from g join k on g.lang = k.lang
            left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
        s as (select lang, source, sum(n) as size from x group by all),
        p as (select x.lang, x.source, x.term, x.n, 1 + cast(1000000000 as hugeint) * (x.n + 2) // (s.size + 2 * v.v) as p,
            1 + cast(1000000000 as hugeint) * (total + 2) // (v.size + 2 * v.v) as q
            from x join s on x.lang = s.lang and x.source = s.source join v on x.lang = v.lang),
        f as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
            from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
        y as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(f.value, 0) as bigint) as value
            from g a join g b on a.lang = b.lang and a.source <> b.source
            left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
            union all
            select lang, source, 'term', term, cast((p - q) * (p - q) // (p + q) as bigint) from p where n > 0 and p > q),
        z as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from y)
        select * from z where part = 'pair' or rank <= 10""",
}
