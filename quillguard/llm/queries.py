"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .binary import token_files
from .decontaminate import contamination
from .linededup import lines_removed
from .lm import lm_scores
from .minhash import near_duplicates
from .packing import pack
from .quality import quality
from .sharding import shards
from .toxicity import learn, toxicity
from .warc import archive

#: The tokenizer of the queries; a parameter of the operators.
TOKENIZER = "word_bpe_49k.json"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scores(_read(spark, sf_dir, "documents"), _part(5) != 1)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(_read(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(_read(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_removed(_read(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def _part(modulus: int):
    """crc32 of the id as text, modulo; null ids as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = learn(docs, labels.where(_part(3) != 1))
    out = toxicity(docs, model)
    return out.select("doc_id", (_part(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "sentences")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_packing": op2_packing,
    "op3_lm": op3_lm,
    "op4_shards": op4_shards,
    "op5_warc": op5_warc,
    "op6_line_dedup": op6_line_dedup,
    "op7_token_files": op7_token_files,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
}

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op1_minhash": f"""
with recursive w as (select doc_id, list_filter(string_split_regex({_FOLD.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
    s as (select distinct doc_id, array_to_string(w[x : x + 3], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as x from w where len(w) > 0)),
    c as (select doc_id, count(*) as n from s group by doc_id),
    p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
    e as (select p.a, p.b from p join c x on x.doc_id = p.a join c y on y.doc_id = p.b where 100 * k >= 80 * (x.n + y.n - k)),
    ends as (select a, b from e union all select b, a from e),
    r(node, label) as (select doc_id, doc_id from documents union select ends.b, r.label from r join ends on r.node = ends.a),
    l as (select node, min(label) as label from r group by node)
select d.doc_id, coalesce(c.n, 0)::bigint as n_shingles, l.label as component_id, d.doc_id = l.label as kept
from documents d join l on l.node = d.doc_id left join c on c.doc_id = d.doc_id
""",
    "op4_shards": """
with d as (select doc_id, coalesce(strlen(text), 0)::bigint as n_bytes,
        ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h from documents),
    p as (select depth, h >> (60 - depth) as prefix, sum(n_bytes)::bigint as shard_bytes
        from d, (select unnest(range(0, 61))::int as depth) group by all having sum(n_bytes) <= 1048576),
    a as (select d.doc_id, d.n_bytes, p.depth, p.prefix, 0::bigint as page, p.shard_bytes from d join p on p.prefix = d.h >> (60 - p.depth)
        qualify row_number() over (partition by d.doc_id order by p.depth) = 1)
select *, max(depth) over () as global_depth, 1::bigint << (max(depth) over () - depth) as slots from a
""",
    "op8_decontamination": f"""
with b as (select item_id, regexp_extract_all({_FOLD.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
    d as (select doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
    i as (select distinct item_id, least(len(w), 13) as k, array_to_string(w[x : x + least(len(w), 13) - 1], ' ') as win
        from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as x from b where len(w) > 0)),
    o as (select doc_id, k, x, array_to_string(w[x : x + k - 1], ' ') as win
        from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as x from d, (select distinct k from i) where len(w) >= k)),
    m as (select o.doc_id, o.x, o.k, i.item_id from o join i on i.k = o.k and i.win = o.win),
    h as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(x, x + k)) as pos from m) group by doc_id),
    n as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids
        from (select distinct doc_id, item_id from m) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(h.n_hit, 0)::bigint as n_hit, coalesce(n.n_items, 0)::bigint as n_items,
    sha256(coalesce(n.ids, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 and 20 * coalesce(h.n_hit, 0) >= len(d.w) as contaminated
from d left join h using (doc_id) left join n using (doc_id)
""",
    "op5_warc": """
with p as (select page_id, url, coalesce(html, '') as html, sha256(coalesce(html, '')) as digest from pages),
    f as (select digest, min(page_id) as first from p where strlen(html) >= 100 group by digest),
    r as (select p.*, case when f.first <> page_id then f.first end as refers_to from p left join f using (digest)),
    u as (select *, array_to_string(list_reverse(string_split(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www[.]', ''), '.')), ',') as host,
        lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) as path, lower(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1)) as query from r),
    k as (select *, host || ')' || case when path = '' then '/' else path end || case when query = '' then '' else '?' || array_to_string(list_sort(string_split(query, '&')), '&') end as url_key,
        strftime(timestamp '2024-01-01' + to_seconds(page_id % 4294967296), '%Y-%m-%dT%H:%M:%SZ') as captured from u)
select page_id, strlen(html)::bigint as payload_bytes, digest as payload_digest,
    case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to, url_key, captured,
    row_number() over (order by url_key, captured, page_id) - 1 as position
from k
""",
    "op10_quality": f"""
with d as (select doc_id, coalesce(source, '') as host, coalesce(text, '') as text from documents),
    w as (select doc_id, host, text, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from d),
    l as (select doc_id, host, text, line, list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as lw
        from (select doc_id, host, text, unnest(string_split(text, chr(10))) as line from d)),
    f as (select doc_id, host, text, line, len(lw) as n, {_FOLD.format("array_to_string(lw, ' ')")} as norm from l where len(lw) > 0),
    hosts as (select host, count(distinct doc_id) as docs from d group by host),
    often as (select host, norm from f join hosts using (host)
        group by host, norm having count(distinct doc_id) > 20 and count(distinct doc_id) > 0.01 * any_value(docs)),
    lost as (select doc_id, sum(n) as lost from f join often using (host, norm) group by doc_id),
    dup as (select doc_id, count(*) - count(distinct line) as n from f group by doc_id),
    t as (select doc_id, x, md5(w[x] || ' ' || w[x + 1] || ' ' || w[x + 2]) as t from (select doc_id, w, unnest(range(1, len(w) - 1)) as x from w)),
    r as (select doc_id, x from t qualify count(*) over (partition by doc_id, t) > 1),
    hit as (select doc_id, count(distinct p) as n from (select doc_id, unnest([x, x + 1, x + 2]) as p from r) group by doc_id)
select w.doc_id, len(w.w)::bigint as n_words, coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0)::bigint as word_chars,
    (length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(hit.n, 0)::bigint as n_repeat_words,
    len(w.w) < 50 or 100 * coalesce(hit.n, 0) > 50 * len(w.w) as base_failed,
    not (len(w.w) < 50 or 100 * coalesce(hit.n, 0) > 50 * len(w.w)) and coalesce(lost.lost, 0) <= 0.7 * len(w.w) as kept,
    coalesce(lost.lost, 0)::bigint as lost_words
from w left join dup using (doc_id) left join hit using (doc_id) left join lost using (doc_id)
""",
}
