"""The queries of this package, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, katz, kdmeans, neardedup, nndescent, packing, pii, quality, shards, topk, toxicity, trie, urlrules
from ._common import settled, written


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@settled
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(_read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, finish=bpe.digests(spark, ranks))
    return coded.withColumnRenamed("id", "doc_id")


@settled
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_read(spark, sf_dir, "documents"), "text", "doc_id")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


@settled
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardedup.near_duplicates(_read(spark, sf_dir, "documents"))


@settled
def op4_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return shards.shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@settled
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", (toxicity.fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@settled
def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@settled
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(_read(spark, sf_dir, "pages"))


@settled
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality.ledger(_read(spark, sf_dir, "documents"), "text", "doc_id")
    led = quality.apply_policy(led, "v1", "kept")
    base = F.col("failed_bits").bitwiseAND(F.lit(quality.mask("base"))) != 0
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed_bits"
    )


@settled
def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the newest policy costs, from the stored ledger by its bits alone."""
    led, _ = written(quality.ledger(_read(spark, sf_dir, "documents"), "text", "doc_id"), "ledger")
    return quality.ablation(led, "v1")


@settled
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@settled
def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(_read(spark, sf_dir, "documents"), _not_one).select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@settled
def op11_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_links(_read(spark, sf_dir, "embeddings"))


@settled
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(_read(spark, sf_dir, "conversations")).drop("position", "subtree_end")


@settled
def op13_kd_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdmeans.cluster(_read(spark, sf_dir, "embeddings"))


def _not_one(fold):
    return fold != 1


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_pii": op2_pii,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_byte_shards": op4_byte_shards,
    "op5_toxicity": op5_toxicity,
    "op6_top_k": op6_top_k,
    "op7_url_filter": op7_url_filter,
    "op8_quality_rules": op8_quality_rules,
    "op9_packing": op9_packing,
    "op10_katz": op10_katz,
    "op11_nn_descent": op11_nn_descent,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_kd_clusters": op13_kd_clusters,
    "quality_ablation": quality_ablation,
}

_OP7 = r"""
with recursive p as (
  select page_id, url, html,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path,
    string_split(regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)', 1), '&') as args
  from pages),
a as (
  select page_id, url, html, host, path,
    case when url like '%://%' then host || regexp_replace(path, '(/index\.html?|/)$', '')
      || case when len(list_filter(args, lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)'))) > 0
           then '?' || array_to_string(list_filter(args, lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)')), '&') else '' end end as address,
    case when (host = 'www.example.com' or host like '%.www.example.com') and path like '/en/%' then 'www.example.com/en/'
         when (host = 'example.com' or host like '%.example.com') and path like '/en/%' then 'example.com/en/'
         when (host = 'net' or host like '%.net') and path like '/es/%' then 'net/es/'
         when (host = 'net' or host like '%.net') and path like '/fr/%' then 'net/fr/'
         when (host = 'com' or host like '%.com') and path like '/%' then 'com/' end as rule
  from p),
-- The pages of these tables hold no canonical or refresh links, so an address is its own component.
b as (select address from a where rule is not null and address is not null group by address
      having bool_or(rule in ('example.com/en/', 'net/es/', 'net/fr/')) and not bool_or(rule in ('com/', 'www.example.com/en/')))
select page_id, host, path, rule,
  case when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' when rule is not null then 'allow'
       when address in (select address from b) then 'block' else 'allow' end as verdict
from a
"""

_OP8 = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws, string_split(text, chr(10)) as ls from d),
u as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from w),
t as (select doc_id, i, w as w1, lead(w, 1) over p as w2, lead(w, 2) over p as w3 from u window p as (partition by doc_id order by i)),
g as (select doc_id, i, count(*) over (partition by doc_id, w1, w2, w3) as c from t where w3 is not null),
r as (select doc_id, count(distinct i + k) as n_repeat_words from g, (values (0), (1), (2)) x(k) where c > 1 group by doc_id),
l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from w),
m as (select doc_id, row_number() over (partition by doc_id, line order by i) as k from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
n as (select doc_id, count(*) as n_lines, count(*) filter (k > 1) as n_dup_lines from m group by doc_id),
f as (
  select w.doc_id, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_lines, 0) as n_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
    len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]'))) as n_alpha
  from w left join r on r.doc_id = w.doc_id left join n on n.doc_id = w.doc_id),
b as (
  select *, (case when n_words < 50 then 1 else 0 end) + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end)
    + (case when 10 * n_symbols > n_words then 4 else 0 end) + (case when 100 * n_dup_lines > 60 * n_lines then 8 else 0 end)
    + (case when word_chars < 2 * n_words or word_chars > 15 * n_words then 16 else 0 end)
    + (case when 100 * n_alpha < 70 * n_words then 32 else 0 end) as bits
  from f)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, bits % 4 <> 0 as base_failed, bits = 0 as kept, bits::bigint as failed_bits
from b
"""

_ABLATION = f"""
with b as (select failed_bits as bits from ({_OP8})),
r as (select * from (values ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('repeated_lines', 8), ('word_length', 16), ('no_letters', 32)) t(rule, bit))
select rule, (count(*) filter (bits & bit <> 0))::bigint as failed, (count(*) filter (bits = bit))::bigint as failed_only_here,
  (count(*) filter (bits & ~bit = 0))::bigint as kept_without from b cross join r group by rule
"""

_CRC_TABLE = """bits as (
  select range as i, range::bigint as c, 0 as k from range(256)
  union all select i, xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end), k + 1 from bits where k < 8),
tab as (select list(c order by i) as t from bits where k = 8),
"""

_OP4 = f"""
with recursive {_CRC_TABLE}
h as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, ''))::bigint + 1 as size from documents),
y as (select doc_id, size, list_transform(regexp_extract_all(h, '..'), lambda p: ('0x' || p)::bigint) as y from h),
d as (
  select doc_id, size, xor(coalesce(list_reduce(y, lambda a, v: xor(a >> 8, t[xor(a & 255, v) + 1]), 4294967295::bigint), 4294967295), 4294967295) as crc
  from y, tab),
p as (
  select *, 2 * sum(size) over (order by doc_id nulls first, crc, size rows unbounded preceding) - size as middle, sum(size) over () as total,
    row_number() over (order by doc_id nulls first, crc, size) as r
  from d),
s as (select *, least(7, middle * 8 // (2 * total))::int as shard from p)
select doc_id, size, crc as text_crc32, 'bytes' as law, shard, r - min(r) over (partition by shard) as slot, null::int as grown_shard from s
"""

_OP6 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""



def _kd_round(n: int) -> str:
    """Centroids of round n from those of the round before."""
    return f"""
o{n} as (select r, e, (select c.k from c{n - 1} c order by list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.k limit 1) as k from v),
s{n} as (select k, list(floor_mean order by i) as e from (
  select k, i, sum(x) as s, count(*) as n, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as floor_mean
  from (select k, unnest(e) as x, generate_subscripts(e, 1) as i from o{n}) group by k, i) group by k),
c{n} as materialized (select c.k, coalesce(s.e, c.e) as e from c{n - 1} c left join s{n} s on s.k = c.k),"""


_OP13 = f"""
with v as materialized (
  select vec_id, row_number() over () as r, list_transform(embedding, lambda x: floor(64 * x::double)::hugeint) as e from embeddings
  where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (
  select k - 1 as k, e from (select e, row_number() over (order by sha256('1:' || vec_id::varchar) nulls last, e) as k from v) where k <= 16),
{_kd_round(1)}{_kd_round(2)}{_kd_round(3)}
d as (
  select vec_id, c.k, list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as distance,
    row_number() over (partition by v.r order by list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.k) as place
  from v cross join c3 c)
select d.vec_id, d.k::int as cluster, distance::bigint as distance, (sum(distance) over (partition by d.k))::bigint as cluster_inertia,
  (sum(distance) over ())::bigint as inertia, sha256(array_to_string(c.e, ',')) as centroid_sha256
from d join c3 c on c.k = d.k where place = 1
"""

_OP11 = """
with recursive v as (
  select vec_id, row_number() over () as r, list_transform(embedding, lambda x: x::double) as e from embeddings),
g as (
  select r, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as e from v
  where e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
l as materialized (select a.r, b.r as o from g a join g b on a.r <> b.r and len(a.e) = len(b.e) and list_dot_product(a.e, b.e) >= 0.95),
c as (select r, r as o from v union select c.r, l.o from c join l on l.r = c.o),
m as (select c.r, min(v.vec_id) as component_id from c join v on v.r = c.o group by c.r)
select v.vec_id, (select count(*) from l where l.r = v.r)::bigint as n_links, m.component_id, v.vec_id is not distinct from m.component_id as kept
from v join m on m.r = v.r
"""

_OP12 = f"""
with recursive {_CRC_TABLE}
t as (
  select conv_id as c, coalesce(text, '') as text, sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as key,
    row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as pos
  from conversations where conv_id is not null),
h as (
  select c, c - c % 100 as p, list_transform(regexp_extract_all(hex(encode(c::varchar)), '..'), lambda x: ('0x' || x)::bigint) as y, count(*) as m from t group by c),
g as (
  select c, p, m, xor(list_reduce(y, lambda a, v: xor(a >> 8, t[xor(a & 255, v) + 1]), 4294967295::bigint), 4294967295) % 6 as h from h, tab),
r as (
  select g.c, t.pos, t.key, t.text, 0 as half from g join t on t.c = g.p and t.pos < g.h
  union all select g.c, t.pos, t.key, t.text, 1 from g join t on t.c = g.c and t.pos >= g.h),
s as (select c, row_number() over (partition by c order by half, pos) as d, key, length(text) as size from r),
x as (select g.c, list(s.key order by s.d) filter (s.key is not null) as keys, list(s.size order by s.d) filter (s.key is not null) as sizes from g left join s on s.c = g.c group by g.c),
w as (select c, coalesce(keys, []) as keys, coalesce(sizes, []) as sizes from x),
q as (select c, keys[:d] as node, d, coalesce(sizes[d], 0) as size, d = len(keys) as last from (select c, keys, sizes, unnest(range(len(keys) + 1)) as d from w)),
n as materialized (
  select node, d, min(c) as conv_id, count(*) as n_convs, max(size) as size, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (last), '')) as ends_sha256
  from q group by node, d),
k as (select node[:d - 1] as node, count(*) as n_children from n where d > 0 group by all),
f as (select n.*, coalesce(k.n_children, 0) as n_children from n left join k on k.node = n.node),
u as (
  select over_node, sum((n_children = 0)::int) as n_leaves, sum((n_convs - 1) * size) as saved_tokens
  from (select f.*, f.node[:e] as over_node from (select *, unnest(range(d + 1)) as e from f) f) group by over_node)
select f.conv_id, f.d::bigint as depth, p.conv_id as parent_conv_id, f.n_convs::bigint as n_convs, f.n_children::bigint as n_children,
  u.n_leaves::bigint as n_leaves, u.saved_tokens::bigint as saved_tokens, f.ends_sha256
from f join u on u.over_node = f.node left join n p on f.d > 0 and p.node = f.node[:f.d - 1]
"""

ORACLE_SQL = {"op11_nn_descent": _OP11, "op12_prefix_trie": _OP12, "op13_kd_clusters": _OP13, "op4_byte_shards": _OP4, "op6_top_k": _OP6, "op7_url_filter": _OP7, "op8_quality_rules": _OP8, "quality_ablation": _ABLATION}
