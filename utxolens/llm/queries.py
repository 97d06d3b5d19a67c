"""The corpus queries and their DuckDB twins, registered by the entry module."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from utxolens.llm import infill, mixing, negatives, packing, repeats, secrets, sharding, simhash, substrings, topk, toxicity, urls, vectors


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity.scored(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False).drop("kept")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch time spread over thirty days by their id."""
    return pages.select(F.col("page_id").alias("capture"), "url", (F.col("page_id") * 7919 % 2_592_000).alias("fetched"))


def page_entries(pages: DataFrame) -> DataFrame:
    """A dated URL list made from every seventh page: block or allow its domain, host, first folder or URL; half are lifted later."""
    own = pages.filter("page_id % 7 = 0").select("page_id", urls.normalised(F.col("url")).alias("u")).filter("u is not null")
    labels = F.split("u.host", r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    prefix = F.concat("u.host", F.lit("/"), F.regexp_extract("u.rest", "^/([^/?]*)", 1))
    kind = F.element_at(F.array(*map(F.lit, urls.KINDS)), (F.col("page_id") % 4 + 1).cast("int"))
    key = F.when(kind == "domain", domain).when(kind == "host", F.col("u.host")).when(kind == "prefix", prefix).otherwise(F.concat("u.host", "u.rest"))
    verdict = F.when(F.col("page_id") % 3 == 0, "allow").otherwise("block")
    at = F.col("page_id") * 104_729 % 2_592_000
    lifted = own.filter("page_id % 2 = 0").select(kind.alias("kind"), key.alias("key"), F.lit(None).cast("string").alias("verdict"), (at + 86_400 * (1 + F.col("page_id") % 20)).alias("at"))
    return own.select(kind.alias("kind"), key.alias("key"), verdict.alias("verdict"), at.alias("at")).unionByName(lifted)


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return urls.judged(page_captures(pages), page_entries(pages)).withColumnRenamed("capture", "page_id")


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.transformed(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False).drop("output")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; labels of every seventh are first made wrong."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False).drop("kept")


QUERIES = {"op13_repeats": op13_repeats, "op11_infill": op11_infill, "op12_negatives": op12_negatives, "pipeline": corpus_pipeline.run, "op4_urls": op4_urls, "op10_vectors": op10_vectors, "op2_substrings": op2_substrings, "op3_topk": op3_topk, "op6_secrets": op6_secrets, "op5_mixing": op5_mixing, "op8_sharding": op8_sharding, "op9_packing": op9_packing, "op1_toxicity": op1_toxicity, "op7_simhash": op7_simhash}

ORACLE_SQL: dict[str, str] = {
    "op4_urls": r"""
with c as (select page_id, regexp_replace(trim(url), '#.*$', '') as clean, page_id * 7919 % 2592000 as fetched from pages),
h as (
  select page_id, fetched, regexp_replace(lower(regexp_extract(clean, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?:]+)', 1)), '\.+$', '') as host,
         coalesce(regexp_extract(clean, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([/?].*)?$', 1), '') as r from c),
p as (
  select page_id, fetched, nullif(host, '') as host, string_split(host, '.') as labels,
         case when nullif(host, '') is null then null when r = '' then '/' when r[1] = '?' then '/' || r else r end as rest from h),
e0 as (
  select page_id, ['domain', 'host', 'prefix', 'url'][(page_id % 4 + 1)::int] as kind,
         case page_id % 4 when 0 then array_to_string(labels[greatest(len(labels) - 1, 1):], '.') when 1 then host
              when 2 then host || '/' || regexp_extract(rest, '^/([^/?]*)', 1) else host || rest end as key,
         case when page_id % 3 = 0 then 'allow' else 'block' end as verdict, page_id * 104729 % 2592000 as t
  from p where page_id % 7 = 0 and host is not null),
e1 as (
  select kind, key, verdict, t from e0
  union all select kind, key, null, t + 86400 * (1 + page_id % 20) from e0 where page_id % 2 = 0),
e2 as (select kind, key, t as since, max(verdict) as verdict from e1 group by kind, key, t),
e as (select *, lead(since) over (partition by kind, key order by since) as until from e2),
f as (select *, list_filter(string_split(regexp_extract(rest, '^([^?]*)', 1), '/'), lambda x: x <> '') as folders from p where host is not null),
k as (
  select page_id, fetched, 'host' as kind, host as key from f
  union all select page_id, fetched, 'url', host || rest from f
  union all select page_id, fetched, 'domain', array_to_string(labels[i:], '.') from (select *, unnest(range(1, len(labels) + 1)) as i from f)
  union all select page_id, fetched, 'prefix', host || '/' || array_to_string(folders[1:i], '/') from (select *, unnest(range(0, len(folders) + 1)) as i from f)),
a as (
  select k.page_id, k.kind, k.key, e.verdict, e.since, e.until,
         row_number() over (partition by page_id order by list_position(['domain', 'host', 'prefix', 'url'], k.kind) desc, length(k.key) desc, k.key desc) as n,
         count(*) over (partition by page_id) as n_active
  from k join e on k.kind = e.kind and k.key = e.key and e.since <= k.fetched and (e.until is null or k.fetched < e.until)
  where e.verdict is not null)
select p.page_id, p.host, p.fetched, a.verdict, a.kind, a.key, a.since, a.until, coalesce(a.n_active, 0)::bigint as n_active
from p left join a on a.page_id = p.page_id and a.n = 1
""",
    "op2_substrings": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35),
win as (select doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) as k from s),
rep as (select k from win group by k having count(*) > 1),
cov as (select distinct doc_id, i + o as j from (select doc_id, i, unnest(range(0, 35)) as o from win join rep using (k))),
word as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as j from d),
kept as (select word.*, cov.j is not null as gone from word left join cov on cov.doc_id = word.doc_id and cov.j = word.j),
t as (
  select doc_id, count(*) as n_words, count(*) filter (where gone) as n_removed,
         coalesce(string_agg(x, ' ' order by j) filter (where not gone), '') as rest from kept group by doc_id)
select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
       sha256(coalesce(rest, '')) as kept_sha256 from d left join t on t.doc_id = d.doc_id
""",
    "op10_vectors": """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as (select vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v),
l as (
  select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / a.norm / b.norm >= 0.98::double),
r as (select vec_id, vec_id as c from embeddings union select l.b, r.c from r join l on l.a = r.vec_id and r.c < l.b),
n as (select a, count(*) as n from l group by a),
m as (select vec_id, min(c) as c from r group by vec_id)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, m.c as component_id, e.vec_id = m.c as kept
from embeddings e left join n on n.a = e.vec_id left join m on m.vec_id = e.vec_id
""",
    "op3_topk": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on len(q.v) = len(c.v) and q.vec_id != c.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
""",
    "op11_infill": r"""
with d as (
  select row_number() over () as k, doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
u as (
  select *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as w, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
         ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
c as (
  select *, len(w)::bigint as n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) as a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) as b,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain'
              when h4 % 100 < 50 then 'spm' else 'psm' end as form from u),
p as (select *, array_to_string(w[1:a], '') as prefix, array_to_string(w[a + 1:b], '') as middle, array_to_string(w[b + 1:], '') as suffix from c),
o as (
  select *, case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                 else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end as output from p),
x as (select *, strpos(output, '<P>') as p1, strpos(output, '<S>') as s1, strpos(output, '<M>') as m1 from o)
select doc_id, n, form, case when form <> 'plain' then length(prefix)::bigint end as prefix_chars,
       case when form <> 'plain' then length(middle)::bigint end as middle_chars, sha256(output) as output_sha256,
       sha256(case form when 'plain' then output
              when 'psm' then substr(output, 4, s1 - 4) || substr(output, m1 + 3) || substr(output, s1 + 3, m1 - s1 - 3)
              else substr(output, p1 + 3, m1 - p1 - 3) || substr(output, m1 + 3) || substr(output, 4, p1 - 4) end) as restored_sha256
from x
""",
    "op13_repeats": r"""
with d as (select row_number() over () as k, doc_id, hex(encode(coalesce(text, ''))) as t from documents),
e as (select k, length(t) // 2 as n, regexp_extract_all(t, '.{1,1000}') as q from d),
f as (select k, n, q[j] || coalesce(q[j + 1], '') as s, (j - 1) * 500 as z, unnest(range(1, 501)) as o from (select k, n, q, unnest(range(1, len(q) + 1)) as j from e)),
w as (select k, n, z + o as i, substr(s, 2 * o - 1, 2) as x, case when z + o + 199 <= n then md5_number(substr(s, 2 * o - 1, 400)) end as m from f where z + o <= n),
r as (select m from w where m is not null group by m having count(*) > 1),
c as (
  select w.k, i, x, coalesce(i - max(case when r.m is not null then i end) over (
           partition by w.k order by i rows between unbounded preceding and current row) < 200, false) as gone from w left join r using (m)),
s as (select *, gone and not coalesce(lag(gone) over (partition by k order by i), false) as begins from c),
g as (
  select k, count(*) as n_bytes, count(*) filter (where gone) as n_removed, count(*) filter (where begins) as n_spans,
         sha256(unhex(coalesce(string_agg(x, '' order by i) filter (where not gone), ''))) as kept_sha256 from s group by k)
select d.doc_id, coalesce(n_bytes, 0)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
       coalesce(kept_sha256, sha256('')) as kept_sha256 from d left join g using (k)
""",
    "op12_negatives": """
with v as (
  select distinct vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, a.label as anchor_label, b.vec_id, b.label,
         list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::bigint as score
  from v a join v b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % 100 = 0),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where label = anchor_label
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (
  select p.*, s.vec_id as negative_id, s.score as negative_score,
         row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as rank
  from p join s on s.anchor_id = p.anchor_id and s.label <> s.anchor_label and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 10
""",
    "op5_mixing": r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5('7:' || coalesce(doc_id::varchar, '')) as o from documents),
s as (
  select source, sum(size)::bigint as source_size,
         [3, 1, 2][((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1)::int] as weight from d group by source),
r as (
  select *, 2.0::double * source_size as cap, 1.5::double * (sum(source_size) over ())::double as total,
         coalesce(sum(2.0::double * source_size) over (order by 2.0::double * source_size / weight, encode(source) nulls last
                                              rows between unbounded preceding and 1 preceding), 0.0::double) as below,
         sum(weight) over (order by 2.0::double * source_size / weight, encode(source) nulls last
                           rows between current row and unbounded following) as rest_weight from s),
l as (select max((total - below) / rest_weight::double) filter (where (total - below) / rest_weight::double * weight <= cap) as level from r),
t as (
  select source, source_size, case when level is null or cap < level * weight then cap else level * weight end as target from r, l),
p as (select *, coalesce(floor(target / nullif(source_size, 0)), 0)::bigint as whole from t),
g as (select source, o, sum(size) as words from d group by source, o),
c as (
  select g.source, g.o, p.source_size, p.target, p.whole,
         coalesce(sum(words) over (partition by g.source order by g.o rows between unbounded preceding and 1 preceding), 0)
           + words / 2.0::double < p.target - p.whole * p.source_size as more
  from g join p on g.source is not distinct from p.source)
select d.doc_id, d.size, c.source_size, c.target, ((c.whole + case when c.more then 1 else 0 end) * d.size)::bigint as taken
from d join c on d.source is not distinct from c.source and d.o = c.o
""",
}

if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
