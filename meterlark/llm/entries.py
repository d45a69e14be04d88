"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlark.llm.decontaminate import decontaminate
from meterlark.llm.filter_audit import audit_filters
from meterlark.llm.language import fit_centroids, identify_language
from meterlark.llm.near_dedup import near_duplicates
from meterlark.llm.packing import pack
from meterlark.llm.pii import find_pii
from meterlark.llm.quality import judge_quality
from meterlark.llm.secrets import scan_secrets
from meterlark.llm.substrings import find_repeats
from meterlark.llm.token_counts import count_tokens
from meterlark.llm.url_lists import filter_urls, host_of
from meterlark.llm.vector_dedup import near_vectors
from meterlark.llm.whitening import whiten

VOCABULARY = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashed(text) -> F.Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), limit=1024)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_repeats(table(spark, sf_dir, "documents"), window=13)
    return found.select("doc_id", "n_words", "n_removed", hashed(F.col("kept_text")).alias("kept_sha256"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=5, part=85, whole=100)


def dated_entries(pages: DataFrame) -> DataFrame:
    """A deny list made from the pages' own hosts and domains: days of adding, removing and adding again follow a hash."""
    hosts = pages.select(host_of(F.col("url")).alias("domain")).where("domain is not null").distinct()
    domains = hosts.select(F.array_join(F.slice(F.split("domain", r"\."), -2, 2), ".").alias("domain")).where("domain like '%.%'").distinct()
    names = hosts.select(F.lit("hosts").alias("list"), "domain").union(domains.select(F.lit("domains"), "domain"))
    names = names.withColumn("k", F.conv(F.substring(F.md5("domain"), 1, 4), 16, 10).cast("int"))
    names = names.where("(list = 'hosts' and k % 3 = 0) or (list = 'domains' and k % 5 = 0)")
    add, remove, again = (names.where(c).select("list", "domain", F.lit(a).alias("action"), F.expr(f"date_add(date'2024-01-01', k % 200 + {d})").alias("at")) for c, a, d in (("true", "add", 0), ("k % 2 = 0", "remove", 60), ("k % 4 = 0", "add", 120)))
    return add.union(remove).union(again).union(add)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.expr("date_add(date'2024-01-01', cast(page_id * 7919 % 365 as int))"))
    return filter_urls(captures, dated_entries(pages))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", hashed(F.col("items")).alias("items_sha256"), "contaminated")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", hashed(F.col("base")).alias("base_sha256"), "spans", "n_spans")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2, F.lit(False))
    model = fit_centroids(docs.where(~held_out))
    found = identify_language(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), size=2048, end_id=1)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", hashed(F.col("base")).alias("base_sha256"), "spans", "n_spans")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), components=8).withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_substring_dedup, op3_near_dedup, op4_url_filters, op5_decontamination, op6_personal_data, op7_quality_rules, op8_language_id, op9_packing, op10_secret_scans, op11_filter_audit, op12_embedding_dedup, op13_embedding_whitening)}

SQL: dict[str, str] = {
    "op4_url_filters": r"""
with pages_ as (select page_id, nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]]+)', 1)), '.'), '') as host,
                       date '2024-01-01' + (page_id * 7919 % 365)::int as seen from pages),
hosts as (select distinct host as domain from pages_ where host is not null),
domains as (select distinct array_to_string(list_slice(string_split(domain, '.'), -2, -1), '.') as domain from hosts),
names as (select list, domain, ('0x' || substr(md5(domain), 1, 4))::int as k from (select 'hosts' as list, domain from hosts union all select 'domains', domain from domains where domain like '%.%')),
listed as (select * from names where (list = 'hosts' and k % 3 = 0) or (list = 'domains' and k % 5 = 0)),
spans as (select list, domain, date '2024-01-01' + (k % 200) as from_at, case when k % 2 = 0 then date '2024-01-01' + (k % 200 + 60) end as to_at from listed
          union all select list, domain, date '2024-01-01' + (k % 200 + 120), null from listed where k % 4 = 0),
found as (select page_id, count(*) as n, string_agg(list || ':' || domain, ',' order by list || ':' || domain) as matched
          from pages_ join spans on (host = domain or suffix(host, '.' || domain)) and seen >= from_at and (to_at is null or seen < to_at) group by page_id)
select p.page_id, p.host, coalesce(f.n, 0)::bigint as n_entries, coalesce(f.matched, '') as matched, f.n is not null as blocked from pages_ p left join found f using (page_id)
""",
    "op5_decontamination": r"""
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select item_id::varchar as item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
wins as (select distinct item, least(len(w), 13) as n, array_to_string(w[i:i + 12], ' ') as win from (select item, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) as i from b where len(w) > 0)),
sizes as (select distinct n from wins),
places as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as win from (select doc_id, w, unnest(generate_series(1, len(w))) as i from d), sizes where i + n - 1 <= len(w)),
hits as (select doc_id, i, wins.n, item from places join wins on places.n = wins.n and places.win = wins.win),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as s from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(s, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join words using (doc_id) left join items using (doc_id)
""",
    "op11_filter_audit": r"""
with d as (select coalesce(doc_id, 9223372036854775807) as id, doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
l as (select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels where doc_id is not null group by doc_id),
m as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
             (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::int
             + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * (id > min(id) over (partition by t))::int as fails
      from d left join l on d.doc_id = l.doc_id),
c as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from m group by part, fails),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as k, unnest([1, 2, 4, 8, 16]) as b),
o as (select p.k || q.k || r.k || s.k || t.k as filter_order from f p, f q, f r, f s, f t where p.b + q.b + r.b + s.b + t.b = 31 and len(list_distinct([p.k, q.k, r.k, s.k, t.k])) = 5),
steps as (select filter_order, step, f.b, coalesce((select sum(g.b) from f g where position(g.k in filter_order) < step), 0)::int as before
          from o, unnest([1, 2, 3, 4, 5]) as u(step), f where f.k = substr(filter_order, step, 1)),
r as (select part, filter_order, step, b, sum(case when fails & (before | b) = 0 then n else 0 end)::bigint as kept,
             sum(case when fails & b <> 0 and fails & before = 0 then n else 0 end)::bigint as removed,
             sum(case when fails & b <> 0 and fails & before <> 0 then n else 0 end)::bigint as redundant,
             sum(case when fails = b then n else 0 end)::bigint as unique_fails,
             sum(case when fails & b <> 0 and fails & before = 0 then good else 0 end)::bigint as good_lost,
             sum(case when fails & b <> 0 and fails & before = 0 then toxic else 0 end)::bigint as toxic_lost
      from c, steps group by part, filter_order, step, b)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, b))::bigint as shapley from r
""",
    "op12_embedding_dedup": r"""
with recursive v as (select row_number() over () as r, vec_id, label, list_transform(embedding, lambda c: c::double) as e from embeddings),
u as (select r, label, e from v where label is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(e, lambda c: c <> 0)) > 0),
k as (select a.r as a, b.r as b from u a join u b on a.label = b.label and len(a.e) = len(b.e) and a.r <> b.r where list_cosine_similarity(a.e, b.e) >= 0.98),
w as (select r as a, r as b from v union select w.a, k.b from w join k on w.b = k.a),
c as (select w.a as r, min(v.vec_id) as component_id from w join v on v.r = w.b group by w.a)
select v.vec_id, (select count(*) from k where k.a = v.r) as n_links, c.component_id, coalesce(v.vec_id = c.component_id, c.component_id is null) as kept from v join c using (r)
""",
}
