"""Registered queries of the thirteen operators, with DuckDB SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import licence_scan
from tessera.llm.conversation import repair
from tessera.llm.decontam import decontaminate
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.html_extract import extract_text
from tessera.llm.line_dedup import line_dedup
from tessera.llm.mixing import mix
from tessera.llm.ngram_lm import score_texts
from tessera.llm.pii import find_pii, joined
from tessera.llm.simhash import simhash_dups
from tessera.llm.spelling import spelling_variants
from tessera.llm.topk import top_k
from tessera.llm.toxicity import score_toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("locator")


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan.scan_licences(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dups(table(spark, sf_dir, "documents"), shingle=3, radius=3)


def pii_digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(find_pii(table(spark, sf_dir, "documents")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), order=2)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("hits")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"), similarity=0.8)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), k=5, scale=256, every=50)


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_licences, op3_html_text, op4_simhash, op5_pii, op6_mixing, op7_lm_score, op8_toxicity,
    op9_line_dedup, op10_decontamination, op11_conversation_repair, op12_spelling_variants, op13_top_k)}

SQL = {"op2_licences": licence_scan.oracle_sql()}

SQL["op1_exact_dedup"] = r"""
with d as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
  from documents)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = min(doc_id) over g as kept, text_sha256
from d window g as (partition by text_sha256)
"""

SQL["op13_top_k"] = r"""
with v as (
  select row_number() over () as r, vec_id, [floor(256 * x::double)::bigint for x in embedding] as x
  from embeddings
  where len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
s as (
  select q.r as q, q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.r <> c.r and len(q.x) = len(c.x)),
n as (select *, row_number() over (partition by q order by score desc, vec_id nulls last)::int as rank from s)
select query_id, rank, vec_id, score from n where rank <= 5
"""

# water-filling in closed form: capped sources are a prefix by cap / weight
SQL["op6_mixing"] = r"""
with d as (
  select doc_id, source, md5(coalesce(doc_id::varchar, '') || ':6') as key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size
  from documents),
s as (
  select source, sum(size)::bigint as source_size,
         [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w
  from d group by source),
o as (
  select *, 3 * source_size as cap,
         sum(source_size) over () as total,
         coalesce(sum(3 * source_size) over (order by 3.0 * source_size / w, source nulls last
                  rows between unbounded preceding and 1 preceding), 0) as capped,
         sum(w) over (order by 3.0 * source_size / w, source nulls last
                  rows between current row and unbounded following) as share
  from s),
f as (select *, cap::hugeint * share < (total - capped)::hugeint * w as is_full from o),
u as (select (max(total) - coalesce(sum(cap) filter (is_full), 0))::double
             / nullif(sum(w) filter (not is_full), 0)::double as unit from f),
t as (select source, source_size, case when is_full then cap::double else coalesce(unit, 0.0) * w end as target
      from f, u),
p as (
  select d.doc_id, d.size, t.source_size, t.target, floor(t.target)::bigint as budget,
         sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size
                           rows between unbounded preceding and current row) - d.size as start
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (coalesce(budget // nullif(source_size, 0), 0) * size
        + greatest(0, least(size, budget - coalesce(budget // nullif(source_size, 0), 0) * source_size - start)))::bigint
         as taken
from p
"""
