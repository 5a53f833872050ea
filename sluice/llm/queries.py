"""The corpus operators as registered queries, over whole tables of a data folder."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import mixing, quality, sentencepieces, simhash, suffix_dedup, token_counts, token_files, topk, toxicity, url_filter
from sluice.llm._shared import scratch_path


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_ids(_read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.with_crc32(token_files.read_ids(spark, path))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(_read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_bits("fingerprint").alias("fingerprint"), "component_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("ratio", 6).alias("ratio"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = toxicity.train(docs, _read(spark, sf_dir, "labels").where(fold != 0))
    found = toxicity.score(docs, model)
    held_out = F.coalesce(fold == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def op7_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    found = sentencepieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    found = found.select("doc_id", (F.xxhash64("decoded") == F.col("text_hash")).alias("round_trip"), F.size("ids").cast("long").alias("n_tokens"), "ids")
    return token_files.with_crc32(found)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.token_counts(_read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "labels")  # a page's outcome is the label of its number
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), 0)
    outcomes = labels.where("quality is not null and toxic is not null").select("doc_id", bad.alias("bad"))
    return url_filter.judge(_read(spark, sf_dir, "pages"), outcomes)


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


#: op1: every query against every row, by DuckDB's own list functions.
TOPK_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings where vec_id is not null and embedding is not null),
s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s) where rank <= 5
"""

#: op2: the shares settle in as many rounds as there are sources; documents by running sum in order of hash.
MIX_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h from documents),
s as (
  select source, sum(size)::bigint as n, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as w from d group by source),
o as (
  select *, 3 * n as cap, sum(n) over () as total, coalesce(sum(3 * n) over (order by 3 * n / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as before,
    sum(w) over (order by 3 * n / w, source nulls last rows between current row and unbounded following) as rest,
    row_number() over (order by 3 * n / w, source nulls last) as place from s),
l as (select *, (total - before) / rest as level from o),
t as (
  select source, n as source_size, case when cap <= level * w then cap::double
    else (select arg_min(level, place) from l where cap > level * w) * w end as target from l),
f as (
  select d.*, source_size, target, case when source_size > 0 then floor(target / source_size) else 0 end as whole
  from d join t on d.source is not distinct from t.source),
g as (select source, h, sum(size) as n from f group by source, h),
c as (select source, h, n, sum(n) over (partition by source order by h) as upto from g)
select doc_id, size, source_size, target,
  (size * (whole + case when upto - c.n > target - whole * source_size then 0 when upto <= target - whole * source_size then 1
    when (target - whole * source_size - (upto - c.n)) * 2 >= c.n then 1 else 0 end))::bigint as taken
from f join c on f.source is not distinct from c.source and f.h = c.h
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": TOPK_SQL, "op2_mixing": MIX_SQL, "op10_url_filter": url_filter.SQL}
