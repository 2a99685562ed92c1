"""The registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontam, hamming, importance, langid, packing, secretscan, sharding, toxicity, warc
from quarry.llm.common import documents, table
from quarry.llm.simhash import near_duplicates


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-pass shuffle of all documents into 24 shards, whose row counts are at most one apart."""
    found = sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), shards=24)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return found.select(
        "doc_id", sharding.row_bytes("text").alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the rows that are not held out."""
    samples = langid.learn(table(spark, sf_dir, "documents"))
    found = langid.identify_languages(documents(spark, sf_dir), samples)
    return found.select("doc_id", F.coalesce(~langid.not_held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest other rows, by sign codes, of every embedding whose id is divisible by 50."""
    codes = hamming.sign_codes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return hamming.hamming_top_k(codes, codes.where("id % 50 = 0"), k=10)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token pieces in sequences of 2048."""
    found = packing.pack_documents(documents(spark, sf_dir), word_tokenizer())
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and positions of the secrets of every document."""
    found = secretscan.scan_secrets(documents(spark, sf_dir))

    def joined(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != "entropy")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in secretscan.BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC bundles and read back."""
    index = warc.write_bundles(table(spark, sf_dir, "pages"))
    return warc.read_bundles(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, Gumbel rank and selection of every document, with documents of quality 1 as the target."""
    return importance.resample(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item in every document that holds 0.8 or more of its 5-word shingles."""
    return decontam.find_contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels that are not held out."""
    model = toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    found = toxicity.score_toxicity(documents(spark, sf_dir), model)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_TOP_K = """
with codes as (
    select vec_id as id, list_sum(list_transform(range(0, 32), lambda i: case when embedding[i + 1] > 0 then 1::bigint << i else 0 end)) as low,
        list_sum(list_transform(range(0, 32), lambda i: case when embedding[i + 33] > 0 then 1::bigint << i else 0 end)) as high
    from (select vec_id, embedding from embeddings where vec_id is not null and embedding is not null)
), far as (
    select q.id as query_id, c.id, cast(bit_count(xor(q.low::bigint, c.low::bigint)) + bit_count(xor(q.high::bigint, c.high::bigint)) as integer) as distance
    from codes q join codes c on c.id <> q.id where q.id % 50 = 0
), ranked as (select *, cast(row_number() over (partition by query_id order by distance, id) as integer) as rank from far)
select query_id, rank, id, distance from ranked where rank <= 10
"""

_WARC = """
with p as (select page_id, coalesce(html, '') as html from pages),
g as (select page_id, octet_length(encode(html)) as payload_bytes, sha256(html) as payload_digest, min(page_id) over (partition by html) as first from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
    case when payload_bytes >= 100 and page_id <> first then first end as refers_to
from g
"""


_DECONTAM = r"""
with w as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as words from benchmark where text is not null),
i as (select item_id, words, least(5, len(words)) as size from w where len(words) > 0),
s as (select distinct item_id, size, unnest(list_transform(range(1, len(words) - size + 2), lambda k: list_aggregate(words[k : k + size - 1], 'string_agg', ' '))) as shingle from i),
n as (select item_id, size, count(*) as n from s group by 1, 2),
d as (select doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as words from documents where text is not null),
t as (select distinct doc_id, text, size, unnest(list_transform(range(1, len(words) - size + 2), lambda k: list_aggregate(words[k : k + size - 1], 'string_agg', ' '))) as shingle
    from d, (select distinct size from i) where len(words) >= size),
m as (select t.doc_id, t.text, s.item_id, count(*) as found from t join s on s.size = t.size and s.shingle = t.shingle group by 1, 2, 3)
select m.doc_id, m.item_id, cast(n.n as integer) as shingles, cast(m.found as integer) as found, m.found / n.n as containment
from m join n using (item_id) where m.found >= ceil(0.8 * n.n - 1e-9)
"""


def oracle_sql() -> dict[str, str]:
    """SQL that gives the same rows. Where there is none, tests/llm compares with brute force or held-out labels."""
    return {"op3_exact_top_k": _TOP_K, "op6_warc": _WARC, "op8_decontamination": _DECONTAM}
