"""Queries over the given tables, one for each operator, and their SQL."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontaminate, html_extract, langid, order_minhash, packing, periodic_runs, piece_encoding, secret_scan, simhash, suffix_dedup, token_alignment, token_shards
from .common import ship, work_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shipped(f):
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


@_shipped
def op1_pack_sequences(spark, sf_dir):
    return packing.pack_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@_shipped
def op2_order_minhash(spark, sf_dir):
    return order_minhash.fingerprint_pairs(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@_shipped
def op3_format_chats(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.format_conversations(turns.union(extra)))


@_shipped
def op4_simhash_near_duplicates(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@_shipped
def op5_scan_secrets(spark, sf_dir):
    found = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: int):  # a lambda's second parameter, even one with a default, would be the element's place
        return F.size(F.filter("base", lambda s: s["ord"] == kind)).cast("long").alias(f"n_{secret_scan.KINDS[kind]}")

    n = [count(kind) for kind in range(3)]
    return found.select("doc_id", *n, F.sha2(secret_scan.listed("base"), 256).alias("base_sha256"), secret_scan.listed("spans").alias("spans"))


@_shipped
def op6_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@_shipped
def op7_extract_pages(spark, sf_dir):
    return html_extract.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@_shipped
def op8_identify_language(spark, sf_dir):
    return langid.identify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@_shipped
def op9_token_shards(spark, sf_dir):
    path = work_dir(spark)
    token_shards.write_shards(_table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    back = token_shards.read_shards(spark, path)
    return back.select("slot", "shard", "doc_id", "piece", "length", F.octet_length("ids").alias("n_bytes"), F.crc32(F.expr("substring(ids, 1, int(2 * length))")).alias("ids_crc32"))


@_shipped
def op10_decontaminate(spark, sf_dir):
    return decontaminate.contained(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


@_shipped
def op11_encode_pieces(spark, sf_dir):
    made = piece_encoding.encode_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.coalesce(F.get("ends", F.size("ends") - 1), F.lit(0)).cast("long").alias("n_bytes"))


@_shipped
def op12_align_tokens(spark, sf_dir):
    return token_alignment.digests(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@_shipped
def op13_periodic_runs(spark, sf_dir):
    docs = periodic_runs.planted(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periodic_runs.digests(periodic_runs.find_runs(docs))


def queries() -> dict:
    found = [op1_pack_sequences, op2_order_minhash, op3_format_chats, op4_simhash_near_duplicates, op5_scan_secrets, op6_suffix_dedup, op7_extract_pages, op8_identify_language, op9_token_shards, op10_decontaminate, op11_encode_pieces, op12_align_tokens, op13_periodic_runs]
    return {f.__name__: f for f in found}


#: Words of five as in decontaminate: lower-cased runs of letters and digits.
_OP10_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
si AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS s FROM i WHERE len(w) > 0),
ni AS (SELECT item_id, count(*) AS n FROM si GROUP BY 1),
widths AS (SELECT DISTINCT least(len(w), 5) AS k FROM i WHERE len(w) > 0),
sd AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, CAST(len(w) - k + 2 AS BIGINT)), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS s FROM d, widths WHERE len(w) >= k)
SELECT doc_id, item_id, any_value(n)::BIGINT AS n_shingles, count(*)::BIGINT AS n_shared, count(*) / any_value(n) AS containment
FROM sd JOIN si USING (s) JOIN ni USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= ceil(any_value(n) * 0.8)
"""

ORACLE_SQL = {"op10_decontaminate": _OP10_SQL}
