"""Queries of the training-data operators, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootloom.llm import chat_windows, merkle_manifest, phrase_stripes, url_cascade
from rootloom.llm.fertility_rules import apply_rules
from rootloom.llm.merkle_manifest import audit_documents
from rootloom.llm.packing import pack_documents
from rootloom.llm.page_text import extract_pages
from rootloom.llm.phrase_stripes import collocations
from rootloom.llm.piece_dropout import encode_pieces
from rootloom.llm.quality_qda import classify_quality
from rootloom.llm.shared import table
from rootloom.llm.simhash_index import fingerprint_hex, simhash_classes
from rootloom.llm.token_counts import token_counts
from rootloom.llm.token_frames import new_shard_folder, read_documents, write_shards
from rootloom.llm.topk_histogram import exact_top_k, integer_vectors


def op1_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_pieces(table(spark, sf_dir, "documents"), "piece_bpe_32k.model", dropout=0.1, seed=42)
    return encoded.select("doc_id", "n_bytes", F.size("ids").cast("long").alias("n_pieces"), "ids_crc32", "lossless")


def op2_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judge_urls(table(spark, sf_dir, "pages"))


def op3_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_topk_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(integer_vectors(table(spark, sf_dir, "embeddings"), 64), F.col("vec_id") % 20 == 0, 20)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


def op6_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_shard_folder(spark)
    manifest = write_shards(table(spark, sf_dir, "documents"), folder, "byte_bpe_50k.json", end_id=0)
    return read_documents(manifest, folder, with_ids=False)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_classes(table(spark, sf_dir, "documents"), words=3, distance=2)
    return found.select("doc_id", fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op8_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), "word_bpe_49k.json", 2048)


def op10_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = chat_windows.with_injection(table(spark, sf_dir, "conversations"))
    return chat_windows.conversation_digests(chat_windows.format_conversations(conversations))


def op11_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op12_phrase_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), longest=5, least=100, contained=100, top=2000)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_piece_dropout": op1_piece_dropout,
    "op2_url_cascade": op2_url_cascade,
    "op3_quality_qda": op3_quality_qda,
    "op4_topk_histogram": op4_topk_histogram,
    "op5_token_counts": op5_token_counts,
    "op6_token_frames": op6_token_frames,
    "op7_simhash": op7_simhash,
    "op8_fertility_rules": op8_fertility_rules,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_chat_windows": op10_chat_windows,
    "op11_page_text": op11_page_text,
    "op12_phrase_stripes": op12_phrase_stripes,
    "op13_merkle_manifest": op13_merkle_manifest,
}
#: DuckDB's list_inner_product over doubles is exact here: scores are far below 2^53.
TOP_K_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""
ORACLES: dict[str, str] = {
    "op4_topk_histogram": TOP_K_SQL,
    "op2_url_cascade": url_cascade.ORACLE,
    "op10_chat_windows": chat_windows.ORACLE,
    "op12_phrase_stripes": phrase_stripes.ORACLE,
    "op13_merkle_manifest": merkle_manifest.ORACLE,
}
