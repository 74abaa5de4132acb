"""One query for each operator of this subpackage, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wavecrest.llm import conversations, embeddings, exact_dedup, language, line_dedup, line_quality, minhash, mixing, pieces, token_planes, toxicity, vector_codes, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_kmeans_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_line_frequency_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.line_quality(table(spark, sf_dir, "documents"))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.deduplicated(table(spark, sf_dir, "pages"))


def op4_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.label(docs, language.fit(docs))


def op5_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_bit_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes.token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_flow_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_line_set_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removed_lines(table(spark, sf_dir, "documents"))


def op9_text_cnn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_suffix_automaton_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_conversations(table(spark, sf_dir, "conversations"))


def op12_laesa_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).drop("evaluated")


def op13_digest_run_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kmeans_near_vectors": op1_kmeans_near_vectors,
    "op2_line_frequency_quality": op2_line_frequency_quality,
    "op3_warc_revisits": op3_warc_revisits,
    "op4_crf_language": op4_crf_language,
    "op5_sampled_pieces": op5_sampled_pieces,
    "op6_bit_plane_files": op6_bit_plane_files,
    "op7_flow_mixing": op7_flow_mixing,
    "op8_line_set_similarity": op8_line_set_similarity,
    "op9_text_cnn_toxicity": op9_text_cnn_toxicity,
    "op10_minmax_near_dedup": op10_minmax_near_dedup,
    "op11_suffix_automaton_repair": op11_suffix_automaton_repair,
    "op12_laesa_codes": op12_laesa_codes,
    "op13_digest_run_tree": op13_digest_run_tree,
}

ORACLES: dict[str, str] = {}

ORACLES["op13_digest_run_tree"] = r"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST)"""
