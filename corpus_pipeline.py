"""From raw documents to sampled pieces, in stages that are each written and read again.

Toxic documents go; of alike lines only the first stays; of each group of near copies one document stays; sources are mixed to their
weights, whole documents as often as the mix takes them; texts are cut into sampled pieces.

Every stage gives an empty table for an empty one, and keeps other columns than those it works on as they are. Null texts are not toxic, have no
lines to lose, are linked with nothing, weigh nothing in the mix (which takes them like others of their source) and have no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.llm import line_dedup, minhash, mixing, pieces, toxicity
from wavecrest.llm.queries import table, tokenizer_path
from wavecrest.llm.shared import column_name, cut, drop


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold of their guessed language. Repeated rows are scored one by one; without labelled rows
    nothing is learned and no document goes."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=docs.columns).where("__score < 0.5").drop("__score")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier line matches; documents that lose every line go. n_chars follows the text."""
    cleaned = line_dedup.clean_documents(docs)
    return cleaned.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("bigint")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents but those that are linked to one of a smaller id. Of rows that repeat an id with the same text the first by their other
    columns, told as JSON, stays; rows that repeat it with other texts are one document and stay or go together. Rows with a null id stay.

    Texts are linked from a similarity of 0.8; 36 bands of 5 miss a pair of that similarity less than once in a million."""
    key = column_name(docs, "__key")
    near = minhash.near_duplicates(docs, percent=80, functions=90, rows=5)
    gone = cut(near.where("not kept").select(F.col("doc_id").alias(key)).distinct())
    again = cut(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias("n")).where("n > 1").select(key))
    same = F.col("doc_id") == F.col(key)
    once = docs.join(gone.unionAll(again).distinct(), same, "left_anti")
    repeated = docs.join(again.join(gone, key, "left_anti"), same, "left_semi")
    one = column_name(docs, "__one")
    other = F.to_json(F.struct(*(c for c in docs.columns if c not in ("doc_id", "text"))))  # a map has no order, its text has
    first = repeated.groupBy("doc_id", "text").agg(F.min_by(F.struct(*docs.columns), other).alias(one))
    return once.unionAll(first.select(*(F.col(one)[c].alias(c) for c in docs.columns)))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it. Rows that repeat an id are taken alike."""
    key, copies = column_name(docs, "__mixed"), column_name(docs, "__copies")
    mixed = mixing.mix_sources(docs).groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").cast("int").alias(copies)).where(F.col(copies) > 0)
    taken = docs.join(mixed, F.col("doc_id").eqNullSafe(F.col(key)))
    return taken.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces, ids and text_crc32 of each document."""
    return pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"), keep=["lang", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_copies),
    ("mixing", mix_to_weights),
    ("sampled pieces", to_pieces),
]

#: A trained classifier and hashed draws have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
        if before is not None:
            drop(before)
        before = docs
    return docs
