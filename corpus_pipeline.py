"""From raw documents to token ids: language, near copies, repeated passages, benchmark leaks, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again for the next one.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseraql.llm import bpe, decontaminate, langid, simhash, substrings
from tesseraql.llm.frames import table
from tesseraql.llm.scratch import drop, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told (no text or no letter) go; those without a label get the one found."""
    parser = langid.learn(docs.where(langid.remainder("doc_id", 3) != 1))
    told = langid.identify(docs, parser, lang_pred="__lang", score="__score").where("__lang <> 'und'")
    return told.withColumn("lang", F.coalesce("lang", "__lang")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.one_of_each(docs).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated windows go; a document that loses none keeps its text as it is."""
    cut = substrings.remove_repeats(docs, kept="__kept", n_words="__n", n_removed="__removed")
    text = F.when(F.col("__removed") > 0, F.col("__kept")).otherwise(F.col("text"))
    cut = cut.withColumn("text", text)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast("long"))
    return cut.select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    key = F.concat_ws(":", F.xxhash64("doc_id", "text").cast("string"), F.xxhash64("text", "doc_id").cast("string"))
    found = decontaminate.contaminated(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return docs.withColumn("__key", key).join(found.select(F.col("doc_id").alias("__key")).distinct(), "__key", "left_anti").select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of each text that is left."""
    coded = bpe.encode_decode(docs.select("doc_id", "text"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_copies),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_leaks),
    ("bpe_encoding", encoding),
]

#: Fingerprints, recompression, edit matching and BPE have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
