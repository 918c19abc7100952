"""A corpus cleaning pipeline: quality, near duplicates, repeated passages, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of
``documents`` (the last: token ids). ``run`` writes each stage as Parquet in the shared folder, rereads it and
deletes the one before.

Empty tables give empty tables. Null and empty texts pass every stage: there is nothing to judge, link, cut or hit.
Rows with a null id are never rejected or dropped for another row's sake, nor do they cut or drop another; rows that
repeat an id go or stay together in the first two stages, and are one document in the third.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespark.llm import byte_bpe, decontaminate, ngram_join, quality, substring_dedup
from kinespark.llm.common import write_shared

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. All rows of an id go if one is rejected; a null id stays."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    judged = quality.classify(docs, trusted)
    rejected = write_shared(judged.where("not keep").select("doc_id").where("doc_id is not null").distinct(), "rejected")
    return docs.join(rejected.df.hint("merge"), "doc_id", "left_anti").select(*COLUMNS)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component of near duplicates (five words, 0.8); empty texts and null ids stay,
    and so do all rows of an id that stays."""
    found = ngram_join.near_duplicates(docs, words=5, threshold=(80, 100), count_links=False)
    gone = write_shared(found.where("component_id < doc_id").select("doc_id").distinct(), "duplicates")
    return docs.join(gone.df.hint("merge"), "doc_id", "left_anti").select(*COLUMNS)


def _with_text(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that an earlier document holds are cut; documents of which nothing is left go. Null ids are
    neither cut nor cut others; rows of one id don't cut each other."""
    kept = substring_dedup.dedup_substrings(docs, window=50, keep=("lang", "source", "text", "n_chars"))
    cut = kept.where("n_removed = 0 or kept_text <> ''")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", text.alias("text"), "lang", "source", chars.alias("n_chars"))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with words of a benchmark window go, row by row."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(docs, items, keep=("lang", "source", "text", "n_chars"))
    return found.where("n_hit = 0").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids (packed little-endian 32-bit), n_tokens, digests of the ids and of the decoded bytes of each
    row; a null text has no ids."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode_decode(docs, ranks, public_tokenizers.PATTERN, keep=("lang", "source"), outputs=("ids", "n_tokens", "ids_sha256", "decoded_sha256"))
    return coded.select("doc_id", "lang", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_group),
    ("substring dedup", remove_repeats),
    ("benchmark decontamination", remove_benchmark),
    ("byte-level BPE", encode),
]

#: The language model and the merges are beyond SQL; the tests check every stage by brute force (the first, whose model
#: no SQL holds, against a plain model of its operator).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        table = write_shared(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-').lower()}")
        if before is not None:
            before.drop()
        docs, before = table.df, table
    return docs
