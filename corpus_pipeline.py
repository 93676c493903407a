"""A corpus pipeline: language ID, near-duplicate removal, substring dedup, mixing, tokens.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs.  All but the last return the columns of documents; columns besides those are left out.

Every stage takes nulls in any column, empty and very long texts, and empty tables.  Rows are judged by their own text, so repeated
rows fare alike but for near_duplicates, which leaves one; only doc_id and text decide, never lang or source (from which the
language model learns) or n_chars.
"""

from __future__ import annotations

import public_tokenizers
from polyagg.llm import bpe, langid, mixing, parity_sketch, suffix_array
from polyagg.llm.common import Workspace, table
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The score from which a language counts as told; texts in two of the languages have a half or less.
SURE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be told: a null text, no letters, or a score under SURE.  Where no row names a language
    there is nothing to learn from, and all go."""
    model = langid.train(docs, ~langid.held_out())
    seen = langid.identify(docs.select(*COLUMNS), model, COLUMNS[1:])
    return seen.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest id (null counts as largest), of equal ids that of the
    smallest checksum.  Texts without words are linked with nothing and stay."""
    return parity_sketch.one_of_each(docs.select(*COLUMNS))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a document of a smaller id has go; a document of which nothing is left goes with them.  Rows of equal
    ids leave each other alone, and rows with a null id and null texts stay as they are."""
    return suffix_array.without_repeats(docs.select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw documents by the rates that bring toxic text's expected tokens down to those in documents less toxic than not.  Null and empty texts
    have no tokens and the membership of the mean; without labels all memberships are even."""
    docs = docs.select(*COLUMNS)
    labels = mixing.quality_domains(table(spark, sf_dir, "labels"))
    return mixing.thinned(docs, labels, "toxic")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, and whether they decode to its text; none for null and empty texts."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = docs.select(*COLUMNS).withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    coded = bpe.round_trip(docs, path, pattern)
    return coded.select(
        "doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"),
        (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"),
    )


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Stages use models, hashes and merges that SQL cannot express; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = space.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
