"""The corpus pipeline: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents. Rows with a
null doc_id pass the filtering stages; null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm import langid, neardup, packing, quality, suffixes
from plenum.llm.common import save
from plenum.llm.langid import fold
from plenum.llm.queries import table, tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REJECT_BELOW = 0.35  # of quality; under 0.5, for clean documents of a word or two say little


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.select(COLUMNS).join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, no letter) go; a missing language is filled in.

    Repeated rows and rows of one doc_id are judged each for itself; if any of a doc_id has no
    language, all of it go. Rows with a null doc_id stay as they are.
    """
    found = save(langid.identify(docs, langid.learn(docs.where(fold(4) != 2))).select("doc_id", "lang_pred"), "languages")
    filled = docs.select(COLUMNS).join(docs.where("lang IS NULL").select("doc_id").join(found, "doc_id").groupBy("doc_id").agg(F.min("lang_pred").alias("guess")), "doc_id", "left")
    return without(filled.withColumn("lang", F.coalesce("lang", "guess")), found.where("lang_pred = 'und'"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under REJECT_BELOW go, with all rows of their doc_id; rows with a null doc_id stay.

    The classifier learns from the labelled documents that reach it; without any, all scores are
    those of a network that has learned nothing.
    """
    model = quality.learn(docs.where(fold(3) != 1), table(spark, sf_dir, "labels"))
    return without(docs, quality.score(docs, model).where(F.col("score") < REJECT_BELOW))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id; rows with a null doc_id stay."""
    return without(docs, neardup.near_duplicates(docs).where("NOT kept"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of strings go from the texts; what a cut leaves of a character becomes U+FFFD."""
    kept = suffixes.remove_later_copies(docs).select("doc_id", F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
    about = docs.groupBy("doc_id").agg(F.min("lang").alias("lang"), F.min("source").alias("source"))
    same = kept["doc_id"].eqNullSafe(about["doc_id"])
    return kept.join(about, same, "left").select(kept["doc_id"], "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of 2048 tokens; null and empty texts are the end token alone."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("quality", keep_quality),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # the stages' models and packing are beyond SQL; tests hold them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
