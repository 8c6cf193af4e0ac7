"""A corpus pipeline: language ID, toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import language_id, near_dedup, packing, suffix_dedup, toxicity
from skein.llm.common import held_out
from skein.llm.queries import TOXIC_AT, tokenizer_path
from skein.session import Scratch, results_freed, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Language predictions below this score are no decision; a document is also rejected if it has no letter.
LEAST_LANGUAGE_SCORE = 0.3


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; lang becomes the language found.

    Null and empty texts and texts without a letter go; repeated rows stay as often as they occur; of equal scores the
    alphabetically first language wins; columns besides those of documents are left out; no rows give no rows.
    """
    model = language_id.train(docs.where(~held_out(5, 0)))
    found = language_id.identify(docs, model, keep=COLUMNS)
    kept = found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def by_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold.

    Null and empty texts have the score of a text without known terms; labels with a null id or mark teach nothing;
    repeated rows are judged alike; a score at the threshold goes; columns besides those of documents are left out; no rows
    give no rows.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out(3, 1)))
    return toxicity.score(docs, model, keep=COLUMNS).where(F.col("score") < TOXIC_AT).select(*COLUMNS)


def by_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the smallest doc_id, and one of its rows if it has several.

    Rows with a null text or id stay; texts without words are alike only if equal; columns besides those of documents are
    left out; no rows give no rows.
    """
    return near_dedup.one_of_each(docs.select(*COLUMNS))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 bytes or more that a smaller doc_id has; n_chars counts what is left.

    Every row stays, if need be with an empty text; null texts stay null; rows of one id never remove from each other, and a
    null id counts as the largest; columns besides those of documents are left out; no rows give no rows.
    """
    cut = suffix_dedup.remove_repeats(docs, carry=("text", "lang", "source", "n_chars"), with_text=True)
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    return cut.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length(text).cast("long")).alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, piece by piece.

    A null or empty text is the closing id alone; repeated rows are packed as often as they occur; no rows give no rows.
    """
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", by_language),
    ("toxicity", by_toxicity),
    ("near_dedup", by_near_duplicates),
    ("suffix_dedup", without_repeats),
    ("packing", packed),
]
#: The stages train models and hash texts, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What the stages write between them is deleted once the next stage has read it; the last table
    stays in the shared folder until the application ends."""
    docs = table(spark, sf_dir, "documents")
    scratch, before = Scratch(spark), ""
    try:
        for name, stage in STAGES:
            with results_freed(spark):
                docs = scratch.write(stage(spark, docs, sf_dir), name)
            if before:
                scratch.drop(before)
            before = name
    finally:
        scratch.close(keep=before)
    return docs
