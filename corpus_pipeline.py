"""A training corpus from raw documents: five stages, each written and read again by the next.

toxicity -> near-duplicates -> benchmark leaks -> secrets -> mixture.  All but the last return the columns
of ``documents``; the last returns the rows the mixture takes, with their size and the words taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bag_minhash, credentials, decontaminate, mixing, toxicity
from weftline.llm._common import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the threshold; the model is trained on the labels table.

    Scoring and filtering are one narrow pass over the rows.
    """
    params = toxicity.ToxicityParams()
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels"), params), params)
    return toxicity.filtered(docs, model, params=params)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the smallest id."""
    return bag_minhash.kept(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets and linked credentials masked and the character count brought up to date."""
    masked = credentials.redacted(docs)
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text, lang, source, n_chars, size, source_size, target, taken of the documents the mixture takes words from.

    ``taken`` is the number of words to read, whole passes first; it is at most three times the size.
    """
    return mixing.attached(docs, staged(mixing.mix(docs).where("taken > 0"), "mix-taken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("mixture", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained models, signatures and flows have no SQL form; tests compare a run with brute force.
ORACLE_SQL = None
