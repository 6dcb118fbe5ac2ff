"""A corpus pipeline of five stages over ``documents``.

Texts whose language is not recognised go; of near-duplicates one stays;
personal data is blanked; sources are mixed to their target weights; what is
left is tokenized. Each stage reads all that its predecessor kept, and all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import langid, mixing, pii, sentencepiece, simhash
from lodestone.llm.common import held_out, shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language, which ``lang`` then names; learned from the documents that are not held out.

    Null, empty and letterless texts are rejected, and all if no row names a
    language. Of equal cosines the first language counts; repeated rows all stay
    or all go; texts are read whole and never leave the JVM with a verdict.
    Columns beyond those of ``documents`` are left out, here and in all stages.
    """
    model = langid.fit(docs.filter(~held_out(F.col("doc_id"))))
    got = langid.identify(docs, model, keep=("text", "source", "n_chars"))
    return got.filter(~F.col("rejected")).withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id.

    A null id counts only where a group has no other; of equal ids with other
    texts the least hash of the text decides, of equal rows one stays. Texts
    without words are one group.
    """
    return simhash.representatives(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the names of its kinds; null texts stay null, repeated rows repeat, spans that overlap become one."""
    return pii.redact(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; a document that it takes from twice has two rows.

    A null source is one of its own, the last. Documents without words go, and
    so do those of which nothing is taken; equal rows are documents of their own.
    """
    return mixing.mixed_documents(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, n_byte_tokens, ids, decoded) of each row; of null texts null ids and zero counts, of empty ones no ids."""
    return sentencepiece.round_trip(docs, sentencepiece.load(spark))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix", mix),
    ("tokens", tokens),
]

#: SQL cannot express hashing to fingerprints, clustering, EM or random draws; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written as Parquet to the shared folder and read again."""
    docs, root = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
