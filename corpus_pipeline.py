"""A corpus pipeline: toxicity, language, near-duplicates, decontamination, and a check of the tokens.

Every stage but near-duplicates judges each row by its own text, so rows with a null or a repeated doc_id are kept or
dropped by themselves, and gives no rows for no rows. All stages but the last pass whole rows on: the columns of docs, whatever further ones
there are. Every stage lets the session's batches be small from then on, as texts are large.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumigrid.llm import bpe, decontaminate, langid, neardup, toxicity
from lumigrid.session import Scratch, small_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier does not call toxic; it learns from labels of these documents.

    A null or empty text has no toxic word. Without labelled rows no row is toxic. Labels are matched by doc_id; a null
    one has none.
    """
    small_batches(spark)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows near a centroid of some language of these documents.

    Texts without a letter, null and empty ones included, are rejected; where no row has a language, all are. Of equal
    cosines the first language in alphabetical order counts; that rejects nothing.
    """
    small_batches(spark)
    return langid.keep_known(docs, langid.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest doc_id, a null one only if there is no other.

    Repeated rows leave one. Texts without words are one group. Of rows with one doc_id the text of least digest stays.
    """
    small_batches(spark)
    return neardup.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text overlaps no benchmark item. A null or empty text overlaps none; no items drop nothing."""
    small_batches(spark)
    return decontaminate.drop_overlapping(docs, table(spark, sf_dir, "benchmark"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For each row doc_id, its ids, their number, and checksums of ids and of the decoded bytes; a null text has no ids."""
    small_batches(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminated),
    ("tokens", tokenized),
]
#: The stages learn models and compare sketches, which SQL does not express; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again by the next, then removed."""
    docs, before = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        own = Scratch(spark)
        docs = own.table(stage(spark, docs, sf_dir), name)
        before.clear()
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
