"""The corpus pipeline: documents go through language ID, line dedup, near-duplicate removal, secret masking and packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept; its result is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigilframe.llm import hilbert, jaccard, langid, linededup, registry, secrets
from sigilframe.llm.shared import delete, scratch, temporary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null texts, and texts without a letter (numerals are none), the empty one included. A null lang
    becomes the predicted language where its score is langid.FILL or more; a given lang stays. Repeated rows and rows with a null
    doc_id are judged by their text like any other; long texts are read whole. Without labelled rows every text with a letter stays. An empty table stays empty; other
    columns pass untouched, whatever their names."""
    return langid.keep_known(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least five documents hold stay in the last of them only, that with the largest doc_id. Every row stays; a text may become empty. Rows that
    share a doc_id count as one document; a row with a null doc_id, and a null text, stays as it is. n_chars follows the new text; other columns pass untouched."""
    return linededup.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, four fifths of the shingles) stays: that with the smallest doc_id, a null one last. Rows equal in
    doc_id and text are one document; of different texts of that doc_id the one of the smaller hash stays. Texts that are null or without words stay. Other
    columns pass untouched."""
    return jaccard.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every row stays, null and empty texts, null doc_ids and repeated rows as well. n_chars follows the new text."""
    return secrets.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences. A null or empty text is the end id alone; rows with a null or repeated doc_id are packed one after the other; an empty
    table gives no pieces; other columns play no part."""
    return hilbert.digest(docs, registry.vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Language ID learns a model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. What a stage read is deleted once its result is written; the table that the last stage's result reads stays."""
    docs, before = registry.documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        with temporary(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.schema(kept.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
