"""The queries of this package and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import agenda_bpe, bitplane, blockmax, crosspoly, gridcode, hilbert, jaccard, langid, linededup, mjpeg, secrets, spans, trie_bpe
from .shared import documents


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.digest(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op2_bitplane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplane.digest(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goes on with the ledger in the folder that sigilframe.secrets.ledger names; without it, every blob is unseen."""
    return secrets.digest(documents(spark, sf_dir), spark.conf.get("sigilframe.secrets.ledger", None))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.digest(documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(documents(spark, sf_dir))


def op6_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mjpeg.media_digest(documents(spark, sf_dir))


def op7_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspoly.digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.digest(documents(spark, sf_dir))


def op9_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.digest(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op11_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blockmax.digest(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_grid_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridcode.digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_agenda_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agenda_bpe.digest(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


QUERIES = {
    "op1_hilbert_packing": op1_hilbert_packing,
    "op2_bitplane_ids": op2_bitplane_ids,
    "op3_secret_scan": op3_secret_scan,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_line_dedup": op5_line_dedup,
    "op6_avi_media": op6_avi_media,
    "op7_cross_polytope": op7_cross_polytope,
    "op8_sentence_spans": op8_sentence_spans,
    "op9_trie_bpe": op9_trie_bpe,
    "op10_language_id": op10_language_id,
    "op11_block_max": op11_block_max,
    "op12_grid_codes": op12_grid_codes,
    "op13_agenda_pieces": op13_agenda_pieces,
}

ORACLES = {
    "op3_secret_scan": secrets.ORACLE,
    "op5_line_dedup": linededup.ORACLE,
    "op11_block_max": blockmax.ORACLE,
    "op12_grid_codes": gridcode.ORACLE,
}
