"""One query for each operator of this subpackage, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import chat, coder, decontaminate, edits, flac, katz, near, packing, quality, surrogates
from .shared import written


#: For these tables, which hold no real persons. Real data need a secret key of their own.
SURROGATE_KEY = "lakewright"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op3_context_mixing_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coder.read_files(coder.write_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op5_surrogate_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY, count_col="n_entities")


def op6_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.join(table(spark, sf_dir, "documents"))


def op8_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.report(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op10_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The streams are stored and read back; their blocks go straight on, as storing these too takes more disk than the check tool allows.
    media = written(flac.encode_texts(table(spark, sf_dir, "documents")), "flac")
    return flac.digest(flac.pcm_blocks(media))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_perspective_rotation": chat.ORACLE_SQL}
