"""The registered query of each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.llm import collocations, exact_dedup, language_model, lexical_search, line_dedup, neighbours, packing, quality, simhash, spotsigs, toxicity
from labelforge.llm.bpe import BytePairTokenizer
from labelforge.llm.common import crc_fold, table, whole_text
from labelforge.llm.license_scan import license_labels, license_scan

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def _with_fold(scored: DataFrame, held_out: Column) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.interpolated_scores(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_fold(5) == 0
    return _with_fold(toxicity.toxicity(docs, labels, ~held_out), held_out)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_fold(3) == 1
    return _with_fold(quality.quality(docs, labels, ~held_out), held_out)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", license_scan(whole_text()).alias("found"))
    return docs.select("doc_id", *[c.alias(name) for name, c in license_labels(F.col("found")).items()])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bpe = BytePairTokenizer(spark, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
    coded = table(spark, sf_dir, "documents").select("doc_id", bpe.encode_and_decode(whole_text()).alias("coded"))
    both = coded.select("doc_id", "coded.ids", "coded.decoded")
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_with_next(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(50)) == 0)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_deleted_interpolation": op1_deleted_interpolation,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_license_scan": op4_license_scan,
    "op5_line_dedup": op5_line_dedup,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_simhash": op7_simhash,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_spotsigs": op9_spotsigs,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_collocations": op11_collocations,
    "op12_neighbours": op12_neighbours,
    "op13_lexical_search": op13_lexical_search,
}
