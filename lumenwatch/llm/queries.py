"""The thin queries: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, huffman, jaccard, language, lattice, lexical, lines, neighbours, packing, pii, resample, substrings, urls
from .common import scratch, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op4_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/ids-{uuid.uuid4().hex}"
    huffman.write(table(spark, sf_dir, "documents"), path)
    return huffman.read(spark, path, with_ids=False)


def op5_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op6_redirect_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(urls.RULES, "host string, path string, verdict string"))


def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = language.fold(5, 0)
    model = language.learn(docs.where(~held))
    return language.identify(docs.drop("lang"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "languages", "shares")


def op10_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.find(docs, pii.fit(docs)))


def op9_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.cluster(table(spark, sf_dir, "embeddings"))


def op7_vertical_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"))


def op2_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents").select("doc_id", "text"), ~language.fold(7, 2))


def op3_fm_index_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(table(spark, sf_dir, "documents"), with_text=False)


def op11_bitsliced_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicate(table(spark, sf_dir, "documents"), with_text=False)


def op13_bag_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_subword_lattice, op3_fm_index_substrings, op4_huffman_token_files, op5_fm_index_decontamination, op6_redirect_url_filter, op7_vertical_jaccard, op8_language_mixture, op9_projection_forest, op10_boosted_pii, op11_bitsliced_resampling, op12_line_dedup, op13_bag_lexical_search)}


def oracle_sql() -> dict[str, str]:
    return {"op3_fm_index_substrings": substrings.SQL, "op5_fm_index_decontamination": decontaminate.SQL, "op6_redirect_url_filter": urls.SQL, "op7_vertical_jaccard": jaccard.SQL, "op9_projection_forest": neighbours.SQL, "op11_bitsliced_resampling": resample.SQL, "op12_line_dedup": lines.SQL, "op13_bag_lexical_search": lexical.SQL}
