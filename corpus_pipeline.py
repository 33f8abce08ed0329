"""From raw documents to packed training sequences: five stages, each a Spark job over all that its predecessor kept.

1. language: documents without letters go; any mixture of learned languages stays.
2. near_duplicates: of each group of documents linked by a Jaccard similarity of 0.8 or more on 5-word
   shingles, the one with the smallest doc_id stays.
3. decontamination: passages that share a 10-word window with a benchmark item are cut out; documents
   that have no word left then go.
4. pii: personal data is replaced by its kind in brackets.
5. packing: token pieces of all documents, ids included, with their places in sequences of at most 4096 tokens.

All stages but the last return the columns of their input, extra ones included; n_chars follows the text.
Defined cases: rows that repeat a doc_id are one document to stage 2 (one row stays); documents without
a doc_id can't be named as duplicates and stay; null texts go in stage 1; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenwatch.llm import decontaminate, jaccard, language, packing, pii
from lumenwatch.llm.common import save, table


def _wrapped(docs: DataFrame) -> DataFrame:
    """text, and all other columns as one named doc_id, which operators carry along unread: no name can clash."""
    rest = [c for c in docs.columns if c != "text"]
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("doc_id"), "text")


def _unwrapped(found: DataFrame, text: Column, columns: list[str]) -> DataFrame:
    value = {c: F.col("doc_id")[c] for c in columns} | {"text": text}
    if "n_chars" in columns:
        value["n_chars"] = F.length(text).cast("long")
    return found.select(*[value[c].alias(c) for c in columns])


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.learn(docs.select("lang", "text"))
    found = language.identify(_wrapped(docs), model, "text")
    kept = found.where(F.col("lang_pred") != "und")
    return kept.select(*[F.col("text") if c == "text" else F.col("doc_id")[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard.groups(docs.select("doc_id", "text")).where("doc_id IS NOT NULL")
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count():
        kept = kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).union(kept.where("doc_id IS NULL"))
    return kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find(_wrapped(docs), table(spark, sf_dir, "benchmark"), with_text=True)
    hit = F.aggregate(F.zip_with("span_starts", "span_ends", lambda a, b: b - a), F.lit(0), lambda s, x: s + x)
    kept = found.where((F.size("span_starts") == 0) | (hit < F.col("n_words")))
    return _unwrapped(kept, F.col("text"), docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pii.find(_wrapped(docs), pii.fit(docs.select("text")))
    return _unwrapped(found, F.col("redacted"), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [("language", languages), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", personal_data), ("packing", pack)]

#: SQL has no trained models or tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs
