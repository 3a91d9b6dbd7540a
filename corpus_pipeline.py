"""Corpus preparation: STAGES over documents, each working on all that its predecessor kept.

Documents the quality classifier rejects go; of each group of near duplicates the row with the smallest doc_id
stays; documents that hold a benchmark window go; secrets in the texts of the rest are replaced; what is left is
packed into sequences. All stages but the last return the columns of documents. A stage judges rows, not ids: it
numbers the rows of its input, so rows that repeat a doc_id or have none are judged by their own text, and of
rows that are alike in all columns one stays. Rows are dropped by an anti join on the numbers to drop, which
are sent to every task only while they are few; texts then stay where they lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import BROADCAST_BYTES, fold, materialize, numbered, table
from panelforge.llm.decontamination import decontaminate
from panelforge.llm.near_dedup import near_duplicates
from panelforge.llm.packing import pack_documents
from panelforge.llm.quality import fit, keep_quality
from panelforge.llm.secrets import example_findings, redact, train


ROW = "_row"


def _without(docs: DataFrame, rows: DataFrame, tag: str) -> DataFrame:
    """The numbered docs without some rows."""
    rows = materialize(rows.select(F.col("doc_id").alias(ROW)), tag)
    return docs.join(F.broadcast(rows) if rows.count() * 16 <= BROADCAST_BYTES else rows, ROW, "left_anti").drop(ROW)


def _by_row(docs: DataFrame) -> DataFrame:
    return docs.select(F.col(ROW).alias("doc_id"), "text")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = fit(docs.filter(fold("doc_id", 3) != 1), table(spark, sf_dir, "labels"))
    return keep_quality(docs, net)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = numbered(docs, ROW)
    found = materialize(near_duplicates(_by_row(docs)).select(F.col("doc_id").alias(ROW), "component_id"), "copies")
    groups = materialize(found.groupBy("component_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("component_id"), "groups")
    few = F.broadcast if groups.count() * 32 <= BROADCAST_BYTES else lambda df: df  # a row for each group of copies
    members = found.join(few(groups), "component_id").join(docs.select(ROW, "doc_id"), ROW)
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(ROW).alias(ROW))  # a null doc_id comes last
    best = members.groupBy("component_id").agg(F.min(first)[ROW].alias("best"))
    copies = members.join(few(best), "component_id").filter(F.col(ROW) != F.col("best"))
    return _without(docs, copies.select(F.col(ROW).alias("doc_id")), "dropped-copies")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = numbered(docs, ROW)
    return _without(docs, decontaminate(_by_row(docs), table(spark, sf_dir, "benchmark")).filter("contaminated"), "contaminated")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs, train(example_findings()))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier, the forest and the tokenizer have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
