"""The corpus pipeline: documents pass the stages in order, each on all that the one before kept.

1. quality: documents that the classifier rejects go.
2. near_duplicates: of each class of near copies one document stays, that of the least doc_id.
3. decontamination: documents with any passage of the benchmark go, however long they are.
4. secrets: credentials are replaced in the text; every document stays.
5. packing: the documents' tokens in windows, a row for each piece.

All but the last return the columns of documents. Null texts count as empty; equal rows are one class of near copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from braidwin.llm import decontaminate, ngram_join, packing, quality, secret_scan
from braidwin.llm.common import table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model).where("predicted = 1").select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.first_of_each(docs).select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("n_hit = 0").select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [("quality", keep_quality), ("near_duplicates", one_of_each), ("decontamination", decontaminated), ("secrets", without_secrets), ("packing", packed)]
#: SQL can't express a trained model or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = written(docs, name)
    return docs
