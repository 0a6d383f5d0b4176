"""A corpus pipeline over documents: rules, near-duplicates, decontamination, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
docs of the next; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrainflow.llm.common import read_table, shared_folder
from terrainflow.llm.decontam import contaminated
from terrainflow.llm.packing import pack_documents
from terrainflow.llm.rules import line_rules
from terrainflow.llm.secret_scan import redact, scan_secrets
from terrainflow.llm.similar import one_of_each

#: Benchmark items with fewer words reject no document.
LEAST_WORDS = 5
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, without their failing lines. A document without an id goes, as none can name it."""
    judged = line_rules(docs.where("doc_id is not null"), extra=("lang", "source"))
    kept = judged.where("kept")
    return kept.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast("bigint").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard similarity 0.8 or more): the one with the smallest doc_id.

    Rows with the same doc_id and text count once; rows that share a doc_id only are documents of their own. Rows without an id go.
    """
    return one_of_each(docs.where("doc_id is not null").select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item of LEAST_WORDS words or more: shorter ones are phrases of any text.

    Rows are told by doc_id and text: one that overlaps takes no other row of its doc_id with it.
    """
    row = F.xxhash64("doc_id", "text")
    leaks = contaminated(docs.select(row.alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"), least_words=LEAST_WORDS)
    leaks = leaks.select(F.col("doc_id").alias("_row")).distinct()
    return docs.withColumn("_row", row).join(leaks, "_row", "left_anti").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark."""
    clean = redact(scan_secrets(docs)).withColumn("n_chars", F.length("text").cast("bigint"))
    return clean.select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secrets),
    ("packing", packing),
]

#: Near-duplicate groups, the Markov models and the packing plan have no SQL form; tests hold each stage to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; each result but the last is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
