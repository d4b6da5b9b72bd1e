"""The corpus pipeline: quality rules, n-gram Jaccard join, benchmark decontamination,
personal data, packing. Each stage takes (spark, docs, sf_dir) and works on all documents
that the stage before it kept; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, ngram_join, packing, pii, quality_rules, scratch
from quillspark.plans.ship import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    ship(spark)
    ruled = quality_rules.apply_rules(docs)
    return ruled.filter(F.col(ruled.columns[-1]).isNull()).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links connect: the one with the smallest id."""
    ship(spark)
    comp = ngram_join.jaccard_components(docs, count_links=False).filter("component_id = doc_id").select("doc_id")
    return docs.join(comp, "doc_id", "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    ship(spark)
    hits = decontaminate.contaminated(docs, scratch.table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(hits, "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in sequences."""
    ship(spark)
    out = packing.pack(docs, packing.word_pieces_path())
    return out.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality_rules", quality),
    ("ngram_join", near_duplicates),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("packing", pack),
]

#: Decontamination, bootstrapping and packing are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each result is written and read again."""
    docs = scratch.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
