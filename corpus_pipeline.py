"""From raw documents to packed training sequences, stage by stage.

Each stage works on the rows its predecessor kept.  All stages but the last return the columns
of ``documents``; extra columns pass through, nulls, repeated rows and empty tables as each
operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from listingflow.llm import classifier, decontaminate, linededup, nearcopies, packing
from listingflow.llm.common import read, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the random field calls bad go; without labels all stay."""
    chain = classifier.train(docs, read(spark, sf_dir, "labels"))
    slim = docs.withColumnsRenamed({c: f"own_{c}" for c in docs.columns if c != "text"})
    kept = classifier.score_documents(slim, chain).filter("predicted = 1")
    return kept.select(*((f"own_{c}" if c != "text" else c) for c in docs.columns)).toDF(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; documents stay, also those left empty."""
    return linededup.drop_repeated_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle similarity 0.8 or more stays, that with the smallest doc_id."""
    return nearcopies.keep_first_of_groups(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with edits, go."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality), ("line dedup", lines), ("near dedup", near_copies),
    ("benchmark decontamination", benchmark), ("packing", pack),
]

#: The classifier's scores have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        path = shared_folder(spark, f"stage-{i}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
