"""The corpus pipeline: four filters and the encoder, each over all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditlake.llm import decontaminate, langid, simhash, toxicity
from auditlake.llm.queries import encoded_digests, table
from auditlake.session import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar does not predict toxic; labels outside the held-out part teach it."""
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out())
    return toxicity.clean(docs, toxicity.fit(docs, labels))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence; languages outside the held-out part teach it."""
    return langid.clean(docs, langid.fit(docs.filter(~langid.held_out())))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of linked fingerprints."""
    return simhash.clean(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with less than a twentieth of their words in benchmark windows."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of the token ids and of the decoded text of what is kept."""
    return encoded_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", drop_unknown_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]

# Trained models take part, which SQL can't express; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written as Parquet and read again.

    Null and empty texts are not toxic, tell no language (and go there), and very
    long ones are read whole. Repeated rows stand or fall together; of ties among
    near copies the smallest id stays, rows without id stay. An empty table gives no
    row, and further columns pass through all stages but the last, whatever their names.
    """
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
