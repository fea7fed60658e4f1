"""The corpus pipeline: quality rules, near-duplicate removal, mixing, and pieces.

Each stage is written as Parquet and read again. It is rebuilt from its input if it fails; no stage keeps state elsewhere.

Nulls: a document without text or words fails the quality rules; one without host is judged by its own measures; one without id is never a
duplicate, and is drawn like any other. Repeated rows become one at the second stage (without id, they stay). Ties go to the smallest id.
An empty table gives none at each stage. Further columns stay, whatever their names, up to the last stage, which returns them beside the pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cirrostrat.llm.host_rules import keep_documents
from cirrostrat.llm.minhash import keep_one_of_each
from cirrostrat.llm.mixing import mix_sources
from cirrostrat.llm.pieces import encode_documents
from cirrostrat.llm.queries import tokenizer_file
from cirrostrat.runtime import stash, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go, as do those with more symbols than their host's rate of failures allows, and all of a host over half of which fails."""
    return keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more."""
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it; what the mix doesn't take goes."""
    mix = "mix"
    while mix in docs.columns:
        mix += "_"
    times = F.col(f"{mix}.epochs") + F.col(f"{mix}.drawn").cast("long")
    mixed = mix_sources(docs, out=mix).withColumn(mix, times).filter(F.col(mix) > 0)
    return mixed.withColumn(mix, F.explode(F.sequence(F.lit(1).cast("long"), F.col(mix)))).drop(mix)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and lang with the ids of the text."""
    return encode_documents(docs, tokenizer_file("piece_bpe_32k.model")).drop("n_chars")


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("mixing", mixing), ("pieces", pieces)]

#: SQL has no form for the signatures and the pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
