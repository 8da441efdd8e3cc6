"""The corpus pipeline: quality rules, near duplicates, benchmark passages, source mix, token files.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``, rows of their input as they were.  A stage's
output is written to the shared checkpoint folder and read back as the next one's input.

Defined results: a null text has no words and goes at the quality rules, as does an empty one; null ids,
languages and sources are values of their own; of equal rows one stays; very long texts are judged whole; further columns, also
ones with names of the stages' results, are passed on as they are until the last stage; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import col, staged, table
from panelspark.llm.decontaminate import clean_documents
from panelspark.llm.mixing import mix
from panelspark.llm.neardup import keep_first
from panelspark.llm.quality import apply_rules
from panelspark.llm.tokens import encode_corpus, public_tokenizer


def _packed(docs: DataFrame, *names: str) -> DataFrame:
    """Every row as ``row`` beside copies of the named columns, so that no name of the row can clash."""
    return docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), *[col(n) for n in names])


def _unpacked(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = apply_rules(_packed(docs, "text", "lang", "source"), keep=["row"])
    return _unpacked(judged.filter("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near duplicates."""
    return keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    mixed = mix(_packed(docs, "doc_id", "text", "source"), keep=["row"]).filter("copies > 0")
    return _unpacked(mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))), docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files hold of every document."""
    return encode_corpus(docs, public_tokenizer(spark), literals=True)


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mixture),
    ("token-ID / binary output", token_files),
]

# Weighted samples and byte-pair ids have no SQL form; tests/llm/test_pipeline.py tests every stage and the run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "pipeline")
    return docs
