"""The corpus pipeline: documents -> language -> near copies -> benchmark -> secrets -> packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a stage's result is written as Parquet and read again
as the next one's docs. All but the last return the columns of docs, whatever else these hold. Every stage judges a row by
its own text, so repeated rows fare alike, but for near copies, where one row of a group stays. Very long texts are read
in bounded slices. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridpulse.llm import decontam, langid, packing, secrets, simhash
from gridpulse.llm.common import Scratch, free_name

#: Documents whose best language is less likely than this are rejected, besides those without a letter.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; `und` and undecided ones go.

    NULL and empty texts and texts without a letter are `und`. Where no row has a language there is nothing to learn and
    nothing to judge by, and all rows stay.
    """
    model = langid.fit(docs)
    if not len(model.languages):
        return docs
    predict = langid.language_udf(spark, model)
    name = free_name(docs, "lang_found")
    found = docs.withColumn(name, predict("text"))
    return found.where((F.col(f"{name}.lang_pred") != model.settings.unknown) & (F.col(f"{name}.score") >= LEAST_SCORE)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id.

    NULL and empty texts are copies of each other. Rows with a NULL doc_id take no part and stay; of rows equal in doc_id
    and text one stays.
    """
    return simhash.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, nor a passage within an edit distance of a fifth of its words.

    NULL and empty texts hold none and stay; an empty benchmark lets all rows stay.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), passages=True)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced in their texts; NULL and empty texts stay as they are."""
    return secrets.redact(docs, secrets.default_forest(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed token sequences; a NULL or empty text is the end id alone."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark", benchmark), ("secrets", secret_scan), ("packing", pack)]

#: Models and token ids are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
