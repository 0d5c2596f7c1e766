"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. ``run`` writes
each stage's result to the shared folder and reads it again. A stage's result reads tables of its own only,
so results of one call never depend on what another call deletes.

Defined results, for every stage: a null in any column is passed on as it is; null and empty texts are
rejected by the language stage, and link with nothing, hold no benchmark item and no secret in the others;
repeated rows with one doc_id and one text are one row after near duplicates and are kept by the others; a
row without doc_id is linked with nothing; of equally good representatives the smallest doc_id stays; an
empty table gives an empty result; very long texts are processed whole; columns of any name are passed on
by all stages but the last, which returns the documents' columns, then source_size, target, taken and
first_slot, and size (words of the text).
"""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from vellumetry.llm.common import shared_folder
from vellumetry.llm.decontaminate import clean
from vellumetry.llm.jaccard import one_of_each
from vellumetry.llm.language import accepted, train
from vellumetry.llm.mixing import mix
from vellumetry.llm.secrets import redact


#: Rows of the Arrow batches that stages send to Python: with whole texts, batches of Spark's 10,000 rows take much
#: of an executor's memory outside its heap, which is not given back.
ARROW_ROWS = "1000"


def _begin(spark: SparkSession) -> None:
    """Small batches, and a driver without what the stage before left: broadcast tables, plans, generated classes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the labelled languages; the others go."""
    _begin(spark)
    return accepted(docs, train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of smallest doc_id, for each group linked at 0.8 on five-word shingles."""
    _begin(spark)
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    _begin(spark)
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind in brackets and n_chars counted again."""
    _begin(spark)
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, whole texts with them, how many words it takes, and the slot
    of the schedule that takes the first. ``mixing.pieces`` gives the words slot by slot."""
    _begin(spark)
    return mix(docs, keep=("text", "lang", "n_chars")).where("taken > 0")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("mixing", mixing),
]

#: The language stage is a trained model, which SQL cannot express; tests hold each stage, on its own input,
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, work in STAGES[:-1]:
        path = shared_folder(spark)
        work(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
