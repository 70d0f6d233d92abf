"""The training-text pipeline: stages that each read all that the one before has kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gablework.llm.common import stored, table
from gablework.llm.decontaminate import uncontaminated
from gablework.llm.jaccard_join import near_unique
from gablework.llm.language import identify, trained_on
from gablework.llm.line_dedup import line_dedup
from gablework.llm.packing import best_fit_packing


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without letters or far from every language go."""
    judged = identify(docs, trained_on(docs))
    return judged.where(~F.col("rejected")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand elsewhere; those of which no line is left go."""
    cut = line_dedup(docs)
    return cut.where((F.col("n_removed") == 0) | (F.length("text") > 0)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class."""
    return near_unique(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in benchmark windows."""
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences."""
    return best_fit_packing(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", packing),
]
#: Language identification and tokenising are not expressible in SQL; tests hold the filters' rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is stored in the shared folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
