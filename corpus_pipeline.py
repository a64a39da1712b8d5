"""A training corpus from raw documents, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages it is written as Parquet
and read again, in the folder that driver and executors share. All but the last return the columns of
documents.

Defined cases, of all stages: nulls in any column, empty and very long texts are as the stage's operator says; other columns that
the table may have, whatever their names, pass through all stages but personal_data, which returns the columns of documents;
repeated rows stay where the operator judges rows, and one of them stays in near_dedup; rows with null id stay in near_dedup;
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rallyframe.llm import contamination, minhash, mixing, pii, quality
from rallyframe.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' votes find good; null and empty texts aren't."""
    return quality.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more. Texts without words stay."""
    return minhash.near_duplicate_filter(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts stay."""
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked; n_chars is that of the new text, null for a null text."""
    return pii.sanitise(docs).selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) as n_chars")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with how many it takes; none of texts without words."""
    return mixing.mix(docs).filter("taken > 0")


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("decontamination", decontamination), ("personal data", personal_data), ("mixture", mixture)]
#: Near-dedup, alignment and the fitted votes are beyond SQL; tests hold the stages against plain restatements.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
