"""A training corpus from raw documents: five stages, each an operator of turnwise.llm.

Each stage works on all that the one before kept; all but the last return the
columns of documents. Quality rejections go, repeated lines go, one document of
each near-duplicate class stays, personal data is masked, and what is left is
packed into windows. Every operator treats nulls, empty texts and repeated rows
as its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnwise.llm import line_dedup, mixture_packing, ngram_join, pii_bootstrap, quality_gam
from turnwise.llm.common import materialise, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality model rejects."""
    return quality_gam.keep(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove every line that an earlier one matches; documents of which nothing is left go."""
    return line_dedup.without_repeats(docs, drop_emptied=True)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates."""
    return ngram_join.one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind."""
    return pii_bootstrap.masked(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into windows of 4096 tokens."""
    return mixture_packing.pack(docs, with_ids=False)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", one_of_each),
    ("PII", mask_personal_data),
    ("packing", pack),
]
#: SQL can't express the classifier, the extraction and the tokens; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
