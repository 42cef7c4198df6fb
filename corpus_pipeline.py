"""From raw documents to packed training windows: STAGES in order, each on all that the one before kept.

Every stage is one operator of ``voxtable.llm`` over the whole table it is given. The two classifiers learn from the labelled documents of their
own input. Documents keep their columns up to the last stage, which returns where each document lies in the token windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.llm import jaccard, packing, quality, toxicity
from voxtable.llm.common import remainder, table
from voxtable.session import written

#: Near-duplicates: five-word shingles, Jaccard similarity of 0.8 or more.
WORDS, PERCENT = 5, 80
#: Rows without an id are named from here on, after all others, by a hash of their text.
UNNAMED = 1 << 62


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    score = _free(docs, "score")
    return quality.scored(docs, model, score).where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network does not reject."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    score = _free(docs, "score")
    return toxicity.scored(docs, model, score).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates; rows without an id come after all others, and of equal rows one stays.

    Documents without words belong to no group and stay.
    """
    mark, own, stamp = F.xxhash64("text"), _free(docs, "name"), _free(docs, "mark")
    name = F.coalesce(F.col("doc_id").cast("long"), F.lit(UNNAMED) + F.shiftrightunsigned(mark, 2))
    named = docs.withColumn(own, name)
    groups = jaccard.similar_components(named.select(F.col(own).alias("doc_id"), "text"), WORDS, PERCENT)
    first = groups.where("doc_id = component_id").select(F.col("doc_id").alias(own))
    return named.join(first, own, "left_semi").withColumn(stamp, mark).dropDuplicates([own, stamp]).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document, or each piece of a long one, lies in the token windows."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality), ("toxicity", drop_toxic), ("near_duplicates", one_of_each), ("packing", packed),
]
#: SQL has no trained networks; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
