"""The corpus pipeline: five stages, each of which works on all that the one before it kept.

ORACLE_SQL is None: no stage but the last can be said in SQL (fitted models, MinHash candidates, packing);
tests/llm holds the pipeline against brute-force versions of its stages.

Defined results: null, empty and very long texts are documents like others (the classifier decides; a null text stays
null until packing, where it is one token); repeated rows and rows without a key that the classifier keeps go on, the
near-duplicate stage keeps one row set for each smallest id and all rows without one; an empty table gives no rows;
further columns of documents travel along to the last stage, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumengrid.llm import common, mixing, neardup, packing, privacy, quality

ORACLE_SQL: str | None = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (operator 1) does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.fit(docs, quality.not_held_out(labels, 3, 1), "quality"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (operator 2): the one with the smallest id."""
    return neardup.without_near_copies(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that disclose it, replaced by their kind (operator 6)."""
    return privacy.sanitised(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Languages brought to their target weights by repeating documents (operator 5); none is lost."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.mixed(docs, mixing.language_labels(docs, labels), mixing.TARGETS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens (operator 9)."""
    return packing.packed(common.written(packing.pieces(docs), "pieces"))


#: Tables that the stage before has written beside its result.
_BESIDE: list[str] = []


def tidy(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage; when it begins, the stage before it has been written and reread, and what that one left is deleted."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.delete(spark, _BESIDE)
        _BESIDE.clear()
        with common.collected() as own:
            out = stage(spark, docs, sf_dir)
        _BESIDE.extend(own)
        return out

    run_stage.__doc__ = stage.__doc__
    return run_stage


STAGES = [
    ("quality classifier", tidy(keep_good)),
    ("near-duplicates", tidy(drop_near_copies)),
    ("personal data", tidy(sanitise)),
    ("mixing", tidy(mix)),
    ("packing", tidy(pack)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again, and all but the last are deleted at the end."""
    docs = common.documents(spark, sf_dir)
    with common.scratch(spark) as kept:
        for k, (name, stage) in enumerate(STAGES):
            write = kept if k == len(STAGES) - 1 else common.written
            docs = write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
