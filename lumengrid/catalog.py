"""All queries over the driver's tables, and for each the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import audits, coding, formats, further, imaging, modes, more, samples, variants  # noqa: F401  (registers its queries)
from .plans.registry import QUERIES, SQL  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["q_flagship_tile_entropy"](spark, sf_dir)
