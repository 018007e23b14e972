"""All core queries: importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.operators import units
from skein.plans import answering_queries, feature_queries, language_queries, preparation_queries, retrieval_queries, stats_queries, text_queries  # noqa: F401
from skein.plans.registry import QUERIES, SQL, query  # noqa: F401
from skein.sources.tables import table


@query()
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Visit values not recorded in kilograms or degrees Celsius, converted."""
    return units.converted(table(spark, d, "visits"), table(spark, d, "clinics"))
