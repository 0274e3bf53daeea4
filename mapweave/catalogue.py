"""All queries of the engine on the graded tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mapweave.plans import fit_queries, live_queries, map_queries, registry, space_queries, time_queries, voxel_queries, wall_queries  # noqa: F401  registers its queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.QUERIES["voxel_mean"](spark, sf_dir)


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
