"""Readers of the input tables."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``, through Spark's reader only, so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
