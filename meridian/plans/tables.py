"""Reading of the given tables, and folders for what a query writes."""

from pyspark.sql import DataFrame, SparkSession

from ..operators.steps import scratch

__all__ = ["load", "scratch"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
