"""Reading the tables of a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table `name` of a directory (a file or a folder of files); columns are pruned by what is used."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
