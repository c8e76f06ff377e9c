"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of few bytes that cost much each: dealt to all cores, as files are cut by bytes only."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, 2))


def rounded(x: Column, name: str, digits: int = 4) -> Column:
    return F.round(x.cast("double"), digits).alias(name)
