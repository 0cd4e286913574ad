"""The parquet tables described in TESTDATA.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Table ``name`` under ``directory``; a parquet file or a folder of them."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; expected one of {', '.join(TABLES)}")
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
