"""Shared plumbing for the registered queries: table loading and the recorded-reply fixtures."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from . import fixtures as FX

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
# Character joining ordered lists into one comparable string column.
SEP = chr(31)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _view_names(spark: SparkSession, sf_dir: str, names) -> dict[str, str]:
    tag = hashlib.sha1(sf_dir.rstrip("/").encode()).hexdigest()[:10]
    out = {}
    for n in names:
        v = f"pm_{tag}_{n}"
        table(spark, sf_dir, n).createOrReplaceTempView(v)
        out[n] = v
    return out


def fixture(spark: SparkSession, sf_dir: str, template: str, names=("documents",)) -> DataFrame:
    """Run a fixture template (``@table@`` placeholders) on Spark over the parquet tables."""
    return spark.sql(FX.sql(template, _view_names(spark, sf_dir, names)))


def duck(template: str) -> str:
    """The same template for DuckDB, where the tables are registered under their own names."""
    return FX.sql(template, {n: n for n in TABLES})
