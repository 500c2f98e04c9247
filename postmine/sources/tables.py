"""Sources (S1, S2, S3): seed lists, page snapshots, posts from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trim_ws


def seed_urls(df: DataFrame, col: str = "line") -> DataFrame:
    """Split on ``,``, trim each entry, keep blanks and order (``ord`` 0-based)."""
    others = [c for c in df.columns if c != col]
    return df.select(*others, F.posexplode(F.split(F.col(col), ",")).alias("ord", "raw")).select(
        *others, "ord", trim_ws("raw").alias("url")
    )


def read_pages(spark: SparkSession, path: str, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Page snapshots ``(page_id, page_url, html)`` from parquet."""
    return spark.read.parquet(path).select("page_id", F.col(url_col).alias("page_url"), F.col(html_col).alias("html"))


def stream_pages(spark: SparkSession, path: str, schema: str = "page_id bigint, url string, html string", max_files: int | None = None) -> DataFrame:
    """S3: page snapshots arriving as parquet files in a folder."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path).withColumnRenamed("url", "page_url")
