"""Parse-quality summary of insights or an insight log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_quality(df: DataFrame, keys=(), status_col: str = "status", summary_col: str = "summary") -> DataFrame:
    """Counts of parsed / salvaged / raw replies and of empty summaries per key group."""
    s = F.col(status_col)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(s == "parsed").alias("n_parsed"),
        F.count_if(s == "salvaged").alias("n_salvaged"),
        F.count_if(s == "raw").alias("n_raw"),
        F.count_if(F.coalesce(F.col(summary_col), F.lit("")) == "").alias("n_empty_summary"),
    )
