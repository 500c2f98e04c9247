"""Insight log sink and source.

Records keep the reference's shape ``{insight, timestamp}`` (ISO-8601 UTC with milliseconds); our
records add the keys ``page_url`` and ``seq`` [ours]. The sink appends JSON lines instead of
rewriting one whole JSON array, so writers never read the log back and tasks can append in
parallel. Each append has a key (a job or an epoch) and a folder of its own, which counts once its writer
has committed; a repeated append replaces it, and one that was killed half-way is not read. The source reads
such a log, plain JSON lines and files that hold one JSON array, and finds out which it is.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx as J
from .array_log import has_arrays, records

LOG_SCHEMA = (
    "page_url string, seq bigint, timestamp string, "
    "insight struct<summary: string, sentiment: string, topics: array<string>, toxicityScore: double, raw: string>"
)
APPEND = "append="  # folder of one append
# Fixed value: timestamp format of the log records.
ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def insight_record(ins_col: str = "ins"):
    """The logged ``insight`` object: the parsed fields, or ``{summary, raw}`` for raw replies."""
    ins = F.col(ins_col)
    payload = ins["payload"]
    raw = ins["status"] == "raw"
    return F.struct(
        ins["summary"].alias("summary"),
        F.when(~raw, F.try_variant_get(payload, "$.sentiment", "string")).alias("sentiment"),
        F.when(~raw & J.is_array(J.field(payload, "$.topics")), ins["topics"]).alias("topics"),
        F.when(~raw, ins["toxicity"]).alias("toxicityScore"),
        ins["raw"].alias("raw"),
    )


def append_insights(insights: DataFrame, path: str, ins_col: str = "ins", key: str | int | None = None) -> None:
    """Append one JSON line per truthy insight with the current UTC time. ``key`` names the append (a job, an
    epoch); the same key again replaces what it wrote. Without a key every call is an append of its own."""
    key = uuid.uuid4().hex if key is None else str(key)
    if not re.fullmatch(r"[\w.-]+", key):
        raise ValueError("a key is made of letters, digits, dots, dashes and underscores")
    recs = insights.filter(F.col(f"{ins_col}.ok")).select(
        "page_url", "seq",
        F.date_format(F.current_timestamp(), ISO_MILLIS).alias("timestamp"),
        insight_record(ins_col).alias("insight"),
    )
    recs.write.mode("overwrite").json(f"{path.rstrip('/')}/{APPEND}{key}")


def _committed(spark: SparkSession, path: str) -> list[str] | None:
    """Folders of the committed appends of a log; None: the path holds none (plain files). [] also: no path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    if not fs.getFileStatus(p).isDirectory():
        return None
    found = [s.getPath() for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName().startswith(APPEND)]
    done = [f.toString() for f in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
    return done if found else None


def read_insights(spark: SparkSession, path: str) -> DataFrame:
    """The log as rows; a missing path gives an empty table."""
    folders = _committed(spark, path)
    if folders is None:
        if has_arrays(spark, path):
            # a log is read in its order; the ranges of the sort are dealt over tasks
            return records(spark, path).orderBy("file", "record").select(F.from_json("json", LOG_SCHEMA).alias("r")).select("r.*")
        folders = [path]
    if not folders:
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.schema(LOG_SCHEMA).json(folders)


def log_quality(log: DataFrame, keys=("page_url",)) -> DataFrame:
    """A9 over a log: records, raw fallbacks, empty summaries, records with topics."""
    i = F.col("insight")
    return log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(i["raw"].isNotNull()).alias("n_raw"),
        F.count_if(F.coalesce(i["summary"], F.lit("")) == "").alias("n_empty_summary"),
        F.count_if(i["topics"].isNotNull()).alias("n_with_topics"),
    )
