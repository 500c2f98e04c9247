"""JSON records of files of any shape, read by many tasks.

A file holds one JSON array of objects or objects one after another (JSON lines, pretty-printed or not). It is read
as text in pieces that end at ``}``, so Spark splits it at any byte range, one long line included. What a piece
does to the reader is a function of one bit, whether it starts inside a string: quotes flip it, and it
decides which brackets count. These functions compose, so a scan over the pieces of a range, one over the
ranges of a file and the sum of both give the state and the nesting depth at every piece; a record ends where the
depth falls back to its level. No task reads a whole file, and the shape follows from the first bracket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

END = "}"


def _brackets(texts: Column) -> Column:
    """Opening less closing brackets of some texts."""
    x = F.array_join(texts, "")
    return (F.regexp_count(x, F.lit(r"[\[{]")) - F.regexp_count(x, F.lit(r"[\]}]"))).cast("bigint")


def pieces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, block, row, text`` in the order ``(file, block, row)``; ``quotes``: parity of the quotes, and
    ``d0``, ``d1``: brackets counted if the piece starts outside or inside a string, its end ``}`` included."""
    t = spark.read.option("lineSep", END).text(paths)
    t = t.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("row"), F.col("value").alias("text"))
    t = materialize(t)  # the numbers of the rows must not change
    parts = F.split(F.regexp_replace("text", r"\\.", ""), '"')
    t = t.withColumn("_p", parts).withColumn("quotes", ((F.size("_p") - 1) % 2).cast("int"))
    side = lambda s: F.filter("_p", lambda x, i: i % 2 == s)
    closing = lambda inside: F.when(F.col("quotes") == inside, -1).otherwise(0)
    return t.select("file", "block", "row", "text", "quotes", (_brackets(side(0)) + closing(0)).alias("d0"), (_brackets(side(1)) + closing(1)).alias("d1"))


def records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, record, json``: the objects of the files, numbered per file from 0."""
    p = pieces(spark, paths)
    before = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("_in", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int"))  # if the range starts outside
    # brackets so far in the range, for both states at its start
    start = lambda s: F.when(F.col("_in") == s, F.col("d0")).otherwise(F.col("d1"))
    upto = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("_s0", F.sum(start(0)).over(upto)).withColumn("_s1", F.sum(start(1)).over(upto))
    p = materialize(p)
    # ranges of a file: one row each
    r = p.groupBy("file", "block").agg((F.sum("quotes") % 2).alias("q"), F.max_by("_s0", "row").alias("e0"), F.max_by("_s1", "row").alias("e1"),
                                       F.min_by("text", "row").alias("head"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("_q", (F.coalesce(F.sum("q").over(earlier), F.lit(0)) % 2).cast("int"))
    r = r.withColumn("_depth", F.coalesce(F.sum(F.when(F.col("_q") == 0, F.col("e0")).otherwise(F.col("e1"))).over(earlier), F.lit(0)))
    array = F.first(F.ltrim(F.col("head"), F.lit("\ufeff \t\r\n")).startswith("[")).over(Window.partitionBy("file").orderBy("block"))
    r = r.select("file", "block", "_q", "_depth", array.cast("int").alias("_level"))
    x = p.join(r, ["file", "block"])
    inside = (F.col("_in") + F.col("quotes") + F.col("_q")) % 2 == 1  # at the end of the piece
    depth = F.col("_depth") + F.when(F.col("_q") == 0, F.col("_s0")).otherwise(F.col("_s1"))
    x = x.withColumn("_end", (~inside & (depth == F.col("_level"))).cast("int"))
    # records end inside a range before a piece, and in earlier ranges
    x = x.withColumn("_no", F.coalesce(F.sum("_end").over(before), F.lit(0)))
    ends = x.groupBy("file", "block").agg(F.sum("_end").alias("n"))
    ends = ends.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_ends"))
    x = x.join(ends, ["file", "block"]).select("file", (F.col("_no") + F.col("_ends")).alias("record"), "block", "row", "text", "_end")
    g = x.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "row", "text"))).alias("t"), F.max("_end").alias("whole"))
    text = F.array_join(F.transform("t", lambda s: s["text"]), END)
    # what follows the last record (brackets, white space) ends no record
    return g.filter("whole = 1").select("file", "record", F.concat(F.regexp_replace(text, r"^[\x{FEFF}\s,\[]+", ""), F.lit(END)).alias("json"))


def has_arrays(spark: SparkSession, paths: str | list[str]) -> bool:
    """Does any file start with an array?"""
    t = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.ltrim("value", F.lit("\ufeff \t\r")).alias("value"))
    first = t.filter("block = 0 AND value <> ''").groupBy("file").agg(F.min_by(F.substring("value", 1, 1), "row").alias("c"))
    return first.filter("c = '['").limit(1).count() > 0
