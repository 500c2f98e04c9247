"""Mixing sources to target weights by Poisson replication (operator 3).

A source with token mass ``m`` and target weight ``w`` (weights are normalised over the sources that
have any mass) gets the mean repetition rate ``w * epochs * total / m``. Each document inverts the
Poisson distribution of its source's rate at a uniform number that is a hash of (seed, doc_id, text
digest), is exploded by that count, and the copies are shuffled globally by a second hash.

The distribution function is tabulated per source up to the resolution of the uniform number (52
bits), so no count is cut off. Mass is counted in code points of whole texts, pre-aggregated per task.

Defined cases: null text is empty; a null source is a source of its own; a source without mass or
with weight 0 (or absent from given weights) has rate 0; a null ``doc_id`` hashes as an empty id;
identical repeated rows get the same count; extra columns travel along under their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, scratch, small_join

SEED = "mix-1"
HEX = 13  # hex digits of the hash used: 52 bits, exact in a double


def _hash52(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c), 1, HEX), 16, 10).cast("bigint")


def rates(docs: DataFrame, weights: DataFrame | None = None, source_col: str = "source", text_col: str = "text", epochs: float = 1.0) -> DataFrame:
    """``source, mass, rate`` per source. ``weights``: ``source, weight``; None: equal weights."""
    mass = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.length(F.coalesce(F.col(text_col), F.lit("")))).cast("bigint").alias("mass"))
    mass = scratch(mass, "mix-mass")
    if weights is None:
        x = mass.withColumn("weight", F.when(F.col("mass") > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    else:
        w = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
        x = mass.join(w, mass["source"].eqNullSafe(w["_s"]), "left").drop("_s")
        x = x.withColumn("weight", F.when(F.col("mass") > 0, F.coalesce("weight", F.lit(0.0))).otherwise(F.lit(0.0)))
    total = x.agg(F.sum("weight").alias("w"), F.sum("mass").alias("m")).first()
    w, m = float(total["w"] or 0), float(total["m"] or 0)
    rate = F.col("weight") / F.lit(w) * F.lit(epochs * m) / F.col("mass") if w > 0 else F.lit(0.0)
    return x.select("source", "mass", F.when((F.col("mass") > 0) & (F.col("weight") > 0), rate).otherwise(F.lit(0.0)).alias("rate"))


def distribution(rate: DataFrame) -> DataFrame:
    """Add ``first`` and ``cdf``: P(count <= first + i). Terms are summed outwards from the mean in
    logarithms of ratios, so a large rate neither underflows nor needs a factorial. One row per term, summed
    along the terms of a source (their number grows with the root of its rate)."""
    lam = F.col("rate")
    spread = 12 * F.sqrt(lam) + 40
    x = rate.withColumn("first", F.greatest(F.lit(0).cast("bigint"), F.floor(lam - spread)))
    x = x.withColumn("last", F.when(lam > 0, F.ceil(lam + spread).cast("bigint")).otherwise(F.col("first")))
    key = ["source", "mass", "rate", "first"]  # a source has one row
    x = x.select(*key, F.explode(F.sequence("first", "last")).alias("k"))
    along = Window.partitionBy(*key).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*key)
    log = F.when((lam > 0) & (F.col("k") > F.col("first")), F.log(lam) - F.log(F.col("k").cast("double"))).otherwise(F.lit(0.0))
    x = x.withColumn("_r", F.sum(log).over(along))
    x = x.withColumn("_e", F.exp(F.col("_r") - F.max("_r").over(whole)))
    x = x.withColumn("_c", F.sum(F.col("_e")).over(along) / F.sum("_e").over(whole))
    x = x.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("k", "_c"))).alias("t"))
    return x.select(*key, F.col("t._c").alias("cdf"))


def replicate(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source",
              text_col: str = "text", epochs: float = 1.0, seed: str = SEED) -> DataFrame:
    """Every column of ``docs`` plus struct ``_mix`` (last; more underscores where a column has that name):
    ``rate``, ``copies``, ``copy`` (from 0) and ``key`` (global order). Rows arrive shuffled: dealt to
    partitions and sorted by ``key``."""
    spark = docs.sparkSession
    table = scratch(distribution(rates(docs, weights, source_col, text_col, epochs)), "mix-rates")
    names = [f"c{i}" for i in range(len(docs.columns))]  # free of clashes while internal columns exist
    d = docs.toDF(*names)
    of = {c: names[i] for i, c in enumerate(docs.columns)}
    text = F.coalesce(F.col(of[text_col]), F.lit(""))
    ident = F.concat_ws("|", F.lit(seed), F.coalesce(F.col(of[id_col]).cast("string"), F.lit("")), F.md5(text))
    d = d.withColumn("_src", F.col(of[source_col])).withColumn("_ident", F.md5(ident))
    table = table.select(F.col("source").alias("_src"), F.col("rate").alias("_rate"), F.col("first").alias("_first"), F.col("cdf").alias("_cdf"))
    x = small_join(d, table, ["_src"], salt_by=F.col("_ident"), row_bytes=8 * F.size("_cdf") + 64)
    u = _hash52(F.concat(F.lit("u"), F.col("_ident"))) / F.lit(float(16**HEX))
    # the number of table entries at or below u, by count of the sorted table's prefix
    count = F.when(F.col("_rate") > 0, F.col("_first") + F.size(F.filter("_cdf", lambda c: c <= F.col("_u")))).otherwise(F.lit(0))
    x = x.withColumn("_u", u).withColumn("_copies", count.cast("bigint")).filter("_copies > 0")
    x = x.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1)))
    key = _hash52(F.concat_ws("|", F.lit("order"), F.col("_ident"), F.col("_copy").cast("string")))
    x = x.select(*names, F.struct(F.col("_rate").alias("rate"), F.col("_copies").alias("copies"), F.col("_copy").alias("copy"), key.alias("key")).alias("_mix"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = x.repartition(n, F.col("_mix.key")).sortWithinPartitions(F.col("_mix.key"))
    return x.select(*[F.col(names[i]).alias(c) for i, c in enumerate(docs.columns)], F.col("_mix").alias(free_name("_mix", docs)))
