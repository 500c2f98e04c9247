"""Integer vectors shared by the vector operators: cleaning, scaling, bounds and batches as matrices."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch

SCALE = 256
MAX_COMPONENT = 1 << 26  # of a scaled component; larger ones could overflow 64-bit sums of products


@dataclass
class IntVectors:
    rows: DataFrame  # id, label, v array<int>
    dim: int  # components of the vector with the smallest id; 0 for an empty table
    largest: int  # largest absolute component of these
    count: int


def finite(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))


def _scaled(x: Column) -> Column:
    y = x.cast("double") * SCALE
    over = F.raise_error(F.lit(f"a scaled component is larger than {MAX_COMPONENT}")).cast("int")
    return F.when(F.abs(y) > MAX_COMPONENT, over).otherwise(F.floor(y).cast("int"))


def int_vectors(df: DataFrame, id_col: str, vec_col: str, label: Column, name: str, labelled: bool = False) -> IntVectors:
    """Rows whose vector (and label, if ``labelled``) is there, with finite components only, each component floored after scaling, written
    once; components beyond ``MAX_COMPONENT`` are an error. The table's dimension is that of its smallest id (repeated ids: of the shortest vector)."""
    d = df.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(vec_col).alias("v"))
    if labelled:
        d = d.filter("label IS NOT NULL")
    rows = scratch(d.filter(finite(F.col("v"))).select("id", "label", F.transform("v", _scaled).alias("v")), name)
    most = F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x))), F.lit(0))
    s = rows.agg(F.min(F.struct(F.col("id").isNull(), "id", F.size("v").alias("d"))).alias("m"), F.max(most).alias("a"), F.count(F.lit(1)).alias("n")).first()
    return IntVectors(rows, int(s["m"]["d"]) if s["m"] else 0, int(s["a"] or 0), int(s["n"]))


def matrix(batch: pa.RecordBatch, dim: int, column: str = "v") -> np.ndarray:
    """The vectors of a batch whose rows all have ``dim`` components."""
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, dim).astype(np.int64)
