"""Exact de-duplication by composable polynomial fingerprints (operator 7).

The normalised text (white space removed) is read as a number in base 256 modulo a 128-bit prime.
``combine`` joins the fingerprints of adjacent chunks by shifting the left one by the length of the
right one, so the chunks of a huge document are hashed in parallel. Rows with equal (fingerprint,
length) are then compared chunk by chunk: per (fingerprint, chunk number) the smallest and the
largest chunk must be the same bytes. The comparison pre-aggregates before the shuffle, so a group
that holds a third of all rows costs one row per task and chunk. Groups that differ in any chunk
(a collision) are split by their SHA-256.

Defined cases: null text counts as empty; empty texts form one group; a null ``doc_id`` sorts after
all others; of repeated identical rows exactly one is kept (the first by file and row index);
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS_BYTES, scratch, stored, with_row_key, without_rows

PRIME = 2**128 - 159
HUGE_BYTES = 1 << 20  # longer texts are hashed in parallel chunks of this size
COMPARE_BYTES = 1 << 16
FILTER_BITS = (1 << 16, 1 << 28)  # bounds of the bitmap of repeated fingerprints (32 MB at most)


def fingerprint(data: bytes) -> int:
    return int.from_bytes(data, "big") % PRIME


def combine(left: int, right: int, right_bytes: int) -> int:
    """Fingerprint of the concatenation of two chunks."""
    return (left * pow(256, right_bytes, PRIME) + right) % PRIME


def _hash_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole short texts: fingerprint, normalised length and SHA-256."""
    for b in batches:
        fps, lens, shas = [], [], []
        for v in b.column("_bin"):
            data = (v.as_py() or b"").translate(None, WS_BYTES)
            fps.append(fingerprint(data).to_bytes(16, "big"))
            lens.append(len(data))
            shas.append(hashlib.sha256(data).hexdigest())
        cols = [b.column(c) for c in ("_file_key", "_row_index", "_id", "_chars")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(fps, pa.binary()), pa.array(lens, pa.int64()), pa.array(shas, pa.string())],
                                         names=["_file_key", "_row_index", "_id", "_chars", "fp", "nbytes", "text_sha256"])


def _hash_chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps, lens = [], []
        for v in b.column("_chunk"):
            data = v.as_py().translate(None, WS_BYTES)
            fps.append(fingerprint(data).to_bytes(16, "big"))
            lens.append(len(data))
        cols = [b.column(c) for c in ("_file_key", "_row_index", "_no")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(fps, pa.binary()), pa.array(lens, pa.int64())], names=["_file_key", "_row_index", "_no", "h", "n"])


def _combine_chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps, lens = [], []
        for parts in b.column("_parts").to_pylist():
            fp = total = 0
            for p in parts:
                fp = combine(fp, int.from_bytes(p["h"], "big"), p["n"])
                total += p["n"]
            fps.append(fp.to_bytes(16, "big"))
            lens.append(total)
        yield pa.RecordBatch.from_arrays([b.column("_file_key"), b.column("_row_index"), pa.array(fps, pa.binary()), pa.array(lens, pa.int64())],
                                         names=["_file_key", "_row_index", "fp", "nbytes"])


def fingerprints(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge_bytes: int = HUGE_BYTES) -> DataFrame:
    """``(_file_key, _row_index, _id, _chars, fp, nbytes, text_sha256)`` per row of a keyed frame."""
    base = rows.select("_file_key", "_row_index", F.col(id_col).cast("bigint").alias("_id"),
                       F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("bigint").alias("_chars"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_bin"))
    schema = "_file_key bigint, _row_index bigint, _id bigint, _chars bigint, fp binary, nbytes bigint, text_sha256 string"
    short = base.filter(F.octet_length("_bin") <= huge_bytes).mapInArrow(_hash_rows, schema)
    huge = base.filter(F.octet_length("_bin") > huge_bytes)
    meta = huge.select("_file_key", "_row_index", "_id", "_chars",
                       F.sha2(F.translate(F.col("_bin").cast("string"), WS_BYTES.decode(), ""), 256).alias("text_sha256"))
    last = F.floor((F.octet_length("_bin") - 1) / huge_bytes).cast("int")
    chunks = huge.select("_file_key", "_row_index", "_bin", F.explode(F.sequence(F.lit(0), last)).alias("_no"))
    chunks = chunks.select("_file_key", "_row_index", "_no", F.substring("_bin", F.col("_no") * huge_bytes + 1, F.lit(huge_bytes)).alias("_chunk"))
    hashed = chunks.repartition("_file_key", "_row_index", "_no").mapInArrow(_hash_chunks, "_file_key bigint, _row_index bigint, _no int, h binary, n bigint")
    parts = hashed.groupBy("_file_key", "_row_index").agg(F.sort_array(F.collect_list(F.struct("_no", "h", "n"))).alias("_parts"))
    combined = parts.mapInArrow(_combine_chunks, "_file_key bigint, _row_index bigint, fp binary, nbytes bigint")
    huge_rows = meta.join(combined, ["_file_key", "_row_index"]).select(*[c.split()[0] for c in schema.split(", ")])
    return short.unionByName(huge_rows)


def _emit_chunks(bits: int, words, chunk_bytes: int):
    """Normalised chunks of the texts whose fingerprint may be repeated (bitmap test)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            size = 0
            for v in b.column("_bin"):
                data = (v.as_py() or b"").translate(None, WS_BYTES)
                fp = fingerprint(data)
                bit = fp % bits
                if not words.value[bit >> 3] >> (bit & 7) & 1:
                    continue
                for no, at in enumerate(range(0, max(1, len(data)), chunk_bytes)):
                    for o, x in zip(out, (fp.to_bytes(16, "big"), len(data), no, data[at:at + chunk_bytes])):
                        o.append(x)
                size += len(data)
                if size > 1 << 23:
                    yield _chunk_batch(out)
                    out, size = ([], [], [], []), 0
            if out[0]:
                yield _chunk_batch(out)

    return run


def _chunk_batch(out) -> pa.RecordBatch:
    types = (pa.binary(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types)], names=["fp", "nbytes", "no", "chunk"])


def _bitmap(fps: DataFrame, bits: int) -> bytearray:
    """OR of one bit per repeated fingerprint; Spark builds it in 4 KB buckets."""
    low = F.conv(F.right(F.hex("fp"), F.lit(14)), 16, 10).cast("bigint")  # fp modulo a power of two below 2**56
    bit = F.pmod(low, F.lit(bits)).alias("bit")
    buckets = (fps.select(bit).select(F.floor(F.col("bit") / 32768).alias("b"), F.pmod("bit", F.lit(32768)).alias("p"))
               .groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect())
    out = bytearray(bits // 8)
    for r in buckets:
        out[r["b"] * 4096:r["b"] * 4096 + 4096] = r["m"]
    return out


def colliding(rows: DataFrame, repeated: DataFrame, text_col: str = "text", chunk_bytes: int = COMPARE_BYTES) -> DataFrame:
    """Keys ``(fp, nbytes)`` under which some chunk of two texts differs (streaming comparison of all
    texts with a repeated key)."""
    spark = rows.sparkSession
    n = repeated.count()
    bits = FILTER_BITS[0]
    while bits < 16 * n and bits < FILTER_BITS[1]:
        bits *= 2
    words = spark.sparkContext.broadcast(bytes(_bitmap(repeated, bits)))
    chunks = rows.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_bin")).mapInArrow(
        _emit_chunks(bits, words, chunk_bytes), "fp binary, nbytes bigint, no bigint, chunk binary")
    per = chunks.groupBy("fp", "nbytes", "no").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi"))
    return per.filter(F.col("lo") != F.col("hi")).select("fp", "nbytes").distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge_bytes: int = HUGE_BYTES,
                chunk_bytes: int = COMPARE_BYTES) -> DataFrame:
    """One row per input row: ``_file_key, _row_index`` (its identity), ``doc_id, keep_id, group_size,
    kept, text_sha256``. The row with the most code points, then the smallest id, stays."""
    rows = with_row_key(docs)
    fps = scratch(fingerprints(rows, id_col, text_col, huge_bytes), "fingerprints")
    order = F.struct((-F.col("_chars")).alias("c"), F.col("_id").isNull().alias("z"), F.col("_id").alias("i"),
                     F.col("_file_key").alias("f"), F.col("_row_index").alias("r"))
    keys = ["fp", "nbytes"]
    repeated = scratch(fps.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best")).filter("group_size > 1"), "repeated")
    bad = scratch(colliding(rows, repeated, text_col, chunk_bytes), "collisions")
    if bad.limit(1).count():  # split those groups by content
        split = fps.join(bad, keys, "left_semi").groupBy(*keys, "text_sha256").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best"))
        winners = repeated.join(bad, keys, "left_anti").withColumn("_sha", F.lit(None).cast("string")).unionByName(split.withColumnRenamed("text_sha256", "_sha"))
    else:
        winners = repeated.withColumn("_sha", F.lit(None).cast("string"))
    w = winners.withColumnsRenamed({k: f"_w_{k}" for k in keys})
    on = (fps["fp"] == w["_w_fp"]) & (fps["nbytes"] == w["_w_nbytes"]) & (w["_sha"].isNull() | (w["_sha"] == fps["text_sha256"]))
    x = fps.join(w, on, "left")
    own = F.col("best").isNull()
    return x.select(
        "_file_key", "_row_index", F.col("_id").alias("doc_id"),
        F.when(own, F.col("_id")).otherwise(F.col("best.i")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (own | ((F.col("best.f") == F.col("_file_key")) & (F.col("best.r") == F.col("_row_index")))).alias("kept"),
        "text_sha256",
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    docs = stored(docs)
    return without_rows(docs, exact_dedup(docs, id_col, text_col).filter(~F.col("kept")))
