"""Posts seen before, over any number of rounds, with a bounded look at the past.

The posts seen lie in buckets by page, one folder per epoch and bucket. Beside every bucket stands a Bloom filter
of fixed size (a row of 64-bit words). A round probes the filters of its buckets: a post that a filter does not
know is new without a look at the table; for the others only their buckets are read, and an exact anti join
tells the posts seen from the filter's false positives. A full filter costs time, never results. A bucket
with many epochs is rewritten as one. An epoch counts once its manifest is written; a replayed one overwrites.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_table, materialize
from .state import BucketTable, Manifest, bucket_of

SEEN = "page_url string, post string"
FILTERS = "page_bucket int, words array<bigint>"
BUCKETS, BITS, HASHES = 64, 1 << 20, 4
EPOCHS = 16  # of a bucket before it is rewritten


class SeenPosts:
    """``new(posts, epoch)`` gives the rows of ``posts`` (``page_url, post, ...``) that no earlier epoch had, and
    remembers them. The filters of one round are at most ``buckets * bits / 8`` bytes (8 MB by default)."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, bits: int = BITS, hashes: int = HASHES, epochs: int = EPOCHS):
        if bits % 64:
            raise ValueError("bits must be a multiple of 64")
        self.spark, self.buckets, self.bits, self.hashes, self.epochs = spark, buckets, bits, hashes, epochs
        self.folder = folder.rstrip("/")
        self.manifest = Manifest(spark, f"{self.folder}/manifest")
        self.filters = BucketTable(spark, f"{self.folder}/filters", FILTERS)
        self.metrics: dict[int, dict[str, int]] = {}

    def _positions(self) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(k), "page_url", "post"), F.lit(self.bits)) for k in range(self.hashes)]

    def _seen(self, versions: dict[str, list[int]], buckets: list[int]) -> DataFrame:
        paths = [f"{self.folder}/seen/epoch={e}/bucket={b}" for b in buckets for e in versions.get(str(b), [])]
        return self.spark.read.schema(SEEN).parquet(*paths) if paths else self.spark.createDataFrame([], SEEN)

    def _state(self, epoch: int) -> dict:
        earlier = [e for e in self.manifest.epochs() if e < epoch]
        if not earlier:
            return {"filters": {}, "seen": {}}
        return json.loads(self.spark.read.text(f"{self.manifest.path}/epoch={earlier[-1]}").first()["value"])

    def new(self, posts: DataFrame, epoch: int) -> DataFrame:
        state = self._state(epoch)
        held = {int(b): e for b, e in state["filters"].items()}
        probe = materialize(posts.select("*", bucket_of("page_url", self.buckets).alias("_bucket"), *[p.alias(f"_p{k}") for k, p in enumerate(self._positions())]))
        touched = [r[0] for r in probe.select("_bucket").distinct().collect()]  # at most ``buckets``
        old = self.filters.read(held, touched)
        words = F.broadcast(old.withColumnRenamed("page_bucket", "_b"))  # a row of fixed size per bucket
        x = probe.join(words, probe["_bucket"] == words["_b"], "left")
        known = " AND ".join(f"shiftright(get(words, cast(_p{k} div 64 AS int)), cast(_p{k} % 64 AS int)) & 1 = 1" for k in range(self.hashes))
        x = materialize(x.withColumn("_maybe", F.coalesce(F.expr(known), F.lit(False))).drop("words", "_b", *[f"_p{k}" for k in range(self.hashes)]))
        maybe = x.filter("_maybe")
        suspects = [r[0] for r in maybe.select("_bucket").distinct().collect()]
        wrong = materialize(maybe.join(self._seen(state["seen"], suspects).distinct(), ["page_url", "post"], "left_anti").select(*x.columns))
        out = materialize(x.filter("NOT _maybe").unionByName(wrong).drop("_maybe"))
        self._remember(out, old, state, held, touched, epoch)
        self.metrics[epoch] = {"rows": x.count(), "suspects": maybe.count(), "false_positives": wrong.count(), "buckets_read": len(suspects)}
        for t in (probe, x, wrong):
            drop_table(t)
        return out.drop("_bucket")

    def _remember(self, new: DataFrame, old: DataFrame, state: dict, held: dict[int, int], touched: list[int], epoch: int) -> None:
        path = f"{self.folder}/seen/epoch={epoch}"
        full = [b for b in touched if len(state["seen"].get(str(b), [])) >= self.epochs]
        rows = new.select("page_url", "post").distinct()
        if full:  # buckets of many epochs become one again
            rows = rows.unionByName(self._seen(state["seen"], full))
        rows.withColumn("bucket", bucket_of("page_url", self.buckets)).hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(path)
        seen = {b: list(e) for b, e in state["seen"].items()}
        for b in self.filters.names(path, "bucket="):
            seen[str(b)] = [epoch] if b in full else [*seen.get(str(b), []), epoch]
        place = F.explode(F.array(*self._positions())).alias("p")
        bits = new.select("_bucket", "page_url", "post").distinct().select("_bucket", place)
        one = F.expr("shiftleft(1L, cast(pmod(p, 64) AS int))")
        bits = bits.groupBy("_bucket", F.floor(F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(one).alias("v"))
        bits = bits.groupBy("_bucket").agg(F.map_from_entries(F.collect_list(F.struct("w", "v"))).alias("m"))
        # at most one row a bucket; a word that neither side has stays 0
        x = bits.join(old, bits["_bucket"] == old["page_bucket"], "full")
        at = lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("bigint"))
        empty = F.array_repeat(F.lit(0).cast("bigint"), self.bits // 64)
        merged = F.transform(F.coalesce("words", empty), lambda w, i: w.bitwiseOR(at(i.cast("int"))))
        x = x.select(F.coalesce("_bucket", "page_bucket").alias("page_bucket"), merged.alias("words"))
        version = self.filters.write_buckets(x.withColumn("bucket", F.col("page_bucket")), epoch, touched, held)
        self.manifest.commit(epoch, {"filters": version, "seen": seen})
        self.filters.drop_older(epoch, held, version)
