"""T5: the idea store of a stream, kept up release by release.

Each round's released batches go through the insight and idea joins once. Their store rows (grain page, batch,
idea; a batch is released in one round) are written into a folder of the epoch. Beside them a totals table with
grain ``(page_url, idea)`` is folded: counts and sums are added, the first examples and the first place are kept, all
of them mergeable, so a round reads the buckets of its pages and not the releases before. An epoch counts
once its manifest is written; a replayed one overwrites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.idea_store import MAX_EXAMPLES, idea_events, idea_store
from .state import BucketTable, Manifest, bucket_of, read_epochs

STORE = (
    "page_url string, batch_id int, idea string, first_seq bigint, first_pos int, cnt bigint, sentiment_sum bigint, "
    "examples array<string>, n_topics bigint, topics array<string>, n_reasons bigint, reasons array<string>"
)
TOTALS = (
    "page_url string, idea string, cnt bigint, sentiment_sum bigint, n_batches bigint, "
    "first struct<batch_id:int,seq:bigint,pos:int>, examples array<struct<batch_id:int,place:int,example:string>>"
)


def partial_totals(store: DataFrame) -> DataFrame:
    """Totals of some store rows (:data:`TOTALS`): a row has at most ``MAX_EXAMPLES`` examples."""
    examples = F.transform("examples", lambda x, i: F.struct(F.col("batch_id"), i.cast("int").alias("place"), x.alias("example")))
    first = F.struct("batch_id", F.col("first_seq").alias("seq"), F.col("first_pos").alias("pos"))
    return _fold(store.select("page_url", "idea", "cnt", "sentiment_sum", F.lit(1).cast("bigint").alias("n_batches"), first.alias("first"), examples.alias("examples")))


def _fold(parts: DataFrame) -> DataFrame:
    x = parts.groupBy("page_url", "idea").agg(
        F.sum("cnt").alias("cnt"), F.sum("sentiment_sum").alias("sentiment_sum"), F.sum("n_batches").alias("n_batches"), F.min("first").alias("first"),
        F.slice(F.array_sort(F.flatten(F.collect_list("examples"))), 1, MAX_EXAMPLES).alias("examples"))
    return x.select("page_url", "idea", "cnt", "sentiment_sum", "n_batches", "first", "examples")


class IncrementalStore:
    """``on_release`` of a :class:`postmine.streaming.stream.Release`. ``with_ideas(posts)`` joins released posts
    with their insights and ideas (the input of :func:`postmine.operators.idea_store.idea_events`)."""

    def __init__(self, spark: SparkSession, folder: str, with_ideas, buckets: int = 64):
        self.spark, self.folder, self.with_ideas, self.buckets = spark, folder.rstrip("/"), with_ideas, buckets
        self.manifest = Manifest(spark, f"{self.folder}/manifest")
        self.totals_table = BucketTable(spark, f"{self.folder}/totals", TOTALS)

    def __call__(self, posts: DataFrame, epoch: int) -> None:
        path = f"{self.folder}/store/epoch={epoch}"
        idea_store(idea_events(self.with_ideas(posts))).write.mode("overwrite").parquet(path)
        new = self.spark.read.schema(STORE).parquet(path)
        touched = [r[0] for r in new.select(bucket_of("page_url", self.buckets).alias("b")).distinct().collect()]
        base = self.manifest.before(epoch).get("totals", {})
        merged = _fold(self.totals_table.read(base, touched).unionByName(partial_totals(new)))
        version = self.totals_table.write(merged, epoch, self.buckets, touched, base)
        self.manifest.commit(epoch, {"totals": version})
        self.totals_table.drop_older(epoch, base, version)

    def store(self) -> DataFrame:
        """Store rows of all batches released so far."""
        return read_epochs(self.spark, f"{self.folder}/store", self.manifest.epochs(), STORE)

    def totals(self) -> DataFrame:
        """Totals per page and idea over the batches released so far."""
        return self.totals_table.read(self.manifest.before(None).get("totals", {}))
