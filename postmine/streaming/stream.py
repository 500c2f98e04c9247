"""Structured Streaming operators.

The reference re-reads a growing page up to three times, adds new posts to a per-URL set and releases
one analysis batch per round (the first batch of 10 once enough posts exist, otherwise chunks of 3),
flushing every leftover after the last round. Here each micro-batch of page snapshots is one round:

* T1 ``stream_distinct``: ``dropDuplicatesWithinWatermark`` per (page, post) with a bounded state; without
  a watermark ``dropDuplicates``, whose state grows with the distinct posts.
* T2 ``stream_round_counts``: new distinct posts per page and round (streaming aggregation).
* T3 + T4 :class:`Release`: ``foreachBatch`` over bucketed Parquet state in the checkpoint folder: the keys (SHA-256)
  of the posts of pages that are still open, their texts, and one row per page with its rounds, dry rounds and
  releases. A round reads the buckets of its pages only and rewrites their keys; a text is dealt once for every
  snapshot that has it, written when it is new and written when it is released. Closed pages keep one row, so
  the cost does not grow with the rounds before. New posts are found by an anti join on their keys, the next batch
  is a top-k window, and the rest of a page is released by rule; so no page meets in one task and no post can be lost:
  :meth:`Release.finish` flushes the pages that never reached their last round. An epoch counts once its
  manifest is written; a replayed one starts from the manifest before it and overwrites.
* T5 ``run_stream``: ``foreachBatch`` hands each micro-batch to batch functions; ``Release(on_release=...)`` hands
  on the posts released by each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.batching import CHUNK_SIZE, INITIAL_BATCH, MAX_ROUNDS, top_k_by
from ..session import CODEC, drop_table, materialize
from .state import AppendTable, BucketTable, Manifest, bucket_of, read_epochs

SEEN = "page_url string, seq bigint, post string"
RELEASED = "page_url string, batch_id int, seq bigint, post string, round int"
PAGES = "page_url string, rounds int, dry_rounds int, initial_done boolean, releases int, done boolean"
OPEN = "page_url string, seq bigint, digest binary, arrived bigint, released boolean, tie string"  # tie: the text of a post that shares its place
TEXTS = "page_url string, seq bigint, digest binary, post string"
BUCKETS = 64
EPOCHS = 16  # of a bucket of texts before it is rewritten
LAST_EPOCH = (1 << 31) - 1


def stream_distinct(posts: DataFrame, watermark: tuple[str, str] | None = None, keys=("page_url", "post")) -> DataFrame:
    """First occurrence per (page, post). ``watermark=(ts_col, delay)`` bounds the state."""
    if watermark is None:
        return posts.dropDuplicates(list(keys))
    ts, delay = watermark
    return posts.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_round_counts(distinct_posts: DataFrame, round_col: str = "round") -> DataFrame:
    """T2 / A7 on a stream: new distinct posts per page and round (use ``update`` or ``complete``)."""
    return distinct_posts.groupBy("page_url", round_col).agg(F.count(F.lit(1)).alias("new_found"))


class Release:
    """T3 + T4: releases analysis batches per page as rounds (micro-batches) arrive.

    Give :meth:`round` to ``foreachBatch`` of a stream of ``page_url, seq, post`` snapshots, call
    :meth:`finish` when the input has ended, read :meth:`released`. With every post present from the
    first round the result equals :func:`postmine.operators.batching.plan_batches`.

    ``on_release(posts, epoch)`` is called with the posts of a round's batches before the round counts; it has to
    overwrite what it wrote for that epoch. :attr:`metrics` has the counts of each round (pages, posts read, new
    posts, posts released), observed by the jobs that write its tables."""

    def __init__(self, spark: SparkSession, folder: str, initial: int = INITIAL_BATCH, chunk: int = CHUNK_SIZE, rounds: int = MAX_ROUNDS,
                 buckets: int = BUCKETS, on_release=None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.initial, self.chunk, self.rounds = initial, chunk, rounds
        self.buckets, self.on_release = buckets, on_release
        self.manifest = Manifest(spark, f"{self.folder}/manifest")
        self.tables = {"open": BucketTable(spark, f"{self.folder}/open", OPEN), "pages": BucketTable(spark, f"{self.folder}/pages", PAGES),
                       "texts": AppendTable(spark, f"{self.folder}/texts", TEXTS)}
        self.metrics: dict[int, dict[str, int]] = {}

    def released(self) -> DataFrame:
        return read_epochs(self.spark, f"{self.folder}/released", self.manifest.epochs(), RELEASED)

    def pages(self) -> DataFrame:
        """The state of each page."""
        return self.tables["pages"].read(self.manifest.before(None).get("pages", {}))

    def round(self, batch: DataFrame, epoch: int) -> None:
        """One round of the pages in ``batch``. It is read twice, for its keys and for the texts of its new posts; a
        batch that is dear to compute should be written first."""
        seen = Observation(f"read-{epoch}")
        batch = batch.select("page_url", "seq", "post", F.unhex(F.sha2("post", 256)).alias("digest"))
        keys = materialize(batch.select("page_url", "seq", "digest", bucket_of("page_url", self.buckets).alias("bucket")).observe(seen, F.count("digest").alias("posts_read")))
        touched = [r["bucket"] for r in keys.select("bucket").distinct().collect()]  # at most ``buckets``
        base = self.manifest.before(epoch)
        pages = self.tables["pages"].read(base.get("pages", {}), touched)
        known = self.tables["open"].read(base.get("open", {}), touched)
        # a page whose last round is over has been flushed; its later snapshots are not read
        open_ = keys.select("page_url").distinct().join(pages.filter("done"), "page_url", "left_anti")
        posts = keys.filter(F.col("digest").isNotNull()).groupBy("page_url", "digest").agg(F.min("seq").alias("seq"))
        new = posts.join(open_, "page_url").join(known, ["page_url", "digest"], "left_anti")
        new = new.withColumn("tied", F.count(F.lit(1)).over(Window.partitionBy("page_url", "seq")) > 1)
        found = Observation(f"new-{epoch}")
        new = materialize(new.select("page_url", "seq", "digest", "tied").observe(found, F.count(F.lit(1)).alias("new_found")))
        texts, ties = self._add_texts(batch, new, pages, base.get("texts", {}), touched, epoch)
        arrived = new.join(ties, ["page_url", "digest"], "left").select(
            "page_url", "seq", "digest", F.lit(epoch).cast("bigint").alias("arrived"), F.lit(False).alias("released"), "tie")
        state = open_.join(pages, "page_url", "left").join(new.groupBy("page_url").agg(F.count(F.lit(1)).alias("found")), "page_url", "left")
        state = state.select(
            "page_url", (F.coalesce("rounds", F.lit(0)) + 1).cast("int").alias("rounds"),
            (F.coalesce("dry_rounds", F.lit(0)) + F.col("found").isNull().cast("int")).cast("int").alias("dry_rounds"),
            F.coalesce("initial_done", F.lit(False)).alias("initial_done"), F.coalesce("releases", F.lit(0)).alias("releases"))
        self._step(base, texts, state, known.unionByName(arrived), pages, touched, epoch, flush=F.col("rounds") >= self.rounds)
        self.metrics[epoch] |= {**seen.get, **found.get}
        for t in (keys, new):
            drop_table(t)

    def _add_texts(self, batch: DataFrame, new: DataFrame, pages: DataFrame, base: dict, touched: list[int], epoch: int) -> tuple[dict, DataFrame]:
        """Write the texts of new posts, each once; the versions after it, and the texts of the posts that share their
        place, which order them. A bucket of many epochs is rewritten without the pages that are closed."""
        table = self.tables["texts"]
        at = batch.select("page_url", "digest", "post", F.col("seq").alias("_at"))
        x = at.join(new, ["page_url", "digest"]).filter(F.col("_at").eqNullSafe(F.col("seq"))).dropDuplicates(["page_url", "digest"])
        x = x.select("page_url", "seq", "digest", "post", bucket_of("page_url", self.buckets).alias("bucket"))
        full = [b for b in touched if len(base.get(b, [])) >= EPOCHS]
        if full:
            old = table.read(base, full).join(pages.filter("done").select("page_url"), "page_url", "left_anti")
            x = x.unionByName(old.withColumn("bucket", bucket_of("page_url", self.buckets)))
        texts = table.append(x, epoch, base, full)
        shared = new.filter("tied").select("page_url", "digest")
        if shared.isEmpty():
            return texts, self.spark.createDataFrame([], "page_url string, digest binary, tie string")
        now = table.read({b: [epoch] for b, e in texts.items() if epoch in e})
        return texts, shared.join(now, ["page_url", "digest"]).select("page_url", "digest", F.col("post").alias("tie"))

    def finish(self, epoch: int = LAST_EPOCH) -> None:
        """Flush the leftovers of pages that did not reach their last round."""
        base = self.manifest.before(epoch)
        pages = self.tables["pages"].read(base.get("pages", {}))
        state = pages.filter("NOT done").drop("done")
        touched = sorted(base.get("pages", {}))
        self._step(base, base.get("texts", {}), state, self.tables["open"].read(base.get("open", {})), pages, touched, epoch, flush=F.lit(True), release=False)

    def _step(self, base: dict, texts: dict, state: DataFrame, posts: DataFrame, pages: DataFrame, touched: list[int], epoch: int, flush, release: bool = True) -> None:
        pending = posts.filter("NOT released").join(state.select("page_url"), "page_url")
        n = pending.groupBy("page_url").agg(F.count(F.lit(1)).alias("n"))
        first = ~F.col("initial_done") & (F.col("n") >= self.initial)
        take = F.when(first, self.initial).when(F.col("n") >= self.chunk, self.chunk).otherwise(0) if release else F.lit(0)
        s = state.join(n, "page_url", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("flush", flush)
        s = s.withColumn("take", take).withColumn("initial_done", F.col("initial_done") | (F.col("take") == self.initial))
        s = materialize(s.withColumn("more", F.col("flush") & (F.col("n") > F.col("take"))))
        after = s.select("page_url", "rounds", "dry_rounds", "initial_done",
                         (F.col("releases") + (F.col("take") > 0).cast("int") + F.col("more").cast("int")).cast("int").alias("releases"), F.col("flush").alias("done"))
        # the head of each page in order of arrival; the rest needs no order
        head = top_k_by(pending.select("page_url", "digest", "arrived", "seq", "tie"), ["page_url"], [F.col("arrived"), F.col("seq"), F.col("tie"), F.col("digest")], max(self.initial, self.chunk), "_rn")
        now = head.join(s.select("page_url", "take"), "page_url").filter("_rn <= take").select("page_url", "digest", F.lit(True).alias("_now"))
        # of a page at most a few posts, released now or in earlier rounds: with one row a page they say what becomes of
        # any text, so the texts are neither dealt nor sorted again
        marked = posts.filter("released").join(state.select("page_url"), "page_url").select("page_url", "digest", F.lit(False).alias("_now"))
        marked = materialize(now.unionByName(marked))
        x = self.tables["texts"].read(texts, touched).join(s.select("page_url", "rounds", "releases", "take", "flush"), "page_url").join(marked, ["page_url", "digest"], "left")
        out = x.filter(F.coalesce("_now", "flush")).select(
            "page_url", (F.col("releases") + F.when(F.col("_now").isNotNull() | (F.col("take") == 0), 0).otherwise(1)).cast("int").alias("batch_id"), "seq", "post", F.col("rounds").alias("round"))
        path = f"{self.folder}/released/epoch={epoch}"
        given = Observation(f"released-{epoch}")
        out.observe(given, F.count(F.lit(1)).alias("released")).write.mode("overwrite").option("compression", CODEC).parquet(path)
        out = self.spark.read.schema(RELEASED).parquet(path)
        if self.on_release is not None:
            self.on_release(out, epoch)
        # pages that are still open keep the keys of their posts; of the others one row is left
        kept = posts.join(after.filter("done").select("page_url"), "page_url", "left_anti").join(marked.filter("_now"), ["page_url", "digest"], "left")
        kept = kept.select("page_url", "seq", "digest", "arrived", (F.col("released") | F.coalesce("_now", F.lit(False))).alias("released"), "tie")
        rows = pages.join(after.select("page_url"), "page_url", "left_anti").unionByName(after)
        version = {name: self.tables[name].write(df, epoch, self.buckets, touched, base.get(name, {})) for name, df in (("open", kept), ("pages", rows))}
        # a bucket without an open page needs no texts
        version["texts"] = {b: e for b, e in texts.items() if b not in set(touched) or b in version["open"]}
        self.manifest.commit(epoch, version)
        for name, table in self.tables.items():
            table.drop_older(epoch, base.get(name, {}), version[name])
        self.metrics[epoch] = dict(given.get)
        for t in (s, marked):
            drop_table(t)


def run_stream(stream: DataFrame, handle_batch, checkpoint: str, trigger_available_now: bool = True):
    """T5: call ``handle_batch(df, epoch_id)`` for each micro-batch.

    ``handle_batch`` should write idempotently per epoch (e.g. overwrite a folder of its own), so that a
    replayed epoch after a failure does not duplicate."""
    w = stream.writeStream.foreachBatch(handle_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_available_now else w
    return w.start()
