"""Idea store: per-batch aggregation of ideas.

Grain is ``(page_url, batch_id, idea)``: each batch has a fresh store. Topics and reasons are
de-duplicated by a partial aggregation before they are collected; the sets of a row are complete. The
same sets are available in long form (:func:`idea_topics`, :func:`idea_reasons`) for keys whose sets
should not become one array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentiment_score, trim_ws
from .batching import top_k_by
from .segmented import segment_rank

KEY = ["page_url", "batch_id", "idea"]
# Caps of the idea store and the ranking request.
MAX_EXAMPLES = 3
EXAMPLE_CHARS = 300
MAX_TOPICS_PER_POST = 5
REASON_CHARS = 200
IDEAS_PER_REQUEST = 30


def explode_ideas(df: DataFrame, ideas_col: str = "ideas", k: int = 3) -> DataFrame:
    """One row per idea of a post, ``idea_pos`` 0-based."""
    others = [c for c in df.columns if c != ideas_col]
    return df.select(*others, F.posexplode(F.slice(F.col(ideas_col), 1, k)).alias("idea_pos", "idea"))


def with_example(posts: DataFrame) -> DataFrame:
    """Posts with the start of their text that is shown (``example``) in place of the text."""
    return posts.withColumn("example", F.substring(trim_ws("post"), 1, EXAMPLE_CHARS)).drop("post")


def idea_events(
    df: DataFrame,
    ideas_col: str = "ideas",
    sentiment_col: str = "sentiment",
    topics_col: str = "topics",
    reason_col: str = "reason",
) -> DataFrame:
    """Rows ``(page_url, batch_id, seq, idea_pos, idea, example, s_score, topics, reason)`` from
    posts joined with their insight fields and idea arrays. Of a post only its ``example`` is needed: posts that have
    one (:func:`with_example`) need no text."""
    df = df if "example" in df.columns else with_example(df)
    x = explode_ideas(df.select("page_url", "batch_id", "seq", "example", sentiment_col, topics_col, reason_col, ideas_col), ideas_col)
    return x.select(
        "page_url", "batch_id", "seq", "idea_pos", "idea", "example",
        sentiment_score(sentiment_col).alias("s_score"),
        F.slice(F.coalesce(F.col(topics_col), F.array().cast("array<string>")), 1, MAX_TOPICS_PER_POST).alias("topics"),
        F.col(reason_col).alias("reason"),
    )


def idea_topics(events: DataFrame) -> DataFrame:
    """A5 long form / G8: every distinct topic of a key with its first-seen order."""
    t = events.select(*KEY, "seq", "idea_pos", F.posexplode("topics").alias("t_pos", "topic"))
    return t.groupBy(*KEY, "topic").agg(F.min(F.struct("seq", "idea_pos", "t_pos")).alias("o"))


def idea_reasons(events: DataFrame) -> DataFrame:
    """A6 long form: every distinct reason of a key with its first-seen order."""
    r = events.filter(F.col("reason").isNotNull())
    return r.groupBy(*KEY, "reason").agg(F.min(F.struct("seq", "idea_pos")).alias("o"))


def idea_store(events: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """One row per ``(page_url, batch_id, idea)``::

        first_seq, first_pos, cnt, sentiment_sum, examples, n_topics, topics, n_reasons, reasons

    Every event becomes tagged rows (itself, its topics, its reason). They are pre-aggregated by value,
    so a repeated topic or reason costs one row per task, and one grouping by key builds the row; the
    first examples are a top-k window with a partial group limit."""
    tag = lambda kind, value, t_pos, s: F.struct(
        F.lit(kind).alias("kind"), value.alias("value"), t_pos.cast("int").alias("t_pos"), s.cast("bigint").alias("s"))
    none = F.lit(None).cast("string")
    rows = F.concat(
        F.array(tag("event", none, F.lit(0), F.col("s_score"))),
        F.transform("topics", lambda t, i: tag("topic", t, i, F.lit(0))),
        F.array(tag("reason", F.col("reason"), F.lit(0), F.lit(0))),
    )
    x = events.select(*KEY, "seq", "idea_pos", F.inline(rows)).filter("kind = 'event' OR value IS NOT NULL")
    x = x.groupBy(*KEY, "kind", "value").agg(F.min(F.struct("seq", "idea_pos", "t_pos")).alias("o"), F.count(F.lit(1)).alias("c"), F.sum("s").alias("s"))
    of = lambda kind, v: F.when(F.col("kind") == kind, v)
    ordered = lambda kind: F.transform(F.array_sort(F.collect_list(of(kind, F.struct("o", "value")))), lambda v: v["value"])
    x = x.groupBy(*KEY).agg(
        F.max(of("event", F.col("o.seq"))).alias("first_seq"), F.max(of("event", F.col("o.idea_pos"))).alias("first_pos"),
        F.max(of("event", F.col("c"))).alias("cnt"), F.max(of("event", F.col("s"))).alias("sentiment_sum"),
        ordered("topic").alias("topics"), ordered("reason").alias("reasons"),
    )
    ex = top_k_by(events.select(*KEY, "seq", "idea_pos", "example"), KEY, [F.col("seq"), F.col("idea_pos")], max_examples, "_rk")
    ex = ex.groupBy(*KEY).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "idea_pos", "example"))), lambda s: s["example"]).alias("examples")
    )
    size = lambda c: F.size(c).cast("bigint")
    return x.join(ex, KEY, "left").select(
        *KEY, "first_seq", "first_pos", "cnt", "sentiment_sum", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"),
        size("topics").alias("n_topics"), "topics", size("reasons").alias("n_reasons"), "reasons",
    )


def first_ideas(store: DataFrame, k: int) -> DataFrame:
    """The first ``k`` ideas of each batch in first-seen order (``payload_pos`` 1-based)."""
    return top_k_by(store, ["page_url", "batch_id"], [F.col("first_seq"), F.col("first_pos")], k, "payload_pos")


def payload_ideas(store: DataFrame, per_request: int = IDEAS_PER_REQUEST) -> DataFrame:
    """Every idea of a batch with its place in first-seen order (``payload_pos``, 1-based) and the
    number of the ranking request that carries it (``payload_no``, from 0)."""
    x = segment_rank(store, ["page_url", "batch_id"], [F.col("first_seq"), F.col("first_pos"), F.col("idea")], "payload_pos")
    return x.withColumn("payload_no", F.floor((F.col("payload_pos") - 1) / per_request).cast("bigint"))


def rank_payload(store: DataFrame, per_request: int = IDEAS_PER_REQUEST) -> DataFrame:
    """JSON documents ``{"ideas": [...]}`` of at most ``per_request`` ideas; a batch with more ideas
    has several (``payload_no``)."""
    first = payload_ideas(store, per_request)
    item = F.struct(
        F.col("payload_pos"),
        F.struct(
            F.col("idea"),
            F.col("cnt").alias("count"),
            F.col("sentiment_sum").alias("sentimentSum"),
            F.col("topics"),
            F.col("examples"),
            F.col("reasons"),
        ).alias("body"),
    )
    return first.groupBy("page_url", "batch_id", "payload_no").agg(
        F.count(F.lit(1)).alias("n_ideas"),
        F.sum("cnt").cast("bigint").alias("total_count"),
        F.transform(F.array_sort(F.collect_list(item)), lambda s: s["body"]).alias("ideas"),
    ).withColumn("payload", F.to_json(F.struct("ideas")))


def leaderboard(store: DataFrame) -> DataFrame:
    """A10 [ours]: idea totals rolled up over batch -> page -> all (``level`` = grouping id)."""
    return (
        store.rollup("idea", "page_url", "batch_id")
        .agg(
            F.grouping_id().alias("level"),
            F.sum("cnt").cast("bigint").alias("cnt"),
            F.sum("sentiment_sum").cast("bigint").alias("sentiment_sum"),
            F.count(F.lit(1)).alias("n_batches"),
        )
        .filter(F.col("idea").isNotNull() & (F.col("level") < 4))
    )


def topic_rollup(events: DataFrame) -> DataFrame:
    """G8 [ours]: topic mentions per page and overall (rollup)."""
    t = events.select("page_url", F.explode("topics").alias("topic"), "s_score")
    return (
        t.rollup("topic", "page_url")
        .agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("mentions"), F.sum("s_score").cast("bigint").alias("sentiment_sum"))
        .filter(F.col("topic").isNotNull())
    )
