"""Model-backed operators M1-M5 and the extractor cascade U4.

Each task has two halves that never call a model: ``*_requests`` builds the prompts (Catalyst) and
``*_results`` parses a stored reply table. In between, :func:`call` sends the requests that have no
stored reply yet; its result is written before anyone reads it, so no consumer pays for a call twice.
Key columns travel with the requests; replies are attached by request key (J4). Requests without an
``ok`` reply are dead letters (S9): :func:`dead_letters`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ideas as I
from ..functions import jsonx as J
from ..functions.text import non_blank, trim_ws
from ..session import materialize
from . import batching as B
from . import html_blocks as H
from . import requests as RQ
from .enrich import attach_replies, enrich, missing_requests
from .idea_store import payload_ideas


def call(requests: DataFrame, client_factory, stored: DataFrame | None = None, policy=None, partitions=None, sleep=None) -> DataFrame:
    """Replies of all requests: the stored ``ok`` ones and new calls for the rest."""
    if stored is None:
        return materialize(enrich(requests, client_factory, policy, partitions, sleep))
    new = materialize(enrich(missing_requests(requests, stored), client_factory, policy, partitions, sleep))
    return stored.filter(F.col("status") == "ok").select(*new.columns).unionByName(new)


def dead_letters(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Requests without an ``ok`` reply: the error of a failed call, status ``missing`` if never
    answered."""
    x = attach_replies(requests.drop("system", "prompt"), replies)
    x = x.withColumn("status", F.coalesce("status", F.lit("missing")))
    return x.filter(F.col("status") != "ok").drop("reply")


def _answers(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Requests with their ``ok`` reply (null: none)."""
    x = attach_replies(requests.drop("system", "prompt"), replies)
    return x.withColumn("reply", F.when(F.col("status") == "ok", F.col("reply")))


# ---- M1 ---------------------------------------------------------------------------------------
def analyze_requests(posts: DataFrame) -> DataFrame:
    """``posts(page_url, seq, post)``; empty posts are never sent."""
    p = posts.filter(F.col("post").isNotNull() & (F.col("post") != ""))
    return RQ.build_requests(p, "analyze", ["page_url", "seq"], RQ.analysis_prompt("post"))


def analyze_results(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Insights ``(page_url, seq, key, ins)`` of the answered requests. Replies may carry the service's
    ``envelope`` instead of the text (P10); the text is trimmed, an empty one is an insight, too."""
    if "envelope" in replies.columns:
        replies = replies.withColumn("reply", J.reply_text("envelope", "responses"))
    x = _answers(requests, replies).filter(F.col("reply").isNotNull()).withColumn("reply", trim_ws("reply"))
    return J.with_insight(x.select("page_url", "seq", "key", "reply"), "reply", "ins").select("page_url", "seq", "key", "ins")


# ---- M4 ---------------------------------------------------------------------------------------
def idea_requests(posts_insights: DataFrame) -> DataFrame:
    """Rows with ``ins`` (truthy insights) and ``post``, or with their ``inputs`` (:func:`idea_inputs`); they travel with
    the request."""
    # the input is written before its fields are read: as one expression its code would outgrow a method
    inp = F.col("inputs") if "inputs" in posts_insights.columns else RQ.idea_input(posts_insights, "ins", "post")
    x = materialize(posts_insights.withColumn("_inp", inp))
    x = RQ.with_idea_prompt(x, "_inp", "_prompt")
    return RQ.build_requests(x, "ideate", ["page_url", "seq"], F.col("_prompt"), RQ.IDEA_SYSTEM, carry=[c for c in posts_insights.columns if c != "inputs"])


def idea_inputs(insights: DataFrame, posts: DataFrame) -> DataFrame:
    """Truthy insights and their posts joined for :func:`idea_requests`: ``page_url, seq, inputs`` and the fallback idea
    (``fallback``). Either side is cut to what the prompt takes of it, and written, before they meet: whole
    texts, replies and parsed objects are not dealt over tasks."""
    cut = materialize(insights.select("page_url", "seq", F.col("ins.ok").alias("ok"), *RQ.insight_input("ins"), I.fallback_idea(F.col("ins.summary_text")).alias("fallback")))
    starts = posts.select("page_url", "seq", RQ.post_input("post").alias("post"))
    x = cut.filter("ok").join(starts, ["page_url", "seq"])
    return x.select("page_url", "seq", F.struct("summary", "sentiment", "topics", "examples", "post").alias("inputs"), "fallback")


def idea_results(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """The carried rows with ``ideas`` (<= 3); without a reply the fallback idea (P18). Replies are read before they
    meet their requests."""
    names = [c for c in requests.columns if c not in ("key", "task", "system", "prompt", "fallback")]
    if "fallback" not in requests.columns:
        requests = requests.withColumn("fallback", I.fallback_idea(F.col("ins.summary_text")))
    read = replies.select("key", F.when(F.col("status") == "ok", F.col("reply")).alias("reply"))
    read = I.with_reply_ideas(read, "reply", "_found").select("key", "_found")
    x = requests.select(*names, "key", "fallback").join(read, "key", "left")
    return x.select(*names, I.found_or("_found", "fallback").alias("ideas"))


# ---- M5 ---------------------------------------------------------------------------------------
RANK_KEYS = ["page_url", "batch_id", "payload_no"]


def rank_requests(store: DataFrame) -> DataFrame:
    """One ranking request per payload (a batch with many ideas has several)."""
    x = RQ.with_ranked_idea(payload_ideas(store), "item").groupBy(*RANK_KEYS).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("payload_pos", "item"))), lambda s: s["item"]).alias("items"))
    body = RQ.json_object([("ideas", RQ.json_array(F.col("items"), 2))], 0)
    return RQ.build_requests(x, "rank", RANK_KEYS, RQ.rank_prompt(body), RQ.RANK_SYSTEM)


def rank_results(store: DataFrame, requests: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ranked rows, fallback headlines of the payloads whose ranking failed)."""
    from .rank import rank_fallback, ranked_rows

    x = _answers(requests, replies).select(*RANK_KEYS, "reply")
    return ranked_rows(x, keys=RANK_KEYS), rank_fallback(store, x, keys=RANK_KEYS)


# ---- M2, M3 -----------------------------------------------------------------------------------
def _posts(x: DataFrame, order_cols: list[str]) -> DataFrame:
    """Trimmed, non-blank posts; first occurrence per page. ``pos`` is a struct that gives their order
    (request, place in the reply): no page is sorted to number them."""
    x = x.select("page_url", *order_cols, F.posexplode("posts").alias("i", "post"))
    x = x.withColumn("post", trim_ws("post")).filter(F.col("post") != "")
    order = F.struct(*[F.col(c).cast("bigint").alias(c) for c in order_cols], F.col("i").cast("bigint").alias("i"))
    return x.groupBy("page_url", "post").agg(F.min(order).alias("pos")).select("page_url", "pos", "post")


def candidate_requests(cands: DataFrame) -> DataFrame:
    """M2: size-packed batches (B2) of candidate blocks ``(page_url, pos, block)``."""
    items = B.batch_requests_items(B.pack_batches(cands))
    return RQ.build_requests(items, "extract_candidates", ["page_url", "cand_batch", "request_no"], RQ.candidate_prompt("items_json"), RQ.CANDIDATE_SYSTEM)


def candidate_results(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Posts ``(page_url, pos, post)``; a failed or empty batch is skipped."""
    x = _answers(requests, replies).filter(F.col("reply").isNotNull())
    return _posts(J.with_posts(x, "reply", "posts", "empty"), ["cand_batch", "request_no"])


def chunk_requests(texts: DataFrame) -> DataFrame:
    """M3: page texts ``(page_url, text)`` in overlapping chunks."""
    ch = B.chunk_text(texts.filter(non_blank("text")), "text", keep=["page_url"])
    return RQ.build_requests(ch, "extract_chunk", ["page_url", "chunk_no"], RQ.chunk_prompt("chunk"), RQ.CHUNK_SYSTEM)


def chunk_results(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Posts ``(page_url, pos, post)``; failed chunks are skipped."""
    x = _answers(requests, replies).filter(F.col("reply").isNotNull())
    return _posts(J.with_posts(x, "reply", "posts", "lines"), ["chunk_no"])


# ---- U4 ---------------------------------------------------------------------------------------
def extract_posts(pages: DataFrame, answer=None) -> DataFrame:
    """U4: candidates tier -> chunked full-text tier -> selector scan, each only for the pages that the one
    before left without posts. ``answer(requests)`` gives the replies of a tier's requests (:func:`call` with
    a client, or stored ones); without it only the selector scan runs."""
    blocks = materialize(H.page_blocks(pages))  # read by every tier: parse the HTML once
    if answer is None:
        return H.selector_scan(blocks).select("page_url", F.lit("selector_scan").alias("tier"), "post")
    without = lambda d, done: d.join(done.select("page_url").distinct(), "page_url", "left_anti")
    r1 = materialize(candidate_requests(H.candidates(blocks)))
    t1 = materialize(candidate_results(r1, answer(r1)))
    left = without(blocks, t1)
    r2 = materialize(chunk_requests(H.page_text(without(pages, t1), left)))
    t2 = materialize(chunk_results(r2, answer(r2)))
    tag = lambda d, t: d.select("page_url", F.lit(t).alias("tier"), "post")
    return tag(t1, "candidates").unionByName(tag(t2, "full_text")).unionByName(tag(H.selector_scan(without(left, t2)), "selector_scan"))
