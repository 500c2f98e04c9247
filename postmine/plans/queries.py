"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame whose
columns are scalars (lists joined with ``SEP``) so they can be compared with the DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ideas as I
from ..functions import jsonx as J
from ..functions import text as T
from ..operators import batching as B
from ..operators import dedup as U
from ..operators import gates as G
from ..operators import idea_store as S
from ..operators import rank as R
from . import fixtures as FX
from ..session import CODEC, drop_table, materialize, scratch_folder
from .common import SEP, fixture, table


def _j(c) -> F.Column:
    return F.array_join(c, SEP)


# ----------------------------------------------------------------------------------------------
# shared stages of the post -> insight -> idea -> store chain (recorded replies)
# ----------------------------------------------------------------------------------------------
def planned_posts(spark: SparkSession, sf: str) -> DataFrame:
    posts = fixture(spark, sf, FX.POSTS)
    # the texts tell posts apart; of them only the example goes on
    return B.plan_batches(S.with_example(U.distinct_posts(posts).drop("n_copies")))


def insights(spark: SparkSession, sf: str) -> DataFrame:
    ar = fixture(spark, sf, FX.ANALYSIS_REPLIES)
    return J.with_insight(ar, "reply", "ins").select("page_url", "seq", "ins")


def post_ideas(spark: SparkSession, sf: str) -> DataFrame:
    """J1 + J2: planned posts with their insight (truthy only) and idea array (materialized)."""
    return materialize(ideas_of(spark, sf, planned_posts(spark, sf)))


def parsed_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Insight fields and ideas per post, from the recorded analysis and idea replies. Either reply is read
    before they meet: whole replies and parsed objects are not dealt over tasks."""
    ins = insights(spark, sf).select(
        "page_url", "seq", F.col("ins.ok").alias("insight_ok"), F.col("ins.sentiment").alias("sentiment"), F.col("ins.topics").alias("topics"),
        F.col("ins.reason").alias("reason"), I.fallback_idea(F.col("ins.summary_text")).alias("fallback"))
    ir = I.with_reply_ideas(fixture(spark, sf, FX.IDEA_REPLIES), "reply", "found").select("page_url", "seq", "found")
    x = ins.join(ir, ["page_url", "seq"])
    # falsy insights give no ideas; the post still counts as processed
    ideas = F.when(F.col("insight_ok"), I.found_or("found", "fallback")).otherwise(F.array().cast("array<string>"))
    return x.withColumn("ideas", ideas).drop("found", "fallback")


def ideas_of(spark: SparkSession, sf: str, planned: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """Posts ``(page_url, batch_id, seq, example)`` joined with their recorded insight and ideas."""
    replies = replies if replies is not None else parsed_replies(spark, sf)
    # inner join: a post without insight or idea reply has no ideas; falsy insights give none either
    x = planned.join(replies, ["page_url", "seq"])
    return x.select("page_url", "batch_id", "seq", "example", "insight_ok", "sentiment", "topics", "reason", "ideas")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Idea events (from the materialized posts with ideas)."""
    return S.idea_events(post_ideas(spark, sf))


def store(spark: SparkSession, sf: str, reuse: bool = False) -> DataFrame:
    """Idea store; materialized when the caller reads it more than once."""
    st = S.idea_store(events(spark, sf))
    return materialize(st) if reuse else st


# ----------------------------------------------------------------------------------------------
# queries
# ----------------------------------------------------------------------------------------------
def q_idea_store(spark, sf):
    """A1-A6, J1, J2, G6, P4 (flagship)."""
    s = S.idea_store(events(spark, sf))
    return s.select(
        "page_url", F.col("batch_id").cast("bigint").alias("batch_id"), "idea",
        "first_seq", F.col("first_pos").cast("bigint").alias("first_pos"), "cnt", "sentiment_sum",
        _j("examples").alias("examples"), "n_topics", _j("topics").alias("topics"),
        "n_reasons", _j("reasons").alias("reasons"),
    )


def q_batch_plan(spark, sf):
    """B1 over documents per source and over user turns per conversation."""
    docs = planned_posts(spark, sf).select(
        F.lit("documents").alias("src"), "page_url", "seq", F.col("batch_id").cast("bigint").alias("batch_id")
    )
    conv = table(spark, sf, "conversations").filter(F.col("role") == "user").select(
        F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("page_url"),
        F.col("turn").alias("seq"),  # a page is one conversation
        F.col("text").alias("post"),
    )
    conv = B.plan_batches(U.distinct_posts(conv).drop("n_copies")).select(
        F.lit("conversations").alias("src"), "page_url", "seq", F.col("batch_id").cast("bigint").alias("batch_id")
    )
    return docs.unionByName(conv)


def q_post_distinct(spark, sf):
    """U1 + F4: first occurrence per page of each trimmed line of the documents."""
    lines = table(spark, sf, "documents").select(
        F.col("source").alias("page_url"), "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "post")
    ).select("page_url", F.struct("doc_id", F.col("line_no").cast("bigint").alias("line_no")).alias("seq"), "post")
    return U.distinct_posts(lines).select("page_url", "post", "seq.doc_id", "seq.line_no", "n_copies")


def _doc_lines(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("source").alias("page_url"), "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "post")
    )


def q_new_posts(spark, sf):
    """U3 + J5: lines of the second half of each source's documents not seen in the first half, over a table of
    seen posts with filters."""
    from ..streaming.seen import SeenPosts

    lines = _doc_lines(spark, sf).select("page_url", "doc_id", T.trim_ws("post").alias("post")).filter(F.col("post") != "")
    first = lines.filter(F.col("doc_id") % 2 == 0)
    second = lines.filter(F.col("doc_id") % 2 == 1)
    seen = SeenPosts(spark, scratch_folder(spark, "seen-posts"))
    seen.new(first.distinct(), 0)
    return seen.new(second, 1).groupBy("page_url").agg(
        F.count(F.lit(1)).alias("n_new_rows"), F.countDistinct("post").alias("n_new_distinct")
    )


def q_round_counts(spark, sf):
    """rounds = doc_id % 3 (three snapshots); collected and new distinct lines per page."""
    lines = _doc_lines(spark, sf).select(
        "page_url", (F.col("doc_id") % 3).alias("round"), T.trim_ws("post").alias("post")
    )
    return U.round_counts(lines).select("page_url", F.col("round").cast("bigint").alias("round"), "new_found", "collected")


def q_chunk_text(spark, sf):
    """G1 with (12000, 300) and (1000, 100) on every document."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    a = B.chunk_text(docs, "text", 12000, 300, keep=["doc_id"]).withColumn("cfg", F.lit("12000/300"))
    b = B.chunk_text(docs, "text", 1000, 100, keep=["doc_id"]).withColumn("cfg", F.lit("1000/100"))
    return a.unionByName(b).select(
        "cfg", "doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.col("start").cast("bigint").alias("start"),
        F.length("chunk").cast("bigint").alias("chunk_len"), F.md5(F.encode("chunk", "UTF-8")).alias("chunk_md5"),
    )


def q_pack_batches(spark, sf):
    """B2: all documents of each source packed into <=10000-char request batches."""
    cands = table(spark, sf, "documents").select(
        F.col("source").alias("page_url"), F.col("doc_id").alias("pos"), F.col("text").alias("block")
    )
    p = B.pack_batches(cands)
    return p.select("page_url", F.col("pos").cast("bigint").alias("pos"),
                    F.col("cand_batch").cast("bigint").alias("cand_batch"), F.col("batch_pos").cast("bigint").alias("batch_pos"))


def q_preview(spark, sf):
    """Trimmed text, collapsed text, 140-char preview, 240-char example, first line."""
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id",
        F.length(T.trim_ws("text")).cast("bigint").alias("trim_len"),
        F.md5(F.encode(T.collapse_ws("text"), "UTF-8")).alias("collapsed_md5"),
        T.preview("text", 140).alias("preview"),
        T.preview("text", 240, trim=False).alias("example"),
    )


def q_prompt_render(spark, sf):
    """The prompts of all five tasks, measured and fingerprinted."""
    from ..operators import model_tasks as M
    from ..operators import requests as RQ

    shown = lambda d, task, key: d.select(F.lit(task).alias("task"), key.cast("string").alias("key"),
                                          F.length("prompt").cast("bigint").alias("prompt_len"), F.md5(F.encode("prompt", "UTF-8")).alias("prompt_md5"))
    d = table(spark, sf, "documents")
    odd = d.select("doc_id", F.concat("text", F.lit(' """ '), F.lit(chr(92)), F.lit(" end")).alias("text"))
    analyze = odd.select("doc_id", RQ.analysis_prompt("text").alias("prompt"))
    chunks = M.chunk_requests(d.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("page_url"), "text"))
    cands = M.candidate_requests(_doc_blocks(spark, sf))
    ideas = M.idea_requests(M.idea_inputs(insights(spark, sf), fixture(spark, sf, FX.POSTS)))
    ranks = M.rank_requests(store(spark, sf))
    out = shown(analyze, "analyze", F.col("doc_id"))
    out = out.unionByName(shown(chunks, "extract_chunk", F.concat_ws("/", "page_url", F.col("chunk_no").cast("string"))))
    out = out.unionByName(shown(cands, "extract_candidates", F.concat_ws("/", "page_url", F.col("cand_batch").cast("string"), F.col("request_no").cast("string"))))
    out = out.unionByName(shown(ideas, "ideate", F.col("seq")))
    return out.unionByName(shown(ranks, "rank", F.concat_ws("/", "page_url", F.col("batch_id").cast("string"), F.col("payload_no").cast("string"))))


def q_seed_urls(spark, sf):
    """S1 + P5: page URLs joined into comma strings of 10 (with a blank entry), split and trimmed."""
    from ..sources.tables import seed_urls

    pages = table(spark, sf, "pages")
    lines = pages.groupBy((F.col("page_id") / 10).cast("bigint").alias("line_id")).agg(
        F.concat_ws(" , ", F.array_sort(F.collect_list(F.struct("page_id", "url"))).getField("url")).alias("line")
    ).select("line_id", F.concat("line", F.lit(", ,not a url")).alias("line"))
    s = seed_urls(lines, "line")
    return s.select("line_id", F.col("ord").cast("bigint").alias("ord"), "url", T.url_origin("url").alias("origin"))


def q_url_gate(spark, sf):
    """every page URL plus one redirected variant of each (blocked or a case near miss)."""
    pages = table(spark, sf, "pages").select("page_id", F.col("url").alias("page_url"))
    variants = pages.select(
        (F.col("page_id") + 1000000).alias("page_id"),
        F.concat(F.col("page_url"), F.element_at(F.array(F.lit("/login"), F.lit("?app=1"), F.lit("/Login"), F.lit("/consent")),
                                                   (F.col("page_id") % 4 + 1).cast("int"))).alias("page_url"),
    )
    allp = pages.unionByName(variants)
    return allp.select("page_id", "page_url", G.is_blocked_url("page_url").alias("blocked"))


def q_candidate_gate(spark, sf):
    """F2 + F4: document lines that pass the candidate gate."""
    lines = _doc_lines(spark, sf)
    return lines.filter(T.non_blank("post") & G.candidate_ok("post")).select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"),
        F.length(T.trim_ws("post")).cast("bigint").alias("n_chars"), T.word_count(T.trim_ws("post")).cast("bigint").alias("n_words"),
    )


def q_parse_insight(spark, sf):
    """P11 + F5 + F9 + P19 on the recorded analysis replies."""
    x = insights(spark, sf)
    return x.select(
        "seq", F.col("ins.status").alias("status"), F.col("ins.ok").alias("ok"),
        F.col("ins.summary_text").alias("summary_text"), F.col("ins.sentiment").alias("sentiment"),
        _j("ins.topics").alias("topics"), F.col("ins.toxicity").alias("toxicity"),
    )


def q_parse_posts_chunk(spark, sf):
    """P12 + G5: posts from recorded chunk-extractor replies."""
    r = fixture(spark, sf, FX.POSTS_REPLIES)
    r = J.with_posts(r, "reply", "posts", "lines")
    return r.select("seq", F.posexplode("posts").alias("pos", "post")).select(
        "seq", F.col("pos").cast("bigint").alias("pos"), "post"
    )


def q_parse_posts_cand(spark, sf):
    """P13 + G5: posts from recorded candidate-extractor replies."""
    r = fixture(spark, sf, FX.POSTS_REPLIES)
    r = J.with_posts(r, "reply", "posts", "empty")
    return r.select("seq", F.posexplode("posts").alias("pos", "post")).select(
        "seq", F.col("pos").cast("bigint").alias("pos"), "post"
    )


def q_parse_array(spark, sf):
    """P14 + P16 on the recorded idea replies."""
    r = fixture(spark, sf, FX.IDEA_REPLIES)
    r = J.with_string_array(r, "reply", "arr")
    a = F.col("arr")
    return r.select("seq", a.isNotNull().alias("is_array"), F.when(a.isNull(), F.lit(-1)).otherwise(F.size(a)).cast("bigint").alias("n"),
                    _j(a).alias("items"))


def q_parse_object(spark, sf):
    """P15 + P16 on the recorded ranking replies."""
    r = rank_replies(spark, sf)
    r = J.with_object(r, "reply", "obj")
    v = F.col("obj")
    ranked = F.try_variant_get(v, "$.ranked", "array<variant>")
    return r.select(
        "page_url", F.col("batch_id").cast("bigint").alias("batch_id"), v.isNotNull().alias("parsed"),
        F.when(ranked.isNull(), F.lit(-1)).otherwise(F.size(ranked)).cast("bigint").alias("n_ranked"),
        F.try_variant_get(v, "$.ranked[0].idea", "string").alias("first_idea"),
    )


def q_idea_cascade(spark, sf):
    """P17 + P18 + F6 + F7: final ideas per post (posts with a truthy insight)."""
    x = post_ideas(spark, sf).filter("insight_ok")
    return x.select("seq", F.size("ideas").cast("bigint").alias("n_ideas"), _j("ideas").alias("ideas"))


def q_idea_input(spark, sf):
    """Ideation input (summary <=800 collapsed, sentiment lower, topics <=5, post <=800)."""
    from ..operators.requests import idea_input

    x = materialize(insights(spark, sf)).filter(F.col("ins.ok"))
    posts = fixture(spark, sf, FX.POSTS)
    j = posts.join(x, ["page_url", "seq"])
    inp = idea_input(j, "ins", "post")
    return j.select("seq", inp.alias("i")).select(
        "seq", F.col("i.summary").alias("summary"), F.col("i.sentiment").alias("sentiment"),
        _j("i.topics").alias("topics"), F.length("i.post").cast("bigint").alias("post_len"),
    )


def q_idea_fields(spark, sf):
    """P20 [ours]: idea strings split into title / pitch / why / price / amount."""
    ev = events(spark, sf).select("idea").distinct()
    s = I.split_idea("idea")
    return ev.select("idea", s["title"].alias("title"), s["pitch"].alias("pitch"), s["why"].alias("why"),
                     s["price"].alias("price"), s["price_usd"].alias("price_usd"))


def rank_replies(spark, sf, st: DataFrame | None = None) -> DataFrame:
    """Recorded ranking replies: one per batch with ideas, built from its first two payload ideas."""
    st = st if st is not None else store(spark, sf)
    first = S.first_ideas(st, 2)
    b = first.groupBy("page_url", "batch_id").agg(
        F.max(F.when(F.col("payload_pos") == 1, F.col("idea"))).alias("i1"),
        F.coalesce(F.max(F.when(F.col("payload_pos") == 2, F.col("idea"))), F.max(F.when(F.col("payload_pos") == 1, F.col("idea")))).alias("i2"),
    )
    b = b.select("page_url", "batch_id", F.expr(FX.RANK_ITEM_1.replace("b.", "")).alias("it1"),
                 F.expr(FX.RANK_ITEM_2.replace("b.", "")).alias("it2"))
    return b.select("page_url", "batch_id", F.expr(FX.RANK_REPLY.replace("b.", "")).alias("reply"))


def q_rank_payload(spark, sf):
    """A8 + B3: the JSON payloads of every batch, 30 ideas each."""
    p = S.rank_payload(store(spark, sf))
    return p.select("page_url", F.col("batch_id").cast("bigint").alias("batch_id"), "payload_no", "n_ideas", "total_count", "payload")


def q_ranked_rows(spark, sf):
    """G7 + P15 + W2 + J3: ranked rows with the store signals of the same idea."""
    st = store(spark, sf, reuse=True)
    rr = R.ranked_rows(rank_replies(spark, sf, st))
    j = R.attach_signals(rr, st)
    return j.select(
        "page_url", F.col("batch_id").cast("bigint").alias("batch_id"), F.col("pos").cast("bigint").alias("pos"), "idea",
        F.col("priority").cast("string").alias("priority"), "score", "estimated_revenue_usd", "recommended_price_range",
        _j("channels").alias("channels"), F.size("examples").cast("bigint").alias("n_examples"),
        F.col("cnt").cast("string").alias("cnt"), F.col("sentiment_sum").cast("string").alias("sentiment_sum"),
    )


def q_rank_fallback(spark, sf):
    """W3 + W4: headline fallback for batches whose ranking failed, with every batch's idea count."""
    st = store(spark, sf, reuse=True)
    fb = R.rank_fallback(st, rank_replies(spark, sf, st))
    counts = R.all_batches(planned_posts(spark, sf), st)
    return counts.join(fb, ["page_url", "batch_id"], "left").select(
        "page_url", F.col("batch_id").cast("bigint").alias("batch_id"), "n_posts", "n_ideas",
        F.col("pos").cast("string").alias("pos"), "idea",
    )


def q_rank_native(spark, sf):
    """W5 [ours]: signal ranking of all ideas of each batch."""
    r = R.rank_native(store(spark, sf))
    return r.select("page_url", F.col("batch_id").cast("bigint").alias("batch_id"), F.col("rank").cast("bigint").alias("rank"),
                    "idea", "cnt", "sentiment_sum", "n_topics")


def q_revenue_topk(spark, sf):
    """Top 1 ranked idea per batch by estimated revenue."""
    rr = R.revenue_top_k(R.ranked_rows(rank_replies(spark, sf)), 1)
    return rr.select("page_url", F.col("batch_id").cast("bigint").alias("batch_id"), "idea", "estimated_revenue_usd")


def q_leaderboard_rollup(spark, sf):
    """A10 + G8 [ours]: idea totals over batch -> page -> all, plus topic totals."""
    ev = events(spark, sf)
    lb = S.leaderboard(S.idea_store(ev)).select(
        F.lit("idea").alias("kind"), F.col("idea").alias("key"), "page_url", F.col("batch_id").cast("string").alias("batch_id"),
        F.col("level").cast("bigint").alias("level"), "cnt", "sentiment_sum",
    )
    tp = S.topic_rollup(ev).select(
        F.lit("topic").alias("kind"), F.col("topic").alias("key"), "page_url", F.lit(None).cast("string").alias("batch_id"),
        F.col("level").cast("bigint").alias("level"), F.col("mentions").alias("cnt"), "sentiment_sum",
    )
    return lb.unionByName(tp)


def q_report_lines(spark, sf):
    """P9 + S6: rendered report blocks of the ranked rows."""
    rr = R.ranked_rows(rank_replies(spark, sf))
    rep = R.report_lines(rr)
    return rep.select("page_url", F.col("batch_id").cast("bigint").alias("batch_id"), F.col("pos").cast("bigint").alias("pos"), "block")


def q_report_document(spark, sf):
    """S6 + W3 + W4: every printed line of every batch: header and blocks, fallback headlines, or the
    line for no ideas."""
    st = store(spark, sf, reuse=True)
    rep = rank_replies(spark, sf, st)
    doc = R.report_document(R.all_batches(planned_posts(spark, sf), st), R.report_lines(R.ranked_rows(rep)), R.rank_fallback(st, rep))
    return doc.select("page_url", F.col("batch_id").cast("bigint").alias("batch_id"), F.col("section").cast("bigint").alias("section"), "pos", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def q_batch_plan_offset(spark, sf):
    """The plan of the posts after the first four of each source, first two batches."""
    posts = U.distinct_posts(fixture(spark, sf, FX.POSTS)).drop("n_copies")
    return B.plan_batches(posts, offset=4, max_batches=2).select("page_url", "seq", F.col("batch_id").cast("bigint").alias("batch_id"))


def q_ordered_union(spark, sf):
    """U2 + U1: document lines, then user turns, as one ordered list of posts per first letter; the
    source and place of each post's first occurrence."""
    lines = _doc_lines(spark, sf).select(T.trim_ws("post").alias("post"), F.col("doc_id").alias("a"), F.col("line_no").cast("bigint").alias("b"))
    turns = table(spark, sf, "conversations").filter("role = 'user'").select(T.trim_ws("text").alias("post"), F.col("conv_id").alias("a"), F.col("turn").cast("bigint").alias("b"))
    x = U.union_ordered(lines, turns).filter(F.col("post") != "").groupBy("post").agg(F.min(F.struct("source_ord", "a", "b")).alias("o"))
    return x.select(F.md5(F.encode("post", "UTF-8")).alias("post_md5"), F.col("o.source_ord").cast("bigint").alias("source_ord"), "o.a", "o.b")


def q_posts_insights(spark, sf):
    """J1 + J4: every planned post with its stored insight; failed or unanswered ones have none."""
    ins = M.analyze_results(*_analysis(spark, sf)).select("page_url", "seq", F.col("ins.status").alias("status"))
    return planned_posts(spark, sf).join(ins, ["page_url", "seq"], "left").select("seq", F.col("batch_id").cast("bigint").alias("batch_id"), "status")


def q_parse_quality(spark, sf):
    """Parse-status shares of the recorded analysis replies per page."""
    from ..operators.quality import parse_quality

    x = insights(spark, sf).select("page_url", F.col("ins.status").alias("status"), F.col("ins.summary_text").alias("summary"))
    return parse_quality(x, ["page_url"])


def q_retryable_errors(spark, sf):
    """F8 + S9 + J4: recorded failures, classified as retryable or fatal."""
    e = fixture(spark, sf, FX.ERRORS)
    return e.select("seq", "message", F.col("status").cast("string").alias("status"), "code",
                    G.is_retryable("message", "status", "code").alias("retryable"))


# ----------------------------------------------------------------------------------------------
# model-backed operators M1-M5 on stored replies (derived from whole texts; labelled: not model output)
# ----------------------------------------------------------------------------------------------
from ..operators import model_tasks as M  # noqa: E402
from ..operators.requests import request_key  # noqa: E402


def stored_replies(answers: DataFrame, task: str, key_cols: list[str], n: str) -> DataFrame:
    """A stored reply table for ``answers`` (key columns, ``reply``): some requests failed, some were
    never answered, chosen by the number ``n`` of the request."""
    failed = F.expr(FX.FAILED.format(n=n))
    x = answers.filter(~F.expr(FX.MISSING.format(n=n)))
    return x.select(
        request_key(task, key_cols).alias("key"), F.lit(task).alias("task"), F.when(~failed, F.col("reply")).alias("reply"),
        F.when(failed, "failed").otherwise("ok").alias("status"), F.when(failed, "Request timed out").alias("error"),
        F.lit(None).cast("int").alias("error_status"), F.when(failed, "ETIMEDOUT").alias("error_code"), F.lit(1).alias("attempts"),
    )


def _analysis(spark, sf):
    req = M.analyze_requests(fixture(spark, sf, FX.POSTS))
    return req, stored_replies(fixture(spark, sf, FX.ANALYSIS_REPLIES), "analyze", ["page_url", "seq"], "seq")


def q_analyze_replies(spark, sf):
    """M1 + J4: insights of the answered analysis requests (trimmed, empty replies kept)."""
    ins = M.analyze_results(*_analysis(spark, sf))
    return ins.select("seq", F.col("ins.status").alias("status"), F.col("ins.summary_text").alias("summary_text"),
                      F.col("ins.sentiment").alias("sentiment"), F.size("ins.topics").cast("bigint").alias("n_topics"))


def q_dead_letters(spark, sf):
    """S9 + J4: analysis requests that failed or were never answered."""
    return M.dead_letters(*_analysis(spark, sf)).select("seq", "status", "error", "error_code")


def q_ideate_replies(spark, sf):
    """M4: ideas of the posts with a truthy insight; the fallback idea where the call failed."""
    req = M.idea_requests(M.idea_inputs(insights(spark, sf), fixture(spark, sf, FX.POSTS)))
    rep = stored_replies(fixture(spark, sf, FX.IDEA_REPLIES), "ideate", ["page_url", "seq"], "seq")
    return M.idea_results(req, rep).select("seq", F.size("ideas").cast("bigint").alias("n_ideas"), _j("ideas").alias("ideas"))


def _rank_answers(spark, sf):
    st = store(spark, sf, reuse=True)
    p = S.payload_ideas(st).withColumn("_at", (F.col("payload_pos") - 1) % S.IDEAS_PER_REQUEST)
    at = lambda k: F.max(F.when(F.col("_at") == k, F.col("idea")))
    b = p.groupBy(*M.RANK_KEYS).agg(at(0).alias("i1"), F.coalesce(at(1), at(0)).alias("i2"))
    b = b.select(*M.RANK_KEYS, F.expr(FX.RANK_ITEM_1.replace("b.", "")).alias("it1"), F.expr(FX.RANK_ITEM_2.replace("b.", "")).alias("it2"))
    b = b.select(*M.RANK_KEYS, F.expr(FX.RANK_REPLY.replace("b.", "")).alias("reply"))
    return st, stored_replies(b, "rank", M.RANK_KEYS, "(batch_id + payload_no + length(page_url))")


def q_rank_replies(spark, sf):
    """M5: ranked rows and fallback headlines of every payload."""
    st, rep = _rank_answers(spark, sf)
    ranked, fallback = M.rank_results(st, M.rank_requests(st), rep)
    cols = ["page_url", F.col("batch_id").cast("bigint").alias("batch_id"), F.col("pos").cast("bigint").alias("pos"), "idea"]
    return ranked.select(*cols, F.lit("model").alias("rank_source")).unionByName(fallback.select(*cols, "rank_source"))


def q_extract_cand_replies(spark, sf):
    """M2 + B2 + P13: every document as a candidate block of its source; the reply of a request
    returns its blocks."""
    req = M.candidate_requests(_doc_blocks(spark, sf))
    keys = ["page_url", "cand_batch", "request_no"]
    body = F.expr(f"substring(prompt, {len(M.RQ.CANDIDATE_USER_HEAD) + 1}, length(prompt) - {len(M.RQ.CANDIDATE_USER_HEAD) + len(M.RQ.CANDIDATE_USER_TAIL)})")
    answers = req.select(*keys, F.concat(F.lit('Found: {"posts": '), body, F.lit("}")).alias("reply"))
    x = M.candidate_results(req, stored_replies(answers, "extract_candidates", keys, "cand_batch"))
    return x.select("page_url", F.length("post").cast("bigint").alias("n_chars"), F.md5(F.encode("post", "UTF-8")).alias("post_md5"))


def _doc_blocks(spark, sf):
    return table(spark, sf, "documents").select(F.col("source").alias("page_url"), F.col("doc_id").alias("pos"), F.col("text").alias("block"))


def q_extract_text_replies(spark, sf):
    """M3 + G1 + P12: every document as a page text; the reply of a chunk is the chunk itself, read line
    by line."""
    texts = table(spark, sf, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("page_url"), "text")
    req = M.chunk_requests(texts)
    answers = req.select("page_url", "chunk_no", F.expr(f"substring(prompt, {len(M.RQ.CHUNK_USER_HEAD) + 1})").alias("reply"))
    x = M.chunk_results(req, stored_replies(answers, "extract_chunk", ["page_url", "chunk_no"], "(chunk_no + length(page_url))"))
    return x.select("page_url", F.col("pos.chunk_no").alias("chunk_no"), F.col("pos.i").alias("line"), F.md5(F.encode("post", "UTF-8")).alias("post_md5"))


def _pages(spark, sf):
    from ..sources.tables import read_pages

    return read_pages(spark, f"{sf.rstrip('/')}/pages.parquet")


def q_stream_pages(spark, sf):
    """S3 -> F1 -> G3 -> U1 -> T3: page snapshots arriving as files, parsed per micro-batch, their posts
    released; pages of one round are flushed at the end."""
    from ..operators import html_blocks as H
    from ..sources.tables import stream_pages
    from ..streaming.stream import Release, run_stream

    base = scratch_folder(spark, "stream-pages")
    table(spark, sf, "pages").select("page_id", "url", "html").write.parquet(f"{base}/in")
    rel = Release(spark, f"{base}/tables")

    def handle(batch: DataFrame, epoch: int) -> None:
        kept, _ = G.url_gate(batch)
        posts = H.selector_scan(H.page_blocks(kept))
        posts = materialize(posts.select("page_url", F.col("pos").alias("seq"), "post"))  # a round reads them twice
        rel.round(posts, epoch)
        drop_table(posts)

    run_stream(stream_pages(spark, f"{base}/in"), handle, f"{base}/ckpt").awaitTermination()
    rel.finish()
    return rel.released().select("page_url", F.col("batch_id").cast("bigint").alias("batch_id"), "seq", F.md5(F.encode("post", "UTF-8")).alias("post_md5"))


def q_page_candidates(spark, sf):
    """S2 + G2 + F2 + F3 + U1: all candidate blocks of every page."""
    from ..operators import html_blocks as H

    kept, _ = G.url_gate(_pages(spark, sf))
    c = H.candidates(materialize(H.page_blocks(kept)))  # blocks read twice: parse the HTML once
    return c.select("page_url", F.col("pos").cast("bigint").alias("pos"), F.length("block").cast("bigint").alias("n_chars"),
                    F.md5(F.encode("block", "UTF-8")).alias("block_md5"))


def q_page_selector_scan(spark, sf):
    """Selector-scan posts of every page."""
    from ..operators import html_blocks as H

    kept, _ = G.url_gate(_pages(spark, sf))
    s = H.selector_scan(materialize(H.page_blocks(kept)))
    return s.select("page_url", F.col("pos").cast("bigint").alias("pos"), F.length("post").cast("bigint").alias("n_chars"),
                    F.md5(F.encode("post", "UTF-8")).alias("post_md5"))


def q_page_cascade(spark, sf):
    """U4 + M2 + M3 + G4: extractor cascade on stored replies, each tier for the pages still open. The candidate replies of a
    third of the pages and the text replies of a ninth are missing, so all three tiers are used."""
    kept, _ = G.url_gate(_pages(spark, sf))

    def answer(r: DataFrame) -> DataFrame:
        first = "cand_batch" in r.columns
        silent = F.pmod(F.crc32("page_url"), F.lit(3 if first else 9)) == 0
        if first:
            body = F.expr(f"substring(prompt, {len(M.RQ.CANDIDATE_USER_HEAD) + 1}, length(prompt) - {len(M.RQ.CANDIDATE_USER_HEAD) + len(M.RQ.CANDIDATE_USER_TAIL)})")
            keys, reply, task = ["page_url", "cand_batch", "request_no"], F.concat(F.lit('{"posts": '), body, F.lit("}")), "extract_candidates"
        else:
            keys, reply, task = ["page_url", "chunk_no"], F.expr(f"substring(prompt, {len(M.RQ.CHUNK_USER_HEAD) + 1})"), "extract_chunk"
        return stored_replies(r.filter(~silent).select(*keys, reply.alias("reply")), task, keys, "0")

    p = M.extract_posts(kept, answer)
    return p.select("page_url", "tier", F.length("post").cast("bigint").alias("n_chars"), F.md5(F.encode("post", "UTF-8")).alias("post_md5"))


# ----------------------------------------------------------------------------------------------
# native stand-ins (M6-M9) [ours]
# ----------------------------------------------------------------------------------------------
def q_sentiment_lexicon(spark, sf):
    """M6: lexicon sentiment of every document."""
    from ..operators.native import native_sentiment

    s = native_sentiment(table(spark, sf, "documents"))
    return s.select("doc_id", "score", F.col("n_hits").cast("bigint").alias("n_hits"), "sentiment")


def q_topics_tfidf(spark, sf):
    """M7: top-5 TF-IDF terms of every document."""
    from ..operators.native import native_topics

    t = native_topics(table(spark, sf, "documents"))
    return t.select("doc_id", _j("topics").alias("topics"))


def q_summary_lead(spark, sf):
    """M8: leading sentence (<= 200 chars) of every document."""
    from ..operators.native import native_summary

    d = table(spark, sf, "documents")
    return d.select("doc_id", native_summary(F.col("text")).alias("summary"))


def q_toxicity_lr(spark, sf):
    """M9: toxicity score of every document from word log odds counted on the labels."""
    from ..operators.native import fit_toxicity, native_toxicity

    docs = table(spark, sf, "documents")
    labelled = docs.join(table(spark, sf, "labels").filter("toxic IS NOT NULL"), "doc_id")
    return native_toxicity(docs, fit_toxicity(labelled))


# ----------------------------------------------------------------------------------------------
# streaming (T1-T5, S3): page snapshots replayed as file rounds in the checkpoint folder
# ----------------------------------------------------------------------------------------------
def _page_rounds(posts: DataFrame) -> DataFrame:
    """Posts with the round in which they first appear (``arrives``) on a page that is read ``n_rounds``
    times (1 to 3, by its name)."""
    n = (F.ascii(F.substring("page_url", -1, 1)) % 3 + 1).cast("int")
    x = posts.withColumn("n_rounds", n)
    return x.withColumn("arrives", F.least(F.col("seq") % 3, F.col("n_rounds") - 1).cast("int"))


def _replay(spark, posts: DataFrame, name: str, schema: str, handle):
    """Growing snapshots of every page, one stream run per round on the same checkpoint: round ``r`` holds
    the posts that have arrived on the pages that are read at least ``r + 1`` times."""
    from ..streaming.stream import run_stream

    base = scratch_folder(spark, name)
    posts = materialize(posts)
    for r in range(3):
        posts.filter((F.col("arrives") <= r) & (F.col("n_rounds") > r)).select("page_url", "seq", "post").write.option("compression", CODEC).parquet(f"{base}/in/r{r:03d}")
        s = spark.readStream.schema(schema).parquet(f"{base}/in/*")
        run_stream(s, handle, f"{base}/ckpt").awaitTermination()


def q_stream_distinct(spark, sf):
    """T1 + S3: documents as a post stream; first occurrence per (source page, trimmed post)."""
    from ..streaming.stream import stream_distinct

    base = scratch_folder(spark, "stream-distinct")
    posts = fixture(spark, sf, FX.POSTS).select("page_url", "seq", T.trim_ws("post").alias("post")).filter(F.col("post") != "")
    posts.write.parquet(f"{base}/in/r000")
    s = spark.readStream.schema(posts.schema).parquet(f"{base}/in/*")
    d = stream_distinct(s).select("page_url", "post")
    q = d.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(d.schema).parquet(f"{base}/out")


def _release(spark, sf, name: str, on_release=None):
    from ..streaming.stream import SEEN, Release

    rel = Release(spark, scratch_folder(spark, name), on_release=on_release)
    posts = _page_rounds(U.distinct_posts(fixture(spark, sf, FX.POSTS)).select("page_url", "seq", "post"))
    _replay(spark, posts, name, SEEN, rel.round)
    rel.finish()
    return rel


def q_stream_batches(spark, sf):
    """T2 (dry rounds) + T3 + T4 + S3: growing snapshots of pages that appear in one, two or three
    rounds, different posts per round -> released batches; leftovers are flushed."""
    rel = _release(spark, sf, "stream-batches")
    dry = rel.pages().select("page_url", F.col("dry_rounds").cast("bigint").alias("dry_rounds"))
    out = rel.released().join(dry, "page_url")
    return out.select("page_url", "seq", F.col("batch_id").cast("bigint").alias("batch_id"), F.col("round").cast("bigint").alias("round"), "dry_rounds")


def q_reply_text(spark, sf):
    """P10: reply text of recorded service envelopes, chat and responses forms."""
    e = fixture(spark, sf, FX.ENVELOPES)
    return e.select("seq", J.reply_text("envelope", "chat").alias("chat_text"), J.reply_text("envelope", "responses").alias("responses_text"))


def q_insight_log(spark, sf):
    """S4 + S5 + A9: truthy insights appended to a JSON-lines log, read back, summarised per page."""
    from ..sources.insight_log import append_insights, log_quality, read_insights

    path = scratch_folder(spark, "insight-log")
    append_insights(materialize(insights(spark, sf)), path, key="analysis")
    log = read_insights(spark, path)
    return log_quality(log)


def q_stream_rounds(spark, sf):
    """T1 + T2 + S3: document lines of each source arriving in three growing snapshots (round r
    holds the documents with ``doc_id % 3 <= r``); new distinct lines per page and round.

    Each round is written, then the stream runs to completion on the same checkpoint, as rounds
    arriving over time would (de-dup state and counts carry over)."""
    from ..streaming.stream import stream_distinct, stream_round_counts

    base = scratch_folder(spark, "stream-rounds")
    lines = _doc_lines(spark, sf).select("page_url", "doc_id", T.trim_ws("post").alias("post")).filter(F.col("post") != "")
    schema = "page_url string, post string, round int"

    def keep(counts: DataFrame, epoch: int) -> None:  # complete mode: the whole table each time
        counts.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    for r in range(3):
        lines.filter(F.col("doc_id") % 3 <= r).select("page_url", "post", F.lit(r).alias("round")).write.parquet(f"{base}/in/r{r:03d}")
        s = spark.readStream.schema(schema).parquet(f"{base}/in/*")
        counts = stream_round_counts(stream_distinct(s))
        q = counts.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start()
        q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    last = out.agg(F.max("epoch")).first()[0]
    return out.filter(F.col("epoch") == last).select("page_url", F.col("round").cast("bigint").alias("round"), F.col("new_found").cast("bigint").alias("new_found"))


def q_idea_topic_sets(spark, sf):
    """A5 long form: every distinct topic of every idea-store key with its first-seen position."""
    t = S.idea_topics(events(spark, sf))
    return t.select(
        "page_url", F.col("batch_id").cast("bigint").alias("batch_id"), "idea", "topic",
        F.col("o.seq").alias("first_seq"), F.col("o.idea_pos").cast("bigint").alias("first_pos"),
        F.col("o.t_pos").cast("bigint").alias("t_pos"),
    )


def _streamed_store(spark, sf, name: str):
    """T5 + T3 + S3: the batches released by each round of the snapshot stream (pages of one to three rounds) go
    through the insight and idea joins into the idea store while the stream runs."""
    from ..streaming.store import IncrementalStore

    replies = materialize(parsed_replies(spark, sf))
    store = IncrementalStore(spark, scratch_folder(spark, name), lambda posts: ideas_of(spark, sf, S.with_example(posts.drop("round")), replies))
    _release(spark, sf, name, store)
    return store


def q_stream_idea_store(spark, sf):
    """T5: store rows of all released batches."""
    st = _streamed_store(spark, sf, "stream-ideas").store()
    return st.select(
        "page_url", F.col("batch_id").cast("bigint").alias("batch_id"), "idea",
        "first_seq", F.col("first_pos").cast("bigint").alias("first_pos"), "cnt", "sentiment_sum",
        _j("examples").alias("examples"), "n_topics", _j("topics").alias("topics"),
        "n_reasons", _j("reasons").alias("reasons"),
    )


def q_stream_idea_totals(spark, sf):
    """T5 + A10: totals per page and idea, folded release by release."""
    t = _streamed_store(spark, sf, "stream-totals").totals()
    return t.select("page_url", "idea", "cnt", "sentiment_sum", "n_batches", F.col("first.batch_id").cast("bigint").alias("first_batch"),
                    F.col("first.seq").alias("first_seq"), _j(F.transform("examples", lambda x: x["example"])).alias("examples"))


def q_stream_distinct_window(spark, sf):
    """T1 with a watermark: distinct (user, event type, hour) of events that arrive in time order over three runs;
    the state of an hour is given up two hours later."""
    from ..streaming.stream import stream_distinct

    base = scratch_folder(spark, "stream-window")
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", F.date_trunc("hour", "ts").alias("hour"))
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    schema = "user_id bigint, event_type string, ts timestamp, hour timestamp"
    for r in range(3):
        at = [lo + (hi - lo) * k / 3 for k in (r, r + 1)] if lo else [None, None]
        part = (F.col("ts") >= F.lit(at[0])) & ((F.col("ts") < F.lit(at[1])) | F.lit(r == 2))
        e.filter(part).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")]).write.parquet(f"{base}/in/r{r:03d}")
        d = stream_distinct(spark.readStream.schema(schema).parquet(f"{base}/in/*"), ("ts", "2 hours"), ("user_id", "event_type", "hour"))
        q = d.select("user_id", "event_type", "hour").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start()
        q.awaitTermination()
    out = spark.read.schema("user_id bigint, event_type string, hour timestamp").parquet(f"{base}/out")
    return out.select("user_id", "event_type", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"))


def q_stream_metrics(spark, sf):
    """A7 + T2 from observed metrics: posts read, new and released in each round, counted by the jobs that write
    them."""
    rel = _release(spark, sf, "stream-metrics")
    rows = [(i, *[int(m.get(k, 0)) for k in ("posts_read", "new_found", "released")]) for i, (_, m) in enumerate(sorted(rel.metrics.items()))]
    return spark.createDataFrame(rows, "round bigint, posts_read bigint, new_found bigint, released bigint")


def q_idea_reason_sets(spark, sf):
    """A6 long form: every distinct reason (summary <= 200 chars) of every idea-store key with its
    first-seen position."""
    r = S.idea_reasons(events(spark, sf))
    return r.select(
        "page_url", F.col("batch_id").cast("bigint").alias("batch_id"), "idea", "reason",
        F.col("o.seq").alias("first_seq"), F.col("o.idea_pos").cast("bigint").alias("first_pos"),
    )
