"""Ranking and reporting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions.text import collapse_ws, ellipsis_if_longer
from .batching import top_k_by
from .idea_store import payload_ideas
from .segmented import segment_rank

# Report layout.
REPORT_HEADER = "--- Product Ideas (LLM-ranked) ---"
REPORT_FOOTER = "---"
REPORT_NONE = "No product ideas generated for this batch."
REPORT_FALLBACK = "Fallback — listing idea headlines:"
EXAMPLE_PREVIEW_CHARS = 240
MAX_REPORT_EXAMPLES = 3

RANKED_FIELDS = ["idea", "priority", "score", "rationale", "estimated_revenue_usd", "recommended_price_range",
                 "go_to_market_channels", "examples"]


def js_number_text(v: Column) -> Column:
    """``String(Number(x))`` for a JSON value (numbers and numeric strings; else ``NaN``)."""
    d = F.when(J.vtype(v) == "STRING", F.trim(J.js_string(v)).try_cast("double")).otherwise(
        F.try_variant_get(v, "$", "double")
    )
    d = F.when(J.is_json_null(v), F.lit(0.0)).when(J.vtype(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")).otherwise(d)
    integral = (d == F.floor(d)) & (F.abs(d) < F.lit(1e15))
    return F.when(d.isNull(), F.lit("NaN")).when(integral, F.floor(d).cast("bigint").cast("string")).otherwise(d.cast("string"))


def to_fixed2(v: Column) -> Column:
    """``Number(x).toFixed(2)`` (half-up on the decimal value)."""
    d = F.when(J.vtype(v) == "STRING", F.trim(J.js_string(v)).try_cast("double")).otherwise(
        F.try_variant_get(v, "$", "double")
    )
    d = F.when(J.is_json_null(v), F.lit(0.0)).otherwise(d)
    return F.when(d.isNull(), F.lit("NaN")).otherwise(F.round(d.cast("decimal(38,10)"), 2).cast("decimal(38,2)").cast("string"))


def ranked_rows(replies: DataFrame, reply_col: str = "reply", keys=("page_url", "batch_id")) -> DataFrame:
    """P15 + G7 + W2: parse the ranking reply and explode ``ranked`` (``pos`` 1-based, model order).

    Batches whose reply has no non-empty ``ranked`` array produce no rows here (see
    :func:`rank_fallback`). Typed fields are null when absent or of the wrong type; ``item`` keeps
    the raw JSON value for rendering. Fields are extracted once into columns, then typed.
    """
    keys = list(keys)
    r = J.with_object(replies.select(*keys, reply_col), reply_col, "_obj")
    r = r.withColumn("_ranked", J.field(F.col("_obj"), "$.ranked"))
    arr = F.try_variant_get(F.col("_ranked"), "$", "array<variant>")
    x = r.select(*keys, F.when(J.is_array(F.col("_ranked")), arr).alias("_arr")).select(
        *keys, F.posexplode("_arr").alias("pos0", "item")
    )
    it = F.col("item")
    x = x.select(*keys, (F.col("pos0") + 1).alias("pos"), "item",
                 *[J.field(it, f"$.{f}").alias(f"_f_{f}") for f in ("idea", "go_to_market_channels", "examples")])
    return x.select(
        *keys,
        "pos",
        "item",
        F.when(F.col("_f_idea").isNotNull(), J.js_string(F.col("_f_idea"))).alias("idea"),
        F.try_variant_get(it, "$.priority", "bigint").alias("priority"),
        F.try_variant_get(it, "$.score", "double").alias("score"),
        F.try_variant_get(it, "$.rationale", "string").alias("rationale"),
        F.try_variant_get(it, "$.estimated_revenue_usd", "double").alias("estimated_revenue_usd"),
        F.try_variant_get(it, "$.recommended_price_range", "string").alias("recommended_price_range"),
        J.string_items(F.col("_f_go_to_market_channels")).alias("channels"),
        J.string_items(F.col("_f_examples")).alias("examples"),
    )


def rank_ok(replies: DataFrame, reply_col: str = "reply", keys=("page_url", "batch_id")) -> DataFrame:
    """Per batch: does the reply carry a non-empty ``ranked`` array?"""
    r = J.with_object(replies.select(*keys, reply_col), reply_col, "_obj")
    r = r.withColumn("_ranked", J.field(F.col("_obj"), "$.ranked"))
    arr = F.try_variant_get(F.col("_ranked"), "$", "array<variant>")
    ok = J.is_array(F.col("_ranked")) & (F.coalesce(F.size(arr), F.lit(0)) > 0)
    return r.select(*keys, F.coalesce(ok, F.lit(False)).alias("rank_ok"))


def rank_fallback(store: DataFrame, replies: DataFrame, reply_col: str = "reply", keys=("page_url", "batch_id")) -> DataFrame:
    """For batches whose ranking failed (no reply, unparsable, no ``ranked``), list all payload
    ideas as headlines in first-seen order (``rank_source='fallback'``)."""
    keys = list(keys)
    good = rank_ok(replies, reply_col, keys).filter("rank_ok").select(*keys)
    first = payload_ideas(store)
    return first.join(good, keys, "left_anti").select(
        "page_url", "batch_id", F.col("payload_pos").alias("pos"), "idea", F.lit("fallback").alias("rank_source")
    )


def all_batches(planned: DataFrame, store: DataFrame) -> DataFrame:
    """Every planned batch with its idea count (0 -> no ranking request, still reported)."""
    keys = ["page_url", "batch_id"]
    b = planned.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_posts"))
    n = store.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_ideas"))
    return b.join(n, keys, "left").select(*keys, "n_posts", F.coalesce("n_ideas", F.lit(0)).cast("bigint").alias("n_ideas"))


def rank_native(store: DataFrame) -> DataFrame:
    """W5 [ours]: rank every idea of a batch by signals: count desc, sentiment sum desc, number of topics
    desc, first seen. A batch of any size is ranked by many tasks (:func:`segment_rank`)."""
    order = [F.desc("cnt"), F.desc("sentiment_sum"), F.desc("n_topics"), F.asc("first_seq"), F.asc("first_pos"), F.asc("idea")]
    return segment_rank(store, ["page_url", "batch_id"], order, "rank")


def attach_signals(ranked: DataFrame, store: DataFrame) -> DataFrame:
    """J3 [ours]: ranked rows left-join the store signals of the same idea in the same batch."""
    s = store.select("page_url", "batch_id", "idea", "cnt", "sentiment_sum", "n_topics")
    return ranked.join(s, ["page_url", "batch_id", "idea"], "left")


def revenue_top_k(ranked: DataFrame, k: int = 3) -> DataFrame:
    """The documented intent — top ``k`` per batch by estimated revenue (nulls last, model
    order breaks ties). Off by default in the pipeline."""
    return top_k_by(
        ranked, ["page_url", "batch_id"], [F.desc_nulls_last("estimated_revenue_usd"), F.asc("pos")], k, "revenue_rank"
    )


def report_block(item: Column | None, pos: Column, staged: bool = False) -> Column:
    """The printed block of one ranked item (lines joined by newline; absent lines skipped).

    ``staged``: read fields from ``_r_<field>`` columns (see :func:`report_lines`)."""
    if staged:
        g = lambda p: F.col("_r_" + p[2:])
    else:
        g = lambda p: J.field(item, p)
    chans = F.try_variant_get(g("$.go_to_market_channels"), "$", "array<variant>")
    chan_text = F.array_join(F.transform(chans, lambda x: F.when(J.is_json_null(x), F.lit("")).otherwise(J.js_string(x))), ", ")
    exs = F.try_variant_get(g("$.examples"), "$", "array<variant>")
    ex_lines = F.transform(
        F.slice(exs, 1, MAX_REPORT_EXAMPLES),
        lambda x, i: F.concat(
            F.lit("  "), (i + 1).cast("string"), F.lit(". "),
            F.substring(collapse_ws(J.js_string(x)), 1, EXAMPLE_PREVIEW_CHARS),
            ellipsis_if_longer(J.js_string(x), EXAMPLE_PREVIEW_CHARS),
        ),
    )
    has = lambda p: g(p).isNotNull()
    idea_txt = F.when(has("$.idea"), J.js_string(g("$.idea"))).otherwise(F.lit("undefined"))
    lines = F.concat_ws(
        "\n",
        F.lit(""),
        F.concat(pos.cast("string"), F.lit(". "), idea_txt),
        F.when(has("$.priority"), F.concat(F.lit("Priority: "), J.js_string(g("$.priority")))),
        F.when(has("$.score"), F.concat(F.lit("Score: "), to_fixed2(g("$.score")))),
        F.when(has("$.estimated_revenue_usd"), F.concat(F.lit("Estimated revenue (USD): $"), js_number_text(g("$.estimated_revenue_usd")))),
        F.when(J.truthy(g("$.recommended_price_range")), F.concat(F.lit("Recommended price range: "), J.js_string(g("$.recommended_price_range")))),
        F.when(J.is_array(g("$.go_to_market_channels")) & (F.size(chans) > 0), F.concat(F.lit("Go-to-market channels: "), chan_text)),
        F.when(J.truthy(g("$.rationale")), F.concat(F.lit("Rationale: "), J.js_string(g("$.rationale")))),
        F.when(J.is_array(g("$.examples")) & (F.size(exs) > 0), F.concat_ws("\n", F.lit("Examples:"), F.array_join(ex_lines, "\n"))),
        F.lit(REPORT_FOOTER),
    )
    return lines


REPORT_FIELDS = ["idea", "priority", "score", "estimated_revenue_usd", "recommended_price_range",
                 "go_to_market_channels", "rationale", "examples"]


def report_lines(ranked: DataFrame) -> DataFrame:
    """One text block per ranked row; order by ``(page_url, batch_id, pos)`` when writing.

    Each field is extracted once into a column before rendering."""
    it = F.col("item")
    x = ranked.select("page_url", "batch_id", "pos", *[J.field(it, f"$.{f}").alias(f"_r_{f}") for f in REPORT_FIELDS])
    return x.select("page_url", "batch_id", "pos", report_block(None, F.col("pos"), staged=True).alias("block"))


def report_document(counts: DataFrame, blocks: DataFrame, fallback: DataFrame) -> DataFrame:
    """The printed lines of every batch ``(page_url, batch_id, section, pos, text)``: a header and
    the ranked blocks, or the fallback headlines, or the line for a batch without ideas. ``counts``:
    every batch with ``n_ideas``; ``blocks``: report blocks; ``fallback``: headlines."""
    keys = ["page_url", "batch_id"]
    line = lambda d, section, pos, text: d.select(*keys, F.lit(section).alias("section"), pos.cast("bigint").alias("pos"), text.alias("text"))
    zero = F.lit(0)
    headed = blocks.select(*keys).distinct()
    failed = fallback.select(*keys).distinct()
    return (
        line(headed, 0, zero, F.lit(REPORT_HEADER))
        .unionByName(line(blocks, 1, F.col("pos"), F.col("block")))
        .unionByName(line(failed, 2, zero, F.lit(REPORT_FALLBACK)))
        .unionByName(line(fallback, 3, F.col("pos"), F.concat(F.lit(" - "), F.col("idea"))))
        .unionByName(line(counts.filter("n_ideas = 0"), 4, zero, F.lit(REPORT_NONE)))
    )


def write_report(document: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Text sink, lines of a report document in global order over the part files. Range
    partitioning deals a page with many batches over several files."""
    order = ["page_url", "batch_id", "section", "pos"]
    document.repartitionByRange(*order).sortWithinPartitions(*order).select("text").write.mode(mode).text(path)
