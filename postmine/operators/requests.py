"""Request building (P6-P8): prompts as Catalyst string expressions, one row per model call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions.text import _c, collapse_ws, escape_prompt, trim_ws

# Prompt texts of the five model tasks.
ANALYSIS_PROMPT_HEAD = (
    "Analyze the following social post and return a JSON object with keys:\n"
    "- summary: short summary\n"
    '- sentiment: "positive" | "neutral" | "negative"\n'
    "- topics: array of short topic strings\n"
    "- toxicityScore: number between 0 and 1\n"
    "\n"
    "Post:\n"
    '"""'
)
ANALYSIS_PROMPT_TAIL = '"""'

CHUNK_SYSTEM = (
    'You are a helpful extractor. Given visible text, extract distinct user-visible "posts" or meaningful message '
    "blocks (e.g., social media posts, forum messages). Return only valid JSON in the exact format:\n\n"
    '{"posts": ["post 1 text", "post 2 text", ...]}\n\n'
    "Do not include any additional commentary. Prefer the visible plaintext content, strip UI chrome, timestamps, "
    "or usernames unless they are part of the message. Keep posts trimmed."
)
CHUNK_USER_HEAD = "Extract posts from the following text (do NOT add commentary):\n\n"

CANDIDATE_SYSTEM = (
    "You are an extractor. Given a list of candidate text blocks (each may be a UI fragment or a user-visible "
    'message), return a JSON object exactly like:\n{"posts": ["post text 1", "post text 2", ...]}\n'
    "Only include true user-visible posts/messages, normalized and trimmed. Do not include UI chrome, timestamps "
    "or usernames unless they are integral to the message."
)
CANDIDATE_USER_HEAD = (
    "Here are candidate blocks (JSON array). For each, include it as source but only return items that are "
    "actual posts/messages.\n\n"
)
CANDIDATE_USER_TAIL = '\n\nReturn exactly: {"posts":[...]} without extra commentary.'

IDEA_SYSTEM = (
    "You are a senior product strategy advisor focused on high-leverage, differentiated, revenue-ready "
    'opportunities. Ignore generic "guides", "subscriptions" or trivial productizations unless you can justify '
    "why they are unique and high-value."
)
IDEA_USER_HEAD = "Input JSON:\n"
IDEA_USER_TAIL = (
    "\n\nTASK: Return AT MOST 3 non-obvious, high-value product or service ideas that are clearly differentiated "
    "and monetizable. Each idea must be a single string in this exact compact format (no extra text, return "
    "EXACTLY a JSON array of strings):\n\n"
    '"Title — 1-line pitch (what it does) | Why this is high-value & differentiated (one short reason) | '
    'Suggested price/packaging"\n\n'
    "Examples (do NOT copy these): \n"
    '["On-demand field calibration service — Rapid on-site calibration for [topic] | High-value because it '
    'eliminates costly downtime for pros | Suggested: $299/site or $49/mo monitoring"]\n\n'
    "Constraints:\n"
    "- Be specific (mention the target user or context).\n"
    "- Emphasize why it's non-obvious (unique channel, technical moat, business model lever).\n"
    "- Prioritize ideas that can command $100+ initial or $20+/mo recurring where sensible.\n"
    "- Limit to max 3 items. Return EXACTLY one JSON array and nothing else."
)

RANK_SYSTEM = (
    "You are an expert product/market analyst. Given a list of candidate product ideas with simple signals "
    "(count, sentimentSum, topics, examples, reasons), rank them by priority and return a concise JSON object "
    'only with the shape: {"ranked":[{"idea":"string","priority":1,"score":4.2,"rationale":"text",'
    '"estimated_revenue_usd":12345,"recommended_price_range":"$","go_to_market_channels":["c"],"examples":["..."]}]}.'
)
RANK_USER_HEAD = "Input:\n"
RANK_USER_TAIL = "\n\nOutput must be EXACT valid JSON as described. Keep rationale concise."

# Ideation input caps.
IDEA_SUMMARY_CHARS = 800
IDEA_POST_CHARS = 800
IDEA_MAX_TOPICS = 5
IDEA_MAX_EXAMPLES = 2


def analysis_prompt(text) -> Column:
    """P6 + P7 (analysis task)."""
    return F.concat(F.lit(ANALYSIS_PROMPT_HEAD), escape_prompt(_c(text)), F.lit(ANALYSIS_PROMPT_TAIL))


def chunk_prompt(chunk) -> Column:
    return F.concat(F.lit(CHUNK_USER_HEAD), _c(chunk))


def candidate_prompt(items_json) -> Column:
    return F.concat(F.lit(CANDIDATE_USER_HEAD), _c(items_json), F.lit(CANDIDATE_USER_TAIL))


def idea_input(df: DataFrame, ins_col: str = "ins", post_col: str = "post") -> Column:
    """Ideation input struct from a parsed insight and the post text."""
    return F.struct(*insight_input(ins_col), post_input(post_col).alias("post"))


def insight_input(ins_col: str = "ins") -> list[Column]:
    """What the ideation input takes of an insight."""
    ins = F.col(ins_col)
    payload = ins["payload"]
    return [
        F.substring(trim_ws(collapse_ws(ins["summary_text"])), 1, IDEA_SUMMARY_CHARS).alias("summary"),
        ins["sentiment"].alias("sentiment"),
        F.slice(ins["topics"], 1, IDEA_MAX_TOPICS).alias("topics"),
        F.slice(J.string_items(J.field(payload, "$.examples")), 1, IDEA_MAX_EXAMPLES).alias("examples"),
    ]


def post_input(post_col: str = "post") -> Column:
    """What the ideation input takes of a post."""
    return F.substring(F.coalesce(F.col(post_col), F.lit("")), 1, IDEA_POST_CHARS)


def json_text(c) -> Column:
    """A string as JSON text, quoted and escaped."""
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(_c(c), F.lit("")).alias("s"))), r'(?s)^\{"s":(.*)\}$', 1)


def json_array(items, indent: int) -> Column:
    """JSON texts as an indented array (two blanks a level); empty: ``[]``."""
    inner, outer = "\n" + " " * (indent + 2), "\n" + " " * indent
    text = lambda a: F.when(F.size(a) == 0, F.lit("[]")).otherwise(F.concat(F.lit("[" + inner), F.array_join(a, "," + inner), F.lit(outer + "]")))
    return F.transform(F.array(items), text)[0]  # the items are evaluated once


def json_object(fields, indent: int) -> Column:
    """``(name, JSON text)`` pairs as an indented object."""
    inner, outer = "\n" + " " * (indent + 2), "\n" + " " * indent
    parts = [F.concat(F.lit(f'{inner}"{n}": '), v) for n, v in fields]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit(outer + "}"))


def json_strings(c, indent: int) -> Column:
    return json_array(F.transform(_c(c), json_text), indent)


def with_idea_prompt(df: DataFrame, inp: str, prompt: str) -> DataFrame:
    """Add the ideation prompt of a struct column ``inp`` (:func:`idea_input`); the input is written with an
    indent of two, as the prompt's author did."""
    i = F.col(inp)
    texts = {"summary": json_text(i["summary"]), "sentiment": json_text(i["sentiment"]), "topics": json_strings(i["topics"], 2),
             "examples": json_strings(i["examples"], 2), "post": json_text(i["post"])}
    return df.withColumn(prompt, F.concat(F.lit(IDEA_USER_HEAD), json_object(list(texts.items()), 0), F.lit(IDEA_USER_TAIL)))


def with_ranked_idea(df: DataFrame, name: str) -> DataFrame:
    """Add the JSON text of each store row's idea, indented as an item of the ranking payload's array."""
    texts = {"idea": json_text("idea"), "count": F.col("cnt").cast("string"), "sentimentSum": F.col("sentiment_sum").cast("string"),
             "topics": json_strings("topics", 6), "examples": json_strings("examples", 6), "reasons": json_strings("reasons", 6)}
    return df.withColumn(name, json_object(list(texts.items()), 4))


def rank_prompt(payload_json) -> Column:
    return F.concat(F.lit(RANK_USER_HEAD), _c(payload_json), F.lit(RANK_USER_TAIL))


def request_key(task: str, key_cols) -> Column:
    """Stable hash of task and key columns."""
    return F.sha2(F.concat_ws("\u0001", F.lit(task), *[F.col(c).cast("string") for c in key_cols]), 256)


def build_requests(df: DataFrame, task: str, key_cols, prompt: Column, system: str | None = None, carry=None) -> DataFrame:
    """Rows ``(key, task, system, prompt)`` with the key columns (or all of ``carry``); ``key`` is a
    stable hash, so a re-run can anti-join the replies already stored (idempotent calls)."""
    key = request_key(task, key_cols)
    return df.select(
        *(carry or key_cols), key.alias("key"), F.lit(task).alias("task"), F.lit(system).cast("string").alias("system"), prompt.alias("prompt")
    )
