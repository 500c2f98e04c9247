"""Recorded model replies derived from the given tables by SQL that runs unchanged in Spark SQL and
DuckDB (only ``||``, ``substring``, ``translate``, ``replace``, ``CASE``, ``%``, ``CAST``, ``chr`` with
ASCII codes and plain literals). The reply *shapes* cover what model services return in practice:
strict JSON, fenced, prose-wrapped, trailing comma, curly quotes, plain lines, truncated, empty and
scalar JSON. Table names are written ``@name@`` and substituted per engine.

These are test inputs for the parsing and aggregation stages, standing in for a model: they say
nothing about model quality.
"""

from __future__ import annotations

SNIP = "translate(d.text, '\"' || chr(92) || chr(10) || chr(13) || chr(9), '')"

_SENT = (
    "CASE d.doc_id % 5 WHEN 0 THEN 'Positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'neutral' "
    "WHEN 3 THEN 'very positive' ELSE 'mixed' END"
)
_TOPICS = (
    "'\"' || d.lang || '\", \"' || d.source || '\", \"t' || CAST(d.doc_id % 7 AS STRING) || '\"' || "
    "CASE WHEN d.doc_id % 4 = 0 THEN ', \"x1\", \"x2\", \"x3\", \"' || d.lang || '\"' ELSE '' END"
)
_TOX = "CASE WHEN d.doc_id % 10 = 0 THEN '0' ELSE '0.' || CAST(d.doc_id % 10 AS STRING) END"

ANALYSIS_OBJ = (
    "'{\"summary\": \"Post ' || CAST(d.doc_id AS STRING) || ': ' || " + SNIP + " || '\", \"sentiment\": \"' || "
    + _SENT + " || '\", \"topics\": [' || " + _TOPICS + " || '], \"toxicityScore\": ' || " + _TOX + " || '}'"
)

# analysis reply shape by doc_id % 8 (and % 16 for the empty / JSON-null pair)
ANALYSIS_REPLY = """
CASE d.doc_id % 8
  WHEN 0 THEN d.obj
  WHEN 1 THEN '```json' || chr(10) || d.obj || chr(10) || '```'
  WHEN 2 THEN 'Here is the analysis: ' || d.obj || ' Hope it helps.'
  WHEN 3 THEN replace(d.obj, '}', ', }')
  WHEN 4 THEN replace(d.obj, '"summary"', '“summary”')
  WHEN 5 THEN 'Summary: ' || d.snip || chr(10) || 'Sentiment: neutral'
  WHEN 6 THEN substring(d.obj, 1, length(d.obj) - 5)
  ELSE CASE WHEN d.doc_id % 16 = 7 THEN '' ELSE 'null' END
END"""


def _idea(j: str) -> str:
    return (
        f"'Idea ' || CAST({j} AS STRING) || ': Field kit for ' || d.lang || ' — rapid help for ' || d.lang || "
        f"' readers | saves time | Suggested: $' || CAST({j} * 50 + 49 AS STRING) || '/mo'"
    )


I1 = _idea("d.doc_id % 5")
I2 = _idea("(d.doc_id + 2) % 5")
I3 = _idea("d.doc_id % 3 + 5")
# the whole text without what a JSON string would have to escape
I4 = "'Idea from a post: ' || translate(d.text, '\"' || chr(92) || chr(10) || chr(13) || chr(9), '')"
IDEA_SHAPE = "CAST(floor(d.doc_id / 8) AS BIGINT) % 8"

IDEA_REPLY = f"""
CASE {IDEA_SHAPE}
  WHEN 0 THEN '["' || d.i1 || '", "' || d.i2 || '"]'
  WHEN 1 THEN 'Ideas:' || chr(10) || '["' || d.i1 || '", "' || d.i4 || '"]' || chr(10) || 'Thanks'
  WHEN 2 THEN '["' || d.i1 || '", "' || d.i2 || '",]'
  WHEN 3 THEN '[“' || d.i2 || '”, “' || d.i3 || '”]'
  WHEN 4 THEN d.i1 || chr(10) || d.i2 || chr(10) || 'short line'
  WHEN 5 THEN 'n/a'
  WHEN 6 THEN '["Starter guide for ' || d.lang || ' readers", "Curated list of tools for ' || d.source || '"]'
  ELSE '["' || d.i1 || '", "' || d.i1 || '", "Checklist bundle for beginners everywhere", "' || d.i2 || '", "' || d.i3 || '"]'
END"""

POSTS = "SELECT d.source AS page_url, d.doc_id AS seq, d.text AS post FROM @documents@ d"
ANALYSIS_REPLIES = (
    f"SELECT d.source AS page_url, d.doc_id AS seq, {ANALYSIS_REPLY} AS reply FROM "
    f"(SELECT d.source, d.doc_id, {ANALYSIS_OBJ} AS obj, {SNIP} AS snip FROM @documents@ d) d"
)
IDEA_REPLIES = (
    f"SELECT d.source AS page_url, d.doc_id AS seq, {IDEA_REPLY} AS reply FROM "
    f"(SELECT d.source, d.doc_id, d.lang, {I1} AS i1, {I2} AS i2, {I3} AS i3, {I4} AS i4 FROM @documents@ d) d"
)

# Ranking replies per (page, batch): built from the first idea strings of the batch, by shape.
# Inputs: a relation ``b(page_url, batch_id, i1, i2)`` with the first two payload ideas.
RANK_ITEM_1 = (
    "'{\"idea\": \"' || b.i1 || '\", \"priority\": 1, \"score\": ' || CAST(b.batch_id AS STRING) || '.125, "
    "\"rationale\": \"strong pull in ' || b.page_url || '\", \"estimated_revenue_usd\": ' || "
    "CAST(b.batch_id * 1000 + 2500 AS STRING) || ', \"recommended_price_range\": \"$49-$99\", "
    "\"go_to_market_channels\": [\"forums\", \"newsletters\"], \"examples\": [\"first   example\", \"second\"]}'"
)
RANK_ITEM_2 = (
    "'{\"idea\": \"' || b.i2 || '\", \"priority\": 2, \"score\": 3, \"estimated_revenue_usd\": ' || "
    "CAST(b.batch_id * 700 + 900 AS STRING) || ', \"go_to_market_channels\": []}'"
)
# the reply reads the two items from columns ``it1`` / ``it2`` computed once per batch
RANK_REPLY = """
CASE (b.batch_id + length(b.page_url)) % 5
  WHEN 0 THEN '{"ranked": [' || b.it1 || ', ' || b.it2 || ']}'
  WHEN 1 THEN 'Sure! ' || '{"ranked": [' || b.it2 || ', ' || b.it1 || ',]}' || ' Done.'
  WHEN 2 THEN '{"ranked": []}'
  WHEN 3 THEN 'I cannot rank these.'
  ELSE '{"ranked": [' || b.it1 || ']}'
END"""


def sql(template: str, names: dict[str, str]) -> str:
    out = template
    for k, v in names.items():
        out = out.replace(f"@{k}@", v)
    return out

_S1 = "translate(d.text, '\"' || chr(92) || chr(10) || chr(13) || chr(9), '')"
_S2 = "'Reply to: ' || " + _S1

# post-extraction replies (chunk and candidate extractors), shape by doc_id % 6
POSTS_REPLY = """
CASE d.doc_id % 6
  WHEN 0 THEN '{"posts": ["' || d.s1 || '", "' || d.s2 || '", ""]}'
  WHEN 1 THEN 'Here you go: {"posts": ["' || d.s1 || '"]}'
  WHEN 2 THEN '{"items": ["' || d.s1 || '"]}'
  WHEN 3 THEN d.s1 || chr(10) || chr(10) || '  ' || d.s2 || '  '
  WHEN 4 THEN 'null'
  ELSE '{"posts": ["' || d.s1 || '", 42, "  ' || d.s1 || '  "]}'
END"""
POSTS_REPLIES = (
    f"SELECT d.source AS page_url, d.doc_id AS seq, {POSTS_REPLY} AS reply FROM "
    f"(SELECT d.source, d.doc_id, {_S1} AS s1, {_S2} AS s2 FROM @documents@ d) d"
)

# recorded call failures, kind by doc_id % 7
ERRORS = """
SELECT d.doc_id AS seq,
  CASE d.doc_id % 7 WHEN 0 THEN 'Rate limit reached for requests: ' || d.text WHEN 1 THEN 'Request timed out'
    WHEN 2 THEN 'LLM request failed: 400 Bad Request - ' || d.text WHEN 3 THEN NULL WHEN 4 THEN 'socket hang up at ' || d.text
    WHEN 5 THEN d.text || ' TypeError: fetch failed' ELSE 'Empty LLM response to ' || d.text END AS message,
  CASE d.doc_id % 7 WHEN 0 THEN 429 WHEN 2 THEN 400 WHEN 3 THEN 429 ELSE NULL END AS status,
  CASE d.doc_id % 7 WHEN 1 THEN 'ETIMEDOUT' WHEN 4 THEN 'ECONNRESET' ELSE NULL END AS code
FROM @documents@ d"""

_E = "translate(d.text, '\"' || chr(92) || chr(10) || chr(13) || chr(9), '')"
# service reply envelopes (chat and responses forms), shape by doc_id % 7
ENVELOPE = """
CASE d.doc_id % 7
  WHEN 0 THEN '{"choices": [{"message": {"content": "' || d.s || '"}}]}'
  WHEN 1 THEN '{"choices": [{"text": "' || d.s || '"}]}'
  WHEN 2 THEN '{"choices": [{"message": {"content": ""}, "text": "' || d.s || '"}]}'
  WHEN 3 THEN '{"output": [{"content": [{"type": "output_text", "text": "' || d.s || '"}, "tail"]}]}'
  WHEN 4 THEN '{"output": [{"text": " ' || d.s || ' "}, {"content": "x"}], "output_text": "ignored"}'
  WHEN 5 THEN '{"output_text": "  ' || d.s || '"}'
  ELSE '{}'
END"""
ENVELOPES = (
    f"SELECT d.doc_id AS seq, {ENVELOPE} AS envelope FROM "
    f"(SELECT d.doc_id, {_E} AS s FROM @documents@ d) d"
)

# Stored model replies of M1-M5: which requests failed (with an error) or were never answered, by a
# number of the request. Inputs: any relation with ``n``.
FAILED = "{n} % 11 = 5"
MISSING = "{n} % 13 = 7"
