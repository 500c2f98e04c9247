"""DuckDB oracle SQL for the registered queries, written independently of the Spark code.

DuckDB specifics handled here: ``regexp_replace`` needs the ``'g'`` option to replace all matches,
``json_valid`` accepts trailing commas (``JSON.parse`` does not, so they are rejected explicitly),
``list_distinct`` does not keep order (an index-based filter is used instead).
"""

from __future__ import annotations

from ..functions.text import WS
from ..operators.requests import (
    ANALYSIS_PROMPT_HEAD, ANALYSIS_PROMPT_TAIL, CANDIDATE_USER_HEAD, CANDIDATE_USER_TAIL, CHUNK_USER_HEAD, IDEA_USER_HEAD, IDEA_USER_TAIL,
    RANK_USER_HEAD, RANK_USER_TAIL,
)
from . import fixtures as FX
from .common import duck

SEP = "chr(31)"
# Words of generic ideas and the text of the fallback idea.
GENERIC = "guide|checklist|subscription delivering|curated|introductory"
FALLBACK = ("'Concise solution guide: \"' || substring({s}, 1, 120) || '\" — targeted info product to validate demand.'")


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', ' ', 'g')"


def strict_ok(t: str) -> str:
    return f"(coalesce(json_valid({t}), false) AND NOT regexp_matches({t}, ',{WS}*[}}\\]]'))"


def repair(t: str) -> str:
    x = f"regexp_replace({t}, ',{WS}*([}}\\]])', '\\1', 'g')"
    for q in "‘’“”":
        x = f"replace({x}, '{q}', '\"')"
    return x


def greedy_obj(t: str) -> str:
    return f"regexp_extract({t}, '\\{{.*\\}}', 0, 's')"


def greedy_arr(t: str) -> str:
    return f"regexp_extract({t}, '\\[.*\\]', 0, 's')"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ordered_distinct(lst: str) -> str:
    return f"list_filter({lst}, lambda x, i: NOT list_contains({lst}[1:i-1], x))"


def filter_generic(lst: str) -> str:
    kept = ordered_distinct(f"list_filter({lst}, lambda x: NOT regexp_matches(lower(x), '{GENERIC}'))")
    return f"CASE WHEN len({kept}) > 0 THEN {kept}[1:3] ELSE ({lst})[1:3] END"


def items(j: str) -> str:
    """String items of a JSON array (strings and numbers as text), trimmed, non-blank."""
    return f"list_filter(list_transform(json_extract_string({j}, '$[*]'), lambda x: {trim('x')}), lambda x: x <> '')"


# ----------------------------------------------------------------------------------------------
# chain CTEs
# ----------------------------------------------------------------------------------------------
def planned_ctes(posts_sql: str, prefix: str = "") -> str:
    p = prefix
    return f"""
{p}raw_posts AS ({posts_sql}),
{p}tposts AS (SELECT page_url, seq, {trim('post')} AS post FROM {p}raw_posts),
{p}dposts AS (SELECT page_url, post, min(seq) AS seq, count(*) AS n_copies FROM {p}tposts WHERE post <> '' GROUP BY page_url, post),
{p}ranked AS (SELECT *, row_number() OVER (PARTITION BY page_url ORDER BY seq) AS rn,
                 count(*) OVER (PARTITION BY page_url) AS n FROM {p}dposts),
{p}planned AS (SELECT page_url, post, seq, n_copies, rn,
   CASE WHEN n >= 10 THEN (CASE WHEN rn <= 10 THEN 0 ELSE 1 + least((rn - 11) // 3, 2) END)
        ELSE least((rn - 1) // 3, 3) END AS batch_id FROM {p}ranked)"""


INSIGHT_CTES = f"""
ar AS (SELECT page_url, seq, reply AS t, {greedy_obj('reply')} AS g FROM ({duck(FX.ANALYSIS_REPLIES)})),
ap AS (SELECT page_url, seq, t,
   CASE WHEN {strict_ok('t')} THEN 'parsed' WHEN {strict_ok('g')} THEN 'salvaged' ELSE 'raw' END AS status,
   CASE WHEN {strict_ok('t')} THEN t WHEN {strict_ok('g')} THEN g END AS j FROM ar),
ins AS (SELECT page_url, seq, status, j,
   (status = 'raw' OR json_type(j) <> 'NULL') AS ok,
   CASE WHEN status = 'raw' THEN t ELSE coalesce(json_extract_string(j, '$.summary'), '') END AS summary_text,
   lower(coalesce(json_extract_string(j, '$.sentiment'), '')) AS sentiment,
   CASE WHEN json_type(j, '$.topics') = 'ARRAY' THEN json_extract_string(j, '$.topics[*]') ELSE []::VARCHAR[] END AS topics,
   TRY_CAST(json_extract(j, '$.toxicityScore') AS DOUBLE) AS toxicity
 FROM ap),
ins2 AS (SELECT *, CASE WHEN summary_text <> '' THEN substring(summary_text, 1, 200) END AS reason FROM ins)"""

_ARR_W = greedy_arr("reply")
IDEA_CTES = f"""
ir AS (SELECT page_url, seq, reply AS r, {_ARR_W} AS w FROM ({duck(FX.IDEA_REPLIES)})),
ip AS (SELECT *, CASE WHEN w = '' THEN NULL WHEN {strict_ok('w')} THEN w WHEN {strict_ok(repair('w'))} THEN {repair('w')} END AS aj FROM ir),
ip2 AS (SELECT *, CASE WHEN aj IS NOT NULL AND json_type(aj) = 'ARRAY' THEN ({items('aj')})[1:3] END AS parsed,
   list_filter(list_transform(string_split_regex(r, '\\r?\\n'), lambda x: {trim('x')}), lambda x: length(x) > 30) AS lines
 FROM ip)"""


def ideas_expr(summary: str) -> str:
    s = trim(collapse(f"coalesce({summary}, '')"))
    fb = f"CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE [{FALLBACK.format(s=s)}] END"
    return f"""CASE WHEN r IS NULL OR r = '' THEN {fb}
      WHEN coalesce(len(parsed), 0) > 0 THEN {filter_generic('parsed')}
      WHEN len(lines) > 0 THEN ({filter_generic('lines')})[1:3]
      ELSE {fb} END"""


CHAIN = f"""WITH {planned_ctes(duck(FX.POSTS))},
{INSIGHT_CTES},
{IDEA_CTES},
pi AS (SELECT p.page_url, p.batch_id, p.seq, p.post, i.sentiment, i.topics, i.reason, i.summary_text,
          {ideas_expr('i.summary_text')} AS ideas
       FROM planned p JOIN ins2 i ON p.page_url = i.page_url AND p.seq = i.seq
       JOIN ip2 ON ip2.page_url = p.page_url AND ip2.seq = p.seq
       WHERE i.ok),
ev AS (SELECT page_url, batch_id, seq, unnest(ideas[1:3]) AS idea, generate_subscripts(ideas[1:3], 1) - 1 AS idea_pos,
          substring({trim('post')}, 1, 300) AS example,
          CASE WHEN contains(sentiment, 'pos') THEN 1 WHEN contains(sentiment, 'neg') THEN -1 ELSE 0 END AS s_score,
          topics[1:5] AS topics, reason
       FROM pi),
base AS (SELECT page_url, batch_id, idea, min(seq * 10 + idea_pos) AS fk, count(*) AS cnt, CAST(sum(s_score) AS BIGINT) AS sentiment_sum
         FROM ev GROUP BY ALL),
exr AS (SELECT *, row_number() OVER (PARTITION BY page_url, batch_id, idea ORDER BY seq, idea_pos) AS rk FROM ev),
exa AS (SELECT page_url, batch_id, idea, string_agg(example, {SEP} ORDER BY seq, idea_pos) AS examples FROM exr WHERE rk <= 3 GROUP BY ALL),
tev AS (SELECT page_url, batch_id, idea, seq, idea_pos, unnest(topics) AS topic, generate_subscripts(topics, 1) AS tp FROM ev),
tfirst AS (SELECT page_url, batch_id, idea, topic, min(seq * 1000 + idea_pos * 10 + tp) AS o FROM tev GROUP BY ALL),
tr AS (SELECT *, row_number() OVER (PARTITION BY page_url, batch_id, idea ORDER BY o) AS rk,
              count(*) OVER (PARTITION BY page_url, batch_id, idea) AS n FROM tfirst),
ta AS (SELECT page_url, batch_id, idea, max(n) AS n_topics, string_agg(topic, {SEP} ORDER BY o) AS topics FROM tr GROUP BY ALL),
rfirst AS (SELECT page_url, batch_id, idea, reason, min(seq * 10 + idea_pos) AS o FROM ev WHERE reason IS NOT NULL GROUP BY ALL),
rr AS (SELECT *, row_number() OVER (PARTITION BY page_url, batch_id, idea ORDER BY o) AS rk,
              count(*) OVER (PARTITION BY page_url, batch_id, idea) AS n FROM rfirst),
ra AS (SELECT page_url, batch_id, idea, max(n) AS n_reasons, string_agg(reason, {SEP} ORDER BY o) AS reasons FROM rr GROUP BY ALL),
store AS (SELECT b.page_url, b.batch_id, b.idea, b.fk // 10 AS first_seq, b.fk % 10 AS first_pos, b.cnt, b.sentiment_sum,
            coalesce(exa.examples, '') AS examples, coalesce(ta.n_topics, 0) AS n_topics, coalesce(ta.topics, '') AS topics,
            coalesce(ra.n_reasons, 0) AS n_reasons, coalesce(ra.reasons, '') AS reasons
          FROM base b
          LEFT JOIN exa USING (page_url, batch_id, idea)
          LEFT JOIN ta USING (page_url, batch_id, idea)
          LEFT JOIN ra USING (page_url, batch_id, idea)),
payload AS (SELECT *, row_number() OVER (PARTITION BY page_url, batch_id ORDER BY first_seq, first_pos) AS payload_pos FROM store)"""

RANK_CTES = f"""
b AS (SELECT page_url, batch_id, max(CASE WHEN payload_pos = 1 THEN idea END) AS i1,
         coalesce(max(CASE WHEN payload_pos = 2 THEN idea END), max(CASE WHEN payload_pos = 1 THEN idea END)) AS i2
      FROM payload WHERE payload_pos <= 2 GROUP BY page_url, batch_id),
b2 AS (SELECT b.*, {FX.RANK_ITEM_1} AS it1, {FX.RANK_ITEM_2} AS it2 FROM b),
rep AS (SELECT b.page_url, b.batch_id, {FX.RANK_REPLY} AS reply FROM b2 b),
rw AS (SELECT page_url, batch_id, reply, {greedy_obj('reply')} AS w FROM rep),
rp AS (SELECT page_url, batch_id, CASE WHEN w = '' THEN NULL WHEN {strict_ok('w')} THEN w WHEN {strict_ok(repair('w'))} THEN {repair('w')} END AS j FROM rw),
rx AS (SELECT page_url, batch_id, j,
          CASE WHEN json_type(j, '$.ranked') = 'ARRAY' THEN json_extract(j, '$.ranked[*]') END AS arr FROM rp),
rrows AS (SELECT page_url, batch_id, unnest(arr) AS item, generate_subscripts(arr, 1) AS pos FROM rx WHERE arr IS NOT NULL)"""


def _bigint(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


Q = {}

Q["idea_store"] = CHAIN + """
SELECT page_url, CAST(batch_id AS BIGINT) AS batch_id, idea, CAST(first_seq AS BIGINT) AS first_seq, CAST(first_pos AS BIGINT) AS first_pos,
       cnt, sentiment_sum, examples, CAST(n_topics AS BIGINT) AS n_topics, topics, CAST(n_reasons AS BIGINT) AS n_reasons, reasons
FROM store"""

Q["batch_plan"] = f"""WITH {planned_ctes(duck(FX.POSTS), 'd_')},
{planned_ctes("SELECT 'conv' || CAST(conv_id AS VARCHAR) AS page_url, turn AS seq, text AS post FROM conversations WHERE role = 'user'", 'c_')}
SELECT 'documents' AS src, page_url, seq, CAST(batch_id AS BIGINT) AS batch_id FROM d_planned
UNION ALL
SELECT 'conversations' AS src, page_url, seq, CAST(batch_id AS BIGINT) AS batch_id FROM c_planned"""

_LINES = "SELECT source AS page_url, doc_id, unnest(string_split(text, chr(10))) AS post, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents"

Q["post_distinct"] = f"""WITH l AS ({_LINES}),
t AS (SELECT page_url, doc_id, line_no, {trim('post')} AS post FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY page_url, post ORDER BY doc_id, line_no) AS rk,
             count(*) OVER (PARTITION BY page_url, post) AS n_copies FROM t WHERE post <> '')
SELECT page_url, post, doc_id, CAST(line_no AS BIGINT) AS line_no, n_copies FROM r WHERE rk = 1"""

Q["new_posts"] = f"""WITH l AS ({_LINES}),
t AS (SELECT page_url, doc_id, {trim('post')} AS post FROM l),
t2 AS (SELECT * FROM t WHERE post <> ''),
first AS (SELECT DISTINCT page_url, post FROM t2 WHERE doc_id % 2 = 0),
second AS (SELECT * FROM t2 WHERE doc_id % 2 = 1),
n AS (SELECT s.* FROM second s ANTI JOIN first f ON s.page_url = f.page_url AND s.post = f.post)
SELECT page_url, count(*) AS n_new_rows, count(DISTINCT post) AS n_new_distinct FROM n GROUP BY page_url"""

Q["round_counts"] = f"""WITH l AS ({_LINES}),
t AS (SELECT page_url, doc_id % 3 AS round, post FROM l),
first AS (SELECT page_url, post, min(round) AS round FROM t WHERE {trim('post')} <> '' GROUP BY page_url, post),
nr AS (SELECT page_url, round, count(*) AS new_found FROM first GROUP BY ALL),
rounds AS (SELECT DISTINCT page_url, round FROM t),
j AS (SELECT r.page_url, r.round, coalesce(nr.new_found, 0) AS new_found FROM rounds r LEFT JOIN nr USING (page_url, round))
SELECT page_url, CAST(round AS BIGINT) AS round, CAST(new_found AS BIGINT) AS new_found,
       CAST(sum(new_found) OVER (PARTITION BY page_url ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS collected
FROM j"""


def _chunks(mx: int, ov: int) -> str:
    step = mx - ov
    return f"""SELECT '{mx}/{ov}' AS cfg, doc_id, unnest(starts) AS start, generate_subscripts(starts, 1) - 1 AS chunk_no, t
FROM (SELECT doc_id, coalesce(text, '') AS t,
        CASE WHEN length(coalesce(text, '')) <= {mx} THEN [0]
             ELSE range(0, CAST(ceil((length(text) - {mx}) / {step}) AS BIGINT) * {step} + 1, {step}) END AS starts
      FROM documents)"""


Q["chunk_text"] = f"""WITH c AS ({_chunks(12000, 300)} UNION ALL {_chunks(1000, 100)})
SELECT cfg, doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(start AS BIGINT) AS start,
       CAST(length(substring(t, start + 1, CAST(split_part(cfg, '/', 1) AS BIGINT))) AS BIGINT) AS chunk_len,
       md5(substring(t, start + 1, CAST(split_part(cfg, '/', 1) AS BIGINT))) AS chunk_md5
FROM c"""

Q["pack_batches"] = """WITH RECURSIVE c AS (
  SELECT source AS page_url, doc_id AS pos, length(text) AS len,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rk FROM documents),
walk AS (
  SELECT page_url, pos, len, rk, 0 AS b, len AS sz FROM c WHERE rk = 1
  UNION ALL
  SELECT n.page_url, n.pos, n.len, n.rk,
         CASE WHEN w.sz + n.len > 10000 THEN w.b + 1 ELSE w.b END,
         CASE WHEN w.sz + n.len > 10000 THEN n.len ELSE w.sz + n.len END
  FROM walk w JOIN c n ON n.page_url = w.page_url AND n.rk = w.rk + 1)
SELECT page_url, pos, CAST(b AS BIGINT) AS cand_batch,
       CAST(row_number() OVER (PARTITION BY page_url, b ORDER BY pos) AS BIGINT) AS batch_pos
FROM walk"""

Q["preview"] = f"""SELECT doc_id, CAST(length({trim('text')}) AS BIGINT) AS trim_len, md5({collapse('text')}) AS collapsed_md5,
  substring({trim(collapse("coalesce(text, '')"))}, 1, 140) || CASE WHEN length(coalesce(text, '')) > 140 THEN '...' ELSE '' END AS preview,
  substring({collapse("coalesce(text, '')")}, 1, 240) || CASE WHEN length(coalesce(text, '')) > 240 THEN '...' ELSE '' END AS example
FROM documents"""

_ESC = "replace(replace(t, chr(92), chr(92) || chr(92)), '\"\"\"', chr(92) || '\"\"\"')"
Q["seed_urls"] = f"""WITH l AS (
  SELECT CAST(floor(page_id / 10) AS BIGINT) AS line_id, string_agg(url, ' , ' ORDER BY page_id) || ', ,not a url' AS line
  FROM pages GROUP BY 1),
s AS (SELECT line_id, unnest(string_split(line, ',')) AS raw, generate_subscripts(string_split(line, ','), 1) - 1 AS ord FROM l),
u AS (SELECT line_id, CAST(ord AS BIGINT) AS ord, {trim('raw')} AS url FROM s),
p AS (SELECT *, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#:]+)(:([0-9]+))?', ['scheme', 'host', 'c', 'port']) AS m FROM u)
SELECT line_id, ord, url,
  CASE WHEN m.host <> '' THEN lower(m.scheme) || '://' || lower(m.host) ||
     CASE WHEN m.port = '' OR (lower(m.scheme) = 'http' AND m.port = '80') OR (lower(m.scheme) = 'https' AND m.port = '443') THEN '' ELSE ':' || m.port END
  END AS origin
FROM p"""

Q["url_gate"] = """WITH p AS (SELECT page_id, url AS page_url FROM pages),
v AS (SELECT page_id + 1000000 AS page_id,
        page_url || (['/login', '?app=1', '/Login', '/consent'])[page_id % 4 + 1] AS page_url
      FROM p),
a AS (SELECT * FROM p UNION ALL SELECT * FROM v)
SELECT page_id, page_url, regexp_matches(page_url, 'login|signup|consent|native_app|app=') AS blocked FROM a"""

Q["candidate_gate"] = f"""WITH l AS ({_LINES}),
t AS (SELECT doc_id, line_no, {trim('post')} AS p FROM l)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(length(p) AS BIGINT) AS n_chars,
       CAST(len(string_split_regex(p, '{WS}+')) AS BIGINT) AS n_words
FROM t WHERE p <> '' AND length(p) > 40 AND len(string_split_regex(p, '{WS}+')) > 5"""

Q["parse_insight"] = f"""WITH {INSIGHT_CTES}
SELECT seq, status, ok, summary_text, sentiment, array_to_string(topics, {SEP}) AS topics, toxicity FROM ins2"""

_POSTS_W = f"CASE WHEN {greedy_obj('reply')} <> '' THEN {greedy_obj('reply')} ELSE reply END"
_LINES_OF = f"list_filter(list_transform(string_split(reply, chr(10)), lambda x: {trim('x')}), lambda x: x <> '')"
_POSTS_BASE = f"""WITH r AS (SELECT seq, reply, {_POSTS_W} AS w FROM ({duck(FX.POSTS_REPLIES)})),
p AS (SELECT seq, reply, CASE WHEN {strict_ok('w')} THEN w END AS j FROM r),
x AS (SELECT seq, reply, j, json_type(j, '$.posts') = 'ARRAY' AS has_posts,
        CASE WHEN json_type(j, '$.posts') = 'ARRAY' THEN {items("json_extract(j, '$.posts')")} END AS posts FROM p)"""

Q["parse_posts_chunk"] = _POSTS_BASE + f""",
o AS (SELECT seq, CASE WHEN j IS NOT NULL AND coalesce(has_posts, false) THEN posts ELSE {_LINES_OF} END AS arr FROM x)
SELECT seq, CAST(generate_subscripts(arr, 1) - 1 AS BIGINT) AS pos, unnest(arr) AS post FROM o"""

Q["parse_posts_cand"] = _POSTS_BASE + f""",
o AS (SELECT seq, CASE WHEN j IS NULL OR json_type(j) = 'NULL' THEN {_LINES_OF}
                      WHEN coalesce(has_posts, false) THEN posts ELSE []::VARCHAR[] END AS arr FROM x)
SELECT seq, CAST(generate_subscripts(arr, 1) - 1 AS BIGINT) AS pos, unnest(arr) AS post FROM o"""

Q["parse_array"] = f"""WITH {IDEA_CTES}
SELECT seq, parsed IS NOT NULL AS is_array, CAST(CASE WHEN parsed IS NULL THEN -1 ELSE len(parsed) END AS BIGINT) AS n,
       array_to_string(parsed, {SEP}) AS items FROM ip2"""

Q["parse_object"] = CHAIN + "," + RANK_CTES + """
SELECT page_url, CAST(batch_id AS BIGINT) AS batch_id, j IS NOT NULL AS parsed,
       CAST(CASE WHEN json_type(j, '$.ranked') = 'ARRAY' THEN json_array_length(j, '$.ranked') ELSE -1 END AS BIGINT) AS n_ranked,
       json_extract_string(j, '$.ranked[0].idea') AS first_idea
FROM rp"""

Q["idea_cascade"] = CHAIN + f"""
SELECT seq, CAST(len(ideas) AS BIGINT) AS n_ideas, array_to_string(ideas, {SEP}) AS ideas FROM pi"""

Q["idea_input"] = f"""WITH {INSIGHT_CTES},
posts AS ({duck(FX.POSTS)})
SELECT i.seq, substring({trim(collapse('i.summary_text'))}, 1, 800) AS summary, i.sentiment,
       array_to_string(i.topics[1:5], {SEP}) AS topics, CAST(length(substring(coalesce(p.post, ''), 1, 800)) AS BIGINT) AS post_len
FROM ins2 i JOIN posts p ON p.page_url = i.page_url AND p.seq = i.seq WHERE i.ok"""

Q["idea_fields"] = CHAIN + f""",
d AS (SELECT DISTINCT idea FROM ev),
s AS (SELECT idea, string_split_regex(idea, '\\s*\\|\\s*') AS parts FROM d),
h AS (SELECT idea, parts, parts[1] AS head, strpos(parts[1], ' — ') AS k FROM s)
SELECT idea,
  {trim("CASE WHEN k > 0 THEN substring(head, 1, k - 1) ELSE head END")} AS title,
  CASE WHEN k > 0 THEN {trim("substring(head, k + 3)")} END AS pitch,
  parts[2] AS why, parts[3] AS price,
  TRY_CAST(NULLIF(replace(regexp_extract(coalesce(parts[3], ''), '\\$\\s*([0-9][0-9,]*(\\.[0-9]+)?)', 1), ',', ''), '') AS DOUBLE) AS price_usd
FROM h"""

_LIST = "CASE WHEN {c} = '' THEN []::VARCHAR[] ELSE string_split({c}, chr(31)) END"
Q["rank_payload"] = CHAIN + f""",
pj AS (SELECT *, (payload_pos - 1) // 30 AS payload_no,
         to_json({{'idea': idea, 'count': cnt, 'sentimentSum': sentiment_sum, 'topics': {_LIST.format(c='topics')},
                  'examples': {_LIST.format(c='examples')}, 'reasons': {_LIST.format(c='reasons')}}})::VARCHAR AS body FROM payload)
SELECT page_url, CAST(batch_id AS BIGINT) AS batch_id, CAST(payload_no AS BIGINT) AS payload_no, count(*) AS n_ideas,
       CAST(sum(cnt) AS BIGINT) AS total_count, '{{"ideas":[' || string_agg(body, ',' ORDER BY payload_pos) || ']}}' AS payload
FROM pj GROUP BY page_url, batch_id, payload_no"""

Q["ranked_rows"] = CHAIN + "," + RANK_CTES + f"""
SELECT r.page_url, CAST(r.batch_id AS BIGINT) AS batch_id, CAST(r.pos AS BIGINT) AS pos, json_extract_string(r.item, '$.idea') AS idea,
  CAST(TRY_CAST(json_extract(r.item, '$.priority') AS BIGINT) AS VARCHAR) AS priority, TRY_CAST(json_extract(r.item, '$.score') AS DOUBLE) AS score,
  TRY_CAST(json_extract(r.item, '$.estimated_revenue_usd') AS DOUBLE) AS estimated_revenue_usd,
  json_extract_string(r.item, '$.recommended_price_range') AS recommended_price_range,
  array_to_string(CASE WHEN json_type(r.item, '$.go_to_market_channels') = 'ARRAY' THEN json_extract_string(r.item, '$.go_to_market_channels[*]') ELSE []::VARCHAR[] END, {SEP}) AS channels,
  CAST(CASE WHEN json_type(r.item, '$.examples') = 'ARRAY' THEN json_array_length(r.item, '$.examples') ELSE 0 END AS BIGINT) AS n_examples,
  CAST(s.cnt AS VARCHAR) AS cnt, CAST(s.sentiment_sum AS VARCHAR) AS sentiment_sum
FROM rrows r LEFT JOIN store s ON s.page_url = r.page_url AND s.batch_id = r.batch_id AND s.idea = json_extract_string(r.item, '$.idea')"""

Q["rank_fallback"] = CHAIN + "," + RANK_CTES + """,
good AS (SELECT page_url, batch_id FROM rx WHERE arr IS NOT NULL AND len(arr) > 0),
fb AS (SELECT p.page_url, p.batch_id, p.payload_pos AS pos, p.idea FROM payload p
       WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.page_url = p.page_url AND g.batch_id = p.batch_id)),
bc AS (SELECT page_url, batch_id, count(*) AS n_posts FROM planned GROUP BY ALL),
ic AS (SELECT page_url, batch_id, count(*) AS n_ideas FROM store GROUP BY ALL),
counts AS (SELECT bc.page_url, bc.batch_id, bc.n_posts, coalesce(ic.n_ideas, 0) AS n_ideas FROM bc LEFT JOIN ic USING (page_url, batch_id))
SELECT c.page_url, CAST(c.batch_id AS BIGINT) AS batch_id, c.n_posts, CAST(c.n_ideas AS BIGINT) AS n_ideas,
       CAST(fb.pos AS VARCHAR) AS pos, fb.idea
FROM counts c LEFT JOIN fb ON fb.page_url = c.page_url AND fb.batch_id = c.batch_id"""

Q["rank_native"] = CHAIN + """,
f AS (SELECT * FROM payload)
SELECT page_url, CAST(batch_id AS BIGINT) AS batch_id,
  CAST(row_number() OVER (PARTITION BY page_url, batch_id ORDER BY cnt DESC, sentiment_sum DESC, n_topics DESC, first_seq, first_pos) AS BIGINT) AS rank,
  idea, cnt, sentiment_sum, CAST(n_topics AS BIGINT) AS n_topics
FROM f"""

Q["revenue_topk"] = CHAIN + "," + RANK_CTES + """,
t AS (SELECT page_url, batch_id, pos, json_extract_string(item, '$.idea') AS idea,
        TRY_CAST(json_extract(item, '$.estimated_revenue_usd') AS DOUBLE) AS estimated_revenue_usd FROM rrows),
k AS (SELECT *, row_number() OVER (PARTITION BY page_url, batch_id ORDER BY estimated_revenue_usd DESC NULLS LAST, pos) AS rk FROM t)
SELECT page_url, CAST(batch_id AS BIGINT) AS batch_id, idea, estimated_revenue_usd FROM k WHERE rk <= 1"""

Q["leaderboard_rollup"] = CHAIN + """,
lb AS (SELECT 'idea' AS kind, idea AS key, page_url, CAST(batch_id AS VARCHAR) AS batch_id,
         CAST(grouping(idea, page_url, batch_id) AS BIGINT) AS level, CAST(sum(cnt) AS BIGINT) AS cnt,
         CAST(sum(sentiment_sum) AS BIGINT) AS sentiment_sum
       FROM store GROUP BY ROLLUP (idea, page_url, batch_id)),
te AS (SELECT page_url, unnest(topics) AS topic, s_score FROM ev),
tp AS (SELECT 'topic' AS kind, topic AS key, page_url, CAST(NULL AS VARCHAR) AS batch_id,
         CAST(grouping(topic, page_url) AS BIGINT) AS level, count(*) AS cnt, CAST(sum(s_score) AS BIGINT) AS sentiment_sum
       FROM te GROUP BY ROLLUP (topic, page_url))
SELECT * FROM lb WHERE key IS NOT NULL AND level < 4
UNION ALL SELECT * FROM tp WHERE key IS NOT NULL"""

_FIX2 = "CASE WHEN {v} IS NULL THEN 'NaN' ELSE printf('%.2f', round(CAST({v} AS DECIMAL(38,10)), 2)) END"
_NUMTXT = "CASE WHEN {v} IS NULL THEN 'NaN' WHEN {v} = floor({v}) AND abs({v}) < 1e15 THEN CAST(CAST({v} AS BIGINT) AS VARCHAR) ELSE CAST({v} AS VARCHAR) END"
_EXL = f"'  ' || CAST(i AS VARCHAR) || '. ' || substring({collapse('x')}, 1, 240) || CASE WHEN length(x) > 240 THEN '...' ELSE '' END"
Q["report_lines"] = CHAIN + "," + RANK_CTES + f""",
f AS (SELECT page_url, batch_id, pos, item,
        TRY_CAST(json_extract(item, '$.score') AS DOUBLE) AS sc,
        TRY_CAST(json_extract(item, '$.estimated_revenue_usd') AS DOUBLE) AS rev,
        CASE WHEN json_type(item, '$.go_to_market_channels') = 'ARRAY' THEN json_extract_string(item, '$.go_to_market_channels[*]') END AS ch,
        CASE WHEN json_type(item, '$.examples') = 'ARRAY' THEN json_extract_string(item, '$.examples[*]') END AS ex
      FROM rrows)
SELECT page_url, CAST(batch_id AS BIGINT) AS batch_id, CAST(pos AS BIGINT) AS pos,
  concat_ws(chr(10), '',
    CAST(pos AS VARCHAR) || '. ' || coalesce(json_extract_string(item, '$.idea'), 'undefined'),
    CASE WHEN json_extract(item, '$.priority') IS NOT NULL THEN 'Priority: ' || json_extract_string(item, '$.priority') END,
    CASE WHEN json_extract(item, '$.score') IS NOT NULL THEN 'Score: ' || {_FIX2.format(v='sc')} END,
    CASE WHEN json_extract(item, '$.estimated_revenue_usd') IS NOT NULL THEN 'Estimated revenue (USD): $' || {_NUMTXT.format(v='rev')} END,
    CASE WHEN coalesce(json_extract_string(item, '$.recommended_price_range'), '') <> '' THEN 'Recommended price range: ' || json_extract_string(item, '$.recommended_price_range') END,
    CASE WHEN len(ch) > 0 THEN 'Go-to-market channels: ' || array_to_string(ch, ', ') END,
    CASE WHEN coalesce(json_extract_string(item, '$.rationale'), '') <> '' THEN 'Rationale: ' || json_extract_string(item, '$.rationale') END,
    CASE WHEN len(ex) > 0 THEN 'Examples:' || chr(10) || array_to_string(list_transform(ex[1:3], lambda x, i: {_EXL}), chr(10)) END,
    '---') AS block
FROM f"""

Q["parse_quality"] = f"""WITH {INSIGHT_CTES}
SELECT page_url, count(*) AS n, count(*) FILTER (WHERE status = 'parsed') AS n_parsed,
  count(*) FILTER (WHERE status = 'salvaged') AS n_salvaged, count(*) FILTER (WHERE status = 'raw') AS n_raw,
  count(*) FILTER (WHERE coalesce(summary_text, '') = '') AS n_empty_summary
FROM ins2 GROUP BY page_url"""

Q["retryable_errors"] = f"""WITH e AS ({duck(FX.ERRORS)})
SELECT seq, message, CAST(status AS VARCHAR) AS status, code,
  (regexp_matches(lower(coalesce(message, '')), 'rate limit|429|too many requests|timeout|timed out|etimedout|econnreset|ecancelled|fetch failed')
   OR coalesce(status = 429, false) OR coalesce(code IN ('ETIMEDOUT', 'ECONNRESET'), false)) AS retryable
FROM e"""


def oracle_sql() -> dict[str, str]:
    return dict(Q)

def _failed(n: str) -> str:
    return FX.FAILED.format(n=n)


def _missing(n: str) -> str:
    return FX.MISSING.format(n=n)


Q["analyze_replies"] = f"""WITH {INSIGHT_CTES}
SELECT seq, status, CASE WHEN status = 'raw' THEN {trim('summary_text')} ELSE summary_text END AS summary_text, sentiment,
       CAST(len(topics) AS BIGINT) AS n_topics
FROM ins2 WHERE NOT ({_failed('seq')}) AND NOT ({_missing('seq')})"""

Q["dead_letters"] = f"""WITH p AS ({duck(FX.POSTS)})
SELECT seq, CASE WHEN {_missing('seq')} THEN 'missing' ELSE 'failed' END AS status,
       CASE WHEN NOT ({_missing('seq')}) THEN 'Request timed out' END AS error,
       CASE WHEN NOT ({_missing('seq')}) THEN 'ETIMEDOUT' END AS error_code
FROM p WHERE post IS NOT NULL AND post <> '' AND (({_failed('seq')}) OR ({_missing('seq')}))"""

_SOME_IDEAS = IDEA_CTES.replace(f"FROM ({duck(FX.IDEA_REPLIES)})",
    f"FROM (SELECT page_url, seq, CASE WHEN ({_failed('seq')}) OR ({_missing('seq')}) THEN NULL ELSE reply END AS reply FROM ({duck(FX.IDEA_REPLIES)}))")
Q["ideate_replies"] = f"""WITH {INSIGHT_CTES},
{_SOME_IDEAS},
x AS (SELECT i.seq, {ideas_expr('i.summary_text')} AS ideas FROM ins2 i JOIN ip2 ON ip2.page_url = i.page_url AND ip2.seq = i.seq WHERE i.ok)
SELECT seq, CAST(len(ideas) AS BIGINT) AS n_ideas, array_to_string(ideas, {SEP}) AS ideas FROM x"""

_RANK_MANY = (RANK_CTES.replace("""b AS (SELECT page_url, batch_id, max(CASE WHEN payload_pos = 1 THEN idea END) AS i1,
         coalesce(max(CASE WHEN payload_pos = 2 THEN idea END), max(CASE WHEN payload_pos = 1 THEN idea END)) AS i2
      FROM payload WHERE payload_pos <= 2 GROUP BY page_url, batch_id)""", """b AS (SELECT page_url, batch_id, (payload_pos - 1) // 30 AS payload_no, max(CASE WHEN (payload_pos - 1) % 30 = 0 THEN idea END) AS i1,
         coalesce(max(CASE WHEN (payload_pos - 1) % 30 = 1 THEN idea END), max(CASE WHEN (payload_pos - 1) % 30 = 0 THEN idea END)) AS i2
      FROM payload GROUP BY ALL)""")
    .replace("rep AS (SELECT b.page_url, b.batch_id,", "rep AS (SELECT b.page_url, b.batch_id, b.payload_no,")
    .replace("SELECT page_url, batch_id, reply, {", "SELECT page_url, batch_id, payload_no, reply, {"))
for _c in ("rw AS (SELECT page_url, batch_id,", "rp AS (SELECT page_url, batch_id,", "rx AS (SELECT page_url, batch_id,", "rrows AS (SELECT page_url, batch_id,"):
    _RANK_MANY = _RANK_MANY.replace(_c, _c + " payload_no,")
_RN = "(batch_id + payload_no + length(page_url))"
_RANK_MANY = _RANK_MANY.replace("rw AS (SELECT page_url, batch_id, payload_no, reply,",
    f"rw AS (SELECT page_url, batch_id, payload_no, CASE WHEN ({_failed(_RN)}) OR ({_missing(_RN)}) THEN NULL ELSE reply END AS reply,")
_RANK_MANY = _RANK_MANY.replace("FROM rep),", f"FROM rep WHERE NOT ({_failed(_RN)}) AND NOT ({_missing(_RN)})),")
Q["rank_replies"] = CHAIN + "," + _RANK_MANY + """,
good AS (SELECT DISTINCT page_url, batch_id, payload_no FROM rx WHERE arr IS NOT NULL AND len(arr) > 0)
SELECT page_url, CAST(batch_id AS BIGINT) AS batch_id, CAST(pos AS BIGINT) AS pos, json_extract_string(item, '$.idea') AS idea, 'model' AS rank_source FROM rrows
UNION ALL
SELECT p.page_url, CAST(p.batch_id AS BIGINT), CAST(p.payload_pos AS BIGINT), p.idea, 'fallback' FROM payload p
ANTI JOIN good g ON g.page_url = p.page_url AND g.batch_id = p.batch_id AND g.payload_no = (p.payload_pos - 1) // 30"""

Q["extract_cand_replies"] = Q["pack_batches"].rsplit("SELECT page_url, pos,", 1)[0] + f""",
k AS (SELECT w.page_url, {trim('d.text')} AS post FROM walk w JOIN documents d ON d.doc_id = w.pos
      WHERE NOT ({_failed('w.b')}) AND NOT ({_missing('w.b')}))
SELECT DISTINCT page_url, CAST(length(post) AS BIGINT) AS n_chars, md5(post) AS post_md5 FROM k WHERE post <> ''"""

Q["extract_text_replies"] = f"""WITH c AS (SELECT 'doc' || CAST(doc_id AS VARCHAR) AS page_url, chunk_no, substring(t, start + 1, 12000) AS chunk FROM ({_chunks(12000, 300)}) WHERE {trim('t')} <> ''),
l AS (SELECT page_url, chunk_no, list_filter(list_transform(string_split(chunk, chr(10)), lambda x: {trim('x')}), lambda x: x <> '') AS lines FROM c
      WHERE NOT ({_failed('(chunk_no + length(page_url))')}) AND NOT ({_missing('(chunk_no + length(page_url))')})),
p AS (SELECT page_url, chunk_no, generate_subscripts(lines, 1) - 1 AS line, unnest(lines) AS post FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY page_url, post ORDER BY chunk_no, line) AS rk FROM p)
SELECT page_url, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(line AS BIGINT) AS line, md5(post) AS post_md5 FROM r WHERE rk = 1"""

_LEX = ("(VALUES ('awful', -1), ('bad', -1), ('best', 1), ('bien', 1), ('bon', 1), ('broken', -1), ('bueno', 1), ('excellent', 1), "
        "('feliz', 1), ('good', 1), ('great', 1), ('gut', 1), ('happy', 1), ('hate', -1), ('helpful', 1), ('love', 1), ('malo', -1), "
        "('mauvais', -1), ('problem', -1), ('schlecht', -1), ('schön', 1), ('terrible', -1), ('triste', -1), ('worst', -1)) AS lex(word, polarity)")
_TOK = "SELECT doc_id, unnest(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}]+')) AS token FROM documents"

Q["sentiment_lexicon"] = f"""WITH t AS ({_TOK}),
h AS (SELECT doc_id, CAST(sum(polarity) AS BIGINT) AS score, count(*) AS n_hits FROM t JOIN {_LEX} ON t.token = lex.word GROUP BY doc_id)
SELECT d.doc_id, coalesce(h.score, 0) AS score, CAST(coalesce(h.n_hits, 0) AS BIGINT) AS n_hits,
  CASE WHEN coalesce(h.score, 0) > 0 THEN 'positive' WHEN coalesce(h.score, 0) < 0 THEN 'negative' ELSE 'neutral' END AS sentiment
FROM documents d LEFT JOIN h USING (doc_id)"""

Q["topics_tfidf"] = f"""WITH t AS ({_TOK}),
t4 AS (SELECT * FROM t WHERE token <> ''),
tf AS (SELECT doc_id, token, count(*) AS tf FROM t4 GROUP BY ALL),
n AS (SELECT count(DISTINCT doc_id) AS n_docs FROM documents),
dfq AS (SELECT token, count(*) AS dfreq FROM tf GROUP BY token),
s AS (SELECT tf.doc_id, tf.token, round(tf.tf * ln(n.n_docs / dfq.dfreq), 9) AS score FROM tf JOIN dfq USING (token), n),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, token) AS rk FROM s),
a AS (SELECT doc_id, string_agg(token, {SEP} ORDER BY rk) AS topics FROM r WHERE rk <= 5 GROUP BY doc_id)
SELECT d.doc_id, coalesce(a.topics, '') AS topics FROM documents d LEFT JOIN a USING (doc_id)"""

_C = trim(collapse("coalesce(text, '')"))
Q["summary_lead"] = f"""WITH c AS (SELECT doc_id, {_C} AS c FROM documents),
l AS (SELECT doc_id, c, regexp_extract(c, '^(.+?[.!?])(\\s|$)', 1) AS lead FROM c)
SELECT doc_id, substring(CASE WHEN lead <> '' THEN lead ELSE c END, 1, 200) AS summary FROM l"""

Q["stream_distinct"] = f"""WITH p AS ({duck(FX.POSTS)}),
t AS (SELECT page_url, {trim('post')} AS post FROM p)
SELECT DISTINCT page_url, post FROM t WHERE post <> ''"""

# release of pages that are read one to three times: sizes of each round's release in closed form
def stream_ctes(prefix: str = "") -> str:
    return planned_ctes(duck(FX.POSTS), "d_") + """,
sp AS (SELECT page_url, seq, post, ascii(right(page_url, 1)) % 3 + 1 AS n_rounds,
         least(seq % 3, ascii(right(page_url, 1)) % 3) AS arrives FROM d_planned),
sn AS (SELECT page_url, max(n_rounds) AS nr, count(*) FILTER (arrives = 0) AS a0, count(*) FILTER (arrives = 1) AS a1,
         count(*) FILTER (arrives = 2) AS a2 FROM sp GROUP BY page_url),
s1 AS (SELECT *, CASE WHEN a0 >= 10 THEN 10 WHEN a0 >= 3 THEN 3 ELSE 0 END AS r1 FROM sn WHERE a0 > 0 OR nr > 1),
s2 AS (SELECT *, CASE WHEN nr < 2 THEN 0 WHEN r1 < 10 AND a0 + a1 - r1 >= 10 THEN 10 WHEN a0 + a1 - r1 >= 3 THEN 3 ELSE 0 END AS r2 FROM s1),
s3 AS (SELECT *, CASE WHEN nr < 3 THEN 0 WHEN r1 < 10 AND r2 < 10 AND a0 + a1 + a2 - r1 - r2 >= 10 THEN 10
                      WHEN a0 + a1 + a2 - r1 - r2 >= 3 THEN 3 ELSE 0 END AS r3 FROM s2),
so AS (SELECT sp.*, row_number() OVER (PARTITION BY page_url ORDER BY arrives, seq) AS k FROM sp),
sr AS (SELECT so.page_url, so.seq, so.post, s3.nr, (a0 = 0)::INT + (nr > 1 AND a1 = 0)::INT + (nr > 2 AND a2 = 0)::INT AS dry_rounds,
         CASE WHEN k <= r1 THEN 0 WHEN k <= r1 + r2 THEN (r1 > 0)::INT WHEN k <= r1 + r2 + r3 THEN (r1 > 0)::INT + (r2 > 0)::INT
              ELSE (r1 > 0)::INT + (r2 > 0)::INT + (r3 > 0)::INT END AS batch_id,
         CASE WHEN k <= r1 THEN 1 WHEN k <= r1 + r2 THEN 2 WHEN k <= r1 + r2 + r3 THEN 3 ELSE nr END AS round
       FROM so JOIN s3 USING (page_url))"""


Q["stream_batches"] = "WITH " + stream_ctes() + """
SELECT page_url, seq, CAST(batch_id AS BIGINT) AS batch_id, CAST(round AS BIGINT) AS round, CAST(dry_rounds AS BIGINT) AS dry_rounds FROM sr"""

_PT = "CASE WHEN json_type(p) = 'VARCHAR' THEN json_extract_string(p, '$') WHEN coalesce(json_extract_string(p, '$.text'), '') <> '' THEN json_extract_string(p, '$.text') ELSE '' END"
_OT = (f"CASE WHEN json_type(o, '$.content') = 'VARCHAR' THEN json_extract_string(o, '$.content') "
       f"WHEN json_type(o, '$.content') = 'ARRAY' THEN array_to_string(list_transform(json_extract(o, '$.content[*]'), lambda p: {_PT}), '') "
       f"WHEN coalesce(json_extract_string(o, '$.text'), '') <> '' THEN json_extract_string(o, '$.text') ELSE '' END")
Q["reply_text"] = f"""WITH e AS ({duck(FX.ENVELOPES)})
SELECT seq,
  CASE WHEN coalesce(json_extract_string(envelope, '$.choices[0].message.content'), '') <> '' THEN json_extract_string(envelope, '$.choices[0].message.content')
       WHEN coalesce(json_extract_string(envelope, '$.choices[0].text'), '') <> '' THEN json_extract_string(envelope, '$.choices[0].text')
       ELSE '' END AS chat_text,
  {trim(f"CASE WHEN json_type(envelope, '$.output') = 'ARRAY' THEN array_to_string(list_transform(json_extract(envelope, '$.output[*]'), lambda o: {_OT}), '') WHEN coalesce(json_extract_string(envelope, '$.output_text'), '') <> '' THEN json_extract_string(envelope, '$.output_text') ELSE '' END")} AS responses_text
FROM e"""

Q["insight_log"] = f"""WITH {INSIGHT_CTES}
SELECT page_url, count(*) AS n, count(*) FILTER (WHERE status = 'raw') AS n_raw,
  count(*) FILTER (WHERE coalesce(CASE WHEN status = 'raw' THEN t ELSE json_extract_string(j, '$.summary') END, '') = '') AS n_empty_summary,
  count(*) FILTER (WHERE status <> 'raw' AND json_type(j, '$.topics') = 'ARRAY') AS n_with_topics
FROM ins2 i JOIN ar USING (page_url, seq) WHERE ok GROUP BY page_url"""

Q["stream_rounds"] = f"""WITH l AS ({_LINES}),
t AS (SELECT page_url, doc_id, {trim('post')} AS post FROM l),
r AS (SELECT page_url, post, min(doc_id % 3) AS round FROM t WHERE post <> '' GROUP BY page_url, post)
SELECT page_url, CAST(round AS BIGINT) AS round, count(*) AS new_found FROM r GROUP BY ALL"""

Q["idea_topic_sets"] = CHAIN + """
SELECT page_url, CAST(batch_id AS BIGINT) AS batch_id, idea, topic, CAST(o // 1000 AS BIGINT) AS first_seq,
       CAST((o % 1000) // 10 AS BIGINT) AS first_pos, CAST(o % 10 - 1 AS BIGINT) AS t_pos
FROM tfirst"""

Q["stream_idea_store"] = Q["idea_store"].replace(f"WITH {planned_ctes(duck(FX.POSTS))}",
    "WITH " + stream_ctes() + ", planned AS (SELECT page_url, post, seq, batch_id FROM sr)")

Q["stream_idea_totals"] = CHAIN.replace(f"WITH {planned_ctes(duck(FX.POSTS))}",
    "WITH " + stream_ctes() + ", planned AS (SELECT page_url, post, seq, batch_id FROM sr)") + f""",
ft AS (SELECT *, row_number() OVER (PARTITION BY page_url, idea ORDER BY batch_id, first_seq, first_pos) AS k FROM store),
fe AS (SELECT *, row_number() OVER (PARTITION BY page_url, idea ORDER BY batch_id, seq, idea_pos) AS k FROM ev)
SELECT page_url, idea, CAST(sum(cnt) AS BIGINT) AS cnt, CAST(sum(sentiment_sum) AS BIGINT) AS sentiment_sum, count(*) AS n_batches,
       CAST(max(batch_id) FILTER (k = 1) AS BIGINT) AS first_batch, CAST(max(first_seq) FILTER (k = 1) AS BIGINT) AS first_seq, any_value(x.examples) AS examples
FROM ft JOIN (SELECT page_url, idea, string_agg(example, {SEP} ORDER BY k) AS examples FROM fe WHERE k <= 3 GROUP BY ALL) AS x USING (page_url, idea)
GROUP BY page_url, idea"""

Q["stream_distinct_window"] = """SELECT DISTINCT user_id, event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour FROM events"""

# posts read: a round's run holds all that have arrived on the pages read again; the last entry is the flush at the end
Q["stream_metrics"] = "WITH " + stream_ctes() + """,
z AS (SELECT unnest(range(0, 4)) AS r),
m AS (SELECT r, CAST(coalesce(sum(CASE WHEN r < 3 THEN (SELECT count(*) FROM sp WHERE arrives <= r AND n_rounds > r) ELSE 0 END), 0) AS BIGINT) AS posts_read FROM z GROUP BY r),
f AS (SELECT r, count(sp.seq) AS new_found FROM z LEFT JOIN sp ON sp.arrives = r GROUP BY r),
x AS (SELECT so.seq, CASE WHEN k <= r1 THEN 0 WHEN k <= r1 + r2 THEN 1 WHEN k <= r1 + r2 + r3 OR s3.nr = 3 THEN 2 ELSE 3 END AS r FROM so JOIN s3 USING (page_url)),
g AS (SELECT z.r, count(x.seq) AS released FROM z LEFT JOIN x ON x.r = z.r GROUP BY z.r)
SELECT CAST(m.r AS BIGINT) AS round, posts_read, new_found, released FROM m JOIN f USING (r) JOIN g USING (r)"""

Q["idea_reason_sets"] = CHAIN + """
SELECT page_url, CAST(batch_id AS BIGINT) AS batch_id, idea, reason, CAST(o // 10 AS BIGINT) AS first_seq,
       CAST(o % 10 AS BIGINT) AS first_pos
FROM rfirst"""

Q["toxicity_lr"] = f"""WITH t AS (SELECT DISTINCT doc_id, token FROM ({_TOK}) WHERE token <> ''),
l AS (SELECT doc_id, toxic FROM labels WHERE toxic IS NOT NULL AND doc_id IN (SELECT doc_id FROM documents)),
n AS (SELECT count(*) FILTER (toxic = 1) AS n1, count(*) FILTER (toxic = 0) AS n0 FROM l),
w AS (SELECT token, ln((count(*) FILTER (toxic = 1) + 1) / (max(n1) + 2)) - ln((count(*) FILTER (toxic = 0) + 1) / (max(n0) + 2)) AS weight
      FROM t JOIN l USING (doc_id), n GROUP BY token),
m AS (SELECT doc_id, avg(weight) AS m FROM t JOIN w USING (token) GROUP BY doc_id)
SELECT d.doc_id, round(1 / (1 + exp(-coalesce(m.m, 0))), 6) AS toxicity FROM documents d LEFT JOIN m USING (doc_id)"""

# every test page has one article: the only element that a scan selector matches
_STRIP = "regexp_replace(regexp_replace(regexp_extract(html, '<article[^>]*>(.*?)</article>', 1, 's'), '<!--.*?-->', '', 'gs'), '<[^>]*>', '', 'g')"
_PLAIN = _STRIP
for _e, _c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"), ("&hellip;", "…"), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_e}', '{_c}')"
Q["page_selector_scan"] = f"""WITH a AS (SELECT DISTINCT url AS page_url, {trim(_PLAIN)} AS post FROM pages
  WHERE NOT regexp_matches(url, 'login|signup|consent|native_app|app='))
SELECT page_url, CAST(1 AS BIGINT) AS pos, CAST(length(post) AS BIGINT) AS n_chars, md5(post) AS post_md5 FROM a WHERE post <> ''"""


# prompts of all tasks; JSON inputs are indented by two
def _strings(lst: str, indent: int) -> str:
    pad = "chr(10) || '" + " " * (indent + 2) + "'"
    return (f"CASE WHEN coalesce(len({lst}), 0) = 0 THEN '[]' ELSE '[' || {pad} || array_to_string(list_transform({lst}, lambda x: to_json(x)::VARCHAR), ',' || {pad}) "
            f"|| chr(10) || '{' ' * indent}]' END")


def _object(fields, indent: int) -> str:
    pad = "chr(10) || '" + " " * (indent + 2)
    return "'{' || " + " || ',' || ".join(f"{pad}\"{n}\": ' || {v}" for n, v in fields) + f" || chr(10) || '{' ' * indent}}}'"


_NL = "chr(10)"
Q["prompt_render"] = CHAIN + f""",
d AS (SELECT doc_id, text || ' \"\"\" ' || chr(92) || ' end' AS t FROM documents),
pa AS (SELECT 'analyze' AS task, CAST(doc_id AS VARCHAR) AS key, {lit(ANALYSIS_PROMPT_HEAD)} || {_ESC} || {lit(ANALYSIS_PROMPT_TAIL)} AS prompt FROM d),
pc AS (SELECT 'extract_chunk' AS task, 'doc' || CAST(doc_id AS VARCHAR) || '/' || CAST(chunk_no AS VARCHAR) AS key,
         {lit(CHUNK_USER_HEAD)} || substring(t, start + 1, 12000) AS prompt FROM ({_chunks(12000, 300)}) WHERE {trim('t')} <> ''),
w AS ({Q["pack_batches"].replace("WITH RECURSIVE c AS", "WITH RECURSIVE c0 AS").replace("FROM c WHERE", "FROM c0 WHERE").replace("JOIN c n", "JOIN c0 n")}),
pk AS (SELECT 'extract_candidates' AS task, w.page_url || '/' || CAST(w.cand_batch AS VARCHAR) || '/' || CAST((w.batch_pos - 1) // 50 AS VARCHAR) AS key,
         {lit(CANDIDATE_USER_HEAD)} || '[' || string_agg(to_json(x.text)::VARCHAR, ',' ORDER BY w.batch_pos) || ']' || {lit(CANDIDATE_USER_TAIL)} AS prompt
       FROM w JOIN documents x ON x.doc_id = w.pos GROUP BY w.page_url, w.cand_batch, (w.batch_pos - 1) // 50),
ii AS (SELECT i.seq, substring({trim(collapse('i.summary_text'))}, 1, 800) AS summary, i.sentiment, i.topics[1:5] AS topics, substring(coalesce(p.post, ''), 1, 800) AS post
       FROM ins2 i JOIN raw_posts p ON p.page_url = i.page_url AND p.seq = i.seq WHERE i.ok),
pi2 AS (SELECT 'ideate' AS task, CAST(seq AS VARCHAR) AS key, {lit(IDEA_USER_HEAD)} || {_object([("summary", "to_json(summary)::VARCHAR"), ("sentiment", "to_json(sentiment)::VARCHAR"), ("topics", _strings("topics", 2)), ("examples", "'[]'"), ("post", "to_json(post)::VARCHAR")], 0)} || {lit(IDEA_USER_TAIL)} AS prompt FROM ii),
pl AS (SELECT page_url, batch_id, payload_pos, idea, cnt, sentiment_sum, {_LIST.format(c='topics')} AS topics, {_LIST.format(c='examples')} AS examples, {_LIST.format(c='reasons')} AS reasons FROM payload),
pr AS (SELECT 'rank' AS task, page_url || '/' || CAST(batch_id AS VARCHAR) || '/' || CAST((payload_pos - 1) // 30 AS VARCHAR) AS key,
         {lit(RANK_USER_HEAD)} || '{{' || {_NL} || '  "ideas": [' || {_NL} || '    ' || string_agg({_object([("idea", "to_json(idea)::VARCHAR"), ("count", "CAST(cnt AS VARCHAR)"), ("sentimentSum", "CAST(sentiment_sum AS VARCHAR)"), ("topics", _strings("topics", 6)), ("examples", _strings("examples", 6)), ("reasons", _strings("reasons", 6))], 4)}, ',' || {_NL} || '    ' ORDER BY payload_pos)
         || {_NL} || '  ]' || {_NL} || '}}' || {lit(RANK_USER_TAIL)} AS prompt
       FROM pl GROUP BY page_url, batch_id, (payload_pos - 1) // 30),
a AS (SELECT * FROM pa UNION ALL SELECT * FROM pc UNION ALL SELECT * FROM pk UNION ALL SELECT * FROM pi2 UNION ALL SELECT * FROM pr)
SELECT task, key, CAST(length(prompt) AS BIGINT) AS prompt_len, md5(prompt) AS prompt_md5 FROM a"""

Q["report_document"] = Q["report_lines"].replace("SELECT page_url, CAST(batch_id AS BIGINT) AS batch_id, CAST(pos AS BIGINT) AS pos,\n  concat_ws", "bl AS (SELECT page_url, CAST(batch_id AS BIGINT) AS batch_id, CAST(pos AS BIGINT) AS pos,\n  concat_ws").replace("FROM rrows)\nbl AS", "FROM rrows),\nbl AS") + """),
good AS (SELECT page_url, batch_id FROM rx WHERE arr IS NOT NULL AND len(arr) > 0),
fb AS (SELECT p.page_url, p.batch_id, p.payload_pos, p.idea FROM payload p WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.page_url = p.page_url AND g.batch_id = p.batch_id)),
none AS (SELECT DISTINCT page_url, batch_id FROM planned ANTI JOIN store USING (page_url, batch_id)),
o AS (SELECT DISTINCT page_url, batch_id, 0 AS section, 0 AS pos, '--- Product Ideas (LLM-ranked) ---' AS text FROM bl
  UNION ALL SELECT page_url, batch_id, 1, pos, block FROM bl
  UNION ALL SELECT DISTINCT page_url, batch_id, 2, 0, 'Fallback — listing idea headlines:' FROM fb
  UNION ALL SELECT page_url, batch_id, 3, payload_pos, ' - ' || idea FROM fb
  UNION ALL SELECT page_url, batch_id, 4, 0, 'No product ideas generated for this batch.' FROM none)
SELECT page_url, CAST(batch_id AS BIGINT) AS batch_id, CAST(section AS BIGINT) AS section, CAST(pos AS BIGINT) AS pos, md5(text) AS text_md5 FROM o"""

Q["batch_plan_offset"] = f"""WITH {planned_ctes(duck(FX.POSTS))},
r AS (SELECT page_url, seq, rn - 4 AS rn, n - 4 AS n FROM planned JOIN (SELECT page_url AS pu, count(*) AS n FROM planned GROUP BY page_url) ON pu = page_url WHERE rn > 4),
b AS (SELECT page_url, seq, CASE WHEN n >= 10 THEN (CASE WHEN rn <= 10 THEN 0 ELSE 1 + least((rn - 11) // 3, 2) END) ELSE least((rn - 1) // 3, 3) END AS batch_id FROM r)
SELECT page_url, seq, CAST(batch_id AS BIGINT) AS batch_id FROM b WHERE batch_id < 2"""

Q["ordered_union"] = f"""WITH l AS ({_LINES}),
u AS (SELECT 0 AS o, doc_id AS a, line_no AS b, {trim('post')} AS post FROM l
  UNION ALL SELECT 1, conv_id, turn, {trim('text')} FROM conversations WHERE role = 'user'),
r AS (SELECT *, row_number() OVER (PARTITION BY post ORDER BY o, a, b) AS rk FROM u WHERE post <> '')
SELECT md5(post) AS post_md5, CAST(o AS BIGINT) AS source_ord, a, CAST(b AS BIGINT) AS b FROM r WHERE rk = 1"""

Q["posts_insights"] = f"""WITH {planned_ctes(duck(FX.POSTS))}, {INSIGHT_CTES}
SELECT p.seq, CAST(p.batch_id AS BIGINT) AS batch_id, i.status FROM planned p
LEFT JOIN ins2 i ON i.page_url = p.page_url AND i.seq = p.seq AND NOT ({_failed('i.seq')}) AND NOT ({_missing('i.seq')})"""

Q["stream_pages"] = f"""WITH a AS (SELECT DISTINCT url AS page_url, {trim(_PLAIN)} AS post FROM pages
  WHERE NOT regexp_matches(url, 'login|signup|consent|native_app|app='))
SELECT page_url, CAST(0 AS BIGINT) AS batch_id, CAST(1 AS BIGINT) AS seq, md5(post) AS post_md5 FROM a WHERE post <> ''"""
