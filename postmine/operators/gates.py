"""Row gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _c, trim_ws, word_count

# Final-URL patterns of blocked or redirected pages (case-sensitive).
BLOCKED_URL_PATTERN = r"login|signup|consent|native_app|app="
# Error-message patterns worth a retry (case-insensitive), status and codes.
RETRYABLE_PATTERN = r"rate limit|429|too many requests|timeout|timed out|etimedout|econnreset|ecancelled|fetch failed"
RETRYABLE_STATUS = 429
RETRYABLE_CODES = ["ETIMEDOUT", "ECONNRESET"]
# Candidate gates.
CAND_MIN_CHARS = 40
CAND_MIN_WORDS = 5
DENSE_MIN_CHARS = 120
DENSE_MAX_CHILDREN = 6


def is_blocked_url(url) -> Column:
    return F.coalesce(_c(url).rlike(BLOCKED_URL_PATTERN), F.lit(False))


def url_gate(pages: DataFrame, url_col: str = "page_url") -> tuple[DataFrame, DataFrame]:
    """(kept, rejected). Place before any Python stage so the predicate stays in the scan."""
    blocked = is_blocked_url(url_col)
    return pages.filter(~blocked), pages.filter(blocked)


def candidate_ok(text, min_chars: int = CAND_MIN_CHARS, min_words: int = CAND_MIN_WORDS) -> Column:
    """F2 on trimmed text: more than ``min_chars`` chars and more than ``min_words`` words."""
    t = trim_ws(text)
    return (F.length(t) > min_chars) & (word_count(t) > min_words)


def is_retryable(message, status=None, code=None) -> Column:
    """F8 over dead letters."""
    m = F.coalesce(F.lower(_c(message)), F.lit(""))
    cond = m.rlike(RETRYABLE_PATTERN)
    if status is not None:
        cond = cond | F.coalesce(_c(status) == RETRYABLE_STATUS, F.lit(False))
    if code is not None:
        cond = cond | F.coalesce(_c(code).isin(*RETRYABLE_CODES), F.lit(False))
    return cond
