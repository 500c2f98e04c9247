"""Idea parsing and filtering (F6, F7, P17, P18, P20) as array higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, collapse_ws, loose_lines, trim_ws

# Patterns marking an idea as generic (matched case-insensitively).
GENERIC_PATTERNS = ["guide", "checklist", "subscription delivering", "curated", "introductory"]

# Text of the fallback idea built from a summary.
FALLBACK_PREFIX = 'Concise solution guide: "'
FALLBACK_SUFFIX = '" — targeted info product to validate demand.'
FALLBACK_TITLE_CHARS = 120

# Fixed value: the idea layout the ideation prompt asks for ("title — pitch | why | price").
TITLE_SEPARATOR = " — "


def generic_regex(patterns=GENERIC_PATTERNS) -> str:
    return "(?i)(" + "|".join(patterns) + ")"


def filter_generic(arr, patterns=GENERIC_PATTERNS, k: int = 3) -> Column:
    """drop generic items, de-duplicate the rest in order; if nothing survives keep the
    originals (not de-duplicated); first ``k``."""
    a = _c(arr)
    rx = generic_regex(patterns)
    kept = F.array_distinct(F.filter(a, lambda x: ~F.lower(x).rlike(rx)))
    return F.when(F.size(kept) > 0, F.slice(kept, 1, k)).otherwise(F.slice(a, 1, k))


def fallback_idea(summary_text) -> Column:
    """One templated idea from the collapsed summary; blank summary -> empty array."""
    s = trim_ws(collapse_ws(F.coalesce(_c(summary_text), F.lit(""))))
    idea = F.concat(F.lit(FALLBACK_PREFIX), F.substring(s, 1, FALLBACK_TITLE_CHARS), F.lit(FALLBACK_SUFFIX))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.array(idea))


def split_idea(idea) -> Column:
    """P20: ``title — pitch | why | price`` -> struct<title, pitch, why, price, price_usd>."""
    x = _c(idea)
    parts = F.split(x, r"\s*\|\s*")
    head = F.element_at(parts, 1)
    hp = F.split(head, TITLE_SEPARATOR, 2)
    price = F.try_element_at(parts, F.lit(3))
    amount = F.regexp_extract(F.coalesce(price, F.lit("")), r"\$\s*([0-9][0-9,]*(\.[0-9]+)?)", 1)
    return F.struct(
        trim_ws(F.element_at(hp, 1)).alias("title"),
        trim_ws(F.try_element_at(hp, F.lit(2))).alias("pitch"),
        F.try_element_at(parts, F.lit(2)).alias("why"),
        price.alias("price"),
        F.when(amount != "", F.regexp_replace(amount, ",", "").cast("double")).alias("price_usd"),
    )


def with_ideas(df, reply_col: str = "idea_reply", summary_col: str = "summary_text", out_col: str = "ideas", k: int = 3):
    """The ideas of the reply; without any the fallback idea."""
    p = f"_{out_col}_"
    df = with_reply_ideas(df, reply_col, p + "found", k).withColumn(p + "fb", fallback_idea(F.col(summary_col)))
    return df.withColumn(out_col, found_or(p + "found", p + "fb")).drop(p + "found", p + "fb")


def found_or(found: str, fallback: str) -> Column:
    """The ideas found in a reply (:func:`with_reply_ideas`), or those of the fallback."""
    return F.when(F.size(F.col(found)) > 0, F.col(found)).otherwise(F.col(fallback))


def with_reply_ideas(df, reply_col: str = "idea_reply", out_col: str = "found", k: int = 3):
    """The part of P17 that needs the reply alone, as stages (each intermediate array computed once); empty if it
    has no ideas. A reply can be read before it meets its post."""
    from .jsonx import with_string_array

    p = f"_{out_col}_"
    df = with_string_array(df, reply_col, p + "parsed", k)
    df = df.withColumns({p + "lines": loose_lines(F.col(reply_col), 30)})
    rx = generic_regex()
    df = df.withColumns({
        p + "kp": F.array_distinct(F.filter(F.col(p + "parsed"), lambda x: ~F.lower(x).rlike(rx))),
        p + "kl": F.array_distinct(F.filter(F.col(p + "lines"), lambda x: ~F.lower(x).rlike(rx))),
    })
    r = F.col(reply_col)
    fg_parsed = F.when(F.size(F.col(p + "kp")) > 0, F.slice(F.col(p + "kp"), 1, k)).otherwise(F.slice(F.col(p + "parsed"), 1, k))
    fg_lines = F.when(F.size(F.col(p + "kl")) > 0, F.slice(F.col(p + "kl"), 1, k)).otherwise(F.slice(F.col(p + "lines"), 1, k))
    none = F.array().cast("array<string>")
    out = (
        F.when(r.isNull() | (r == ""), none)
        .when(F.coalesce(F.size(F.col(p + "parsed")), F.lit(0)) > 0, fg_parsed)
        .when(F.size(F.col(p + "lines")) > 0, fg_lines)
        .otherwise(none)
    )
    temps = [c for c in df.columns if c.startswith(p)]
    return df.withColumn(out_col, out).drop(*temps)
