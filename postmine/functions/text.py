"""Column-level string helpers (P1-P6, P19) — all built-in Catalyst expressions.

JavaScript's ``trim()`` and ``\\s`` know more whitespace than Spark's ``trim``; one explicit class is
used everywhere. Lengths and slices count code points (JavaScript counts UTF-16 units; the two differ
only for characters outside the BMP).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The JavaScript whitespace set (``\s`` / ``String.prototype.trim``).
WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The same set as characters (for Spark's ``trim(trimStr FROM str)``, much cheaper than a regex).
WS_CHARS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


# Non-ASCII members of WS; mapped to spaces so Java's fast ``\\s`` (= the ASCII members) can be used.
EXOTIC_WS = "\u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def ascii_ws(c) -> Column:
    """Every non-ASCII whitespace character of WS replaced by a space (a per-char map, no regex)."""
    return F.translate(_c(c), EXOTIC_WS, " " * len(EXOTIC_WS))


def trim_ws(c) -> Column:
    """Unicode trim."""
    return F.trim(_c(c), F.lit(WS_CHARS))


def collapse_ws(c) -> Column:
    """Every whitespace run becomes one space."""
    return F.regexp_replace(ascii_ws(c), r"\s+", " ")


def non_blank(c) -> Column:
    """true when the trimmed text is non-empty (some non-whitespace character exists)."""
    return F.coalesce(trim_ws(c) != F.lit(""), F.lit(False))


def ellipsis_if_longer(original, n: int) -> Column:
    return F.when(F.length(_c(original)) > n, F.lit("...")).otherwise(F.lit(""))


def preview(c, n: int = 140, trim: bool = True) -> Column:
    """First ``n`` chars of the collapsed (and trimmed) text + ``...`` when the original is longer."""
    x = F.coalesce(_c(c), F.lit(""))
    body = collapse_ws(x)
    if trim:
        body = trim_ws(body)
    return F.concat(F.substring(body, 1, n), ellipsis_if_longer(x, n))


def sentiment_score(label) -> Column:
    """Lower-cased label containing ``pos`` -> 1, else ``neg`` -> -1, else 0 (missing -> 0)."""
    s = F.lower(F.coalesce(_c(label), F.lit("")))
    return (
        F.when(s.contains("pos"), F.lit(1)).when(s.contains("neg"), F.lit(-1)).otherwise(F.lit(0)).cast("int")
    )


def url_origin(c) -> Column:
    """P5: scheme://host[:port] with default ports dropped; null for an invalid URL."""
    u = _c(c)
    proto = F.lower(F.try_parse_url(u, F.lit("PROTOCOL")))
    host = F.lower(F.try_parse_url(u, F.lit("HOST")))
    auth = F.try_parse_url(u, F.lit("AUTHORITY"))
    port = F.regexp_extract(auth, r":(\d+)$", 1)
    default = ((proto == "http") & (port == "80")) | ((proto == "https") & (port == "443")) | (port == "")
    return F.when(
        proto.isNotNull() & host.isNotNull() & (host != ""),
        F.concat(proto, F.lit("://"), host, F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port))),
    )


def escape_prompt(c) -> Column:
    """``\\`` -> ``\\\\`` and ``\"\"\"`` -> ``\\\"\"\"`` in one left-to-right pass.

    Backslashes first: the second replacement cannot create a new backslash match, so two passes
    equal one.
    """
    x = F.regexp_replace(_c(c), r"\\", r"\\\\")
    return F.regexp_replace(x, '"""', r'\\"""')


def loose_lines(c, min_chars: int = 30) -> Column:
    """split on CR?LF, trim, keep lines longer than ``min_chars``."""
    parts = F.split(F.coalesce(_c(c), F.lit("")), r"\r?\n")
    return F.filter(F.transform(parts, trim_ws), lambda x: F.length(x) > min_chars)


def text_lines(c) -> Column:
    """Reply fallback: split on LF, trim, drop blanks (``split('\\n').map(trim).filter(Boolean)``)."""
    parts = F.split(F.coalesce(_c(c), F.lit("")), "\n")
    return F.filter(F.transform(parts, trim_ws), lambda x: x != "")


def word_count(c) -> Column:
    """``text.split(/\\s+/).length`` on already trimmed text."""
    return F.size(F.split(ascii_ws(c), r"\s+"))
