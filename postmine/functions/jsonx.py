"""Tolerant JSON parsing of model replies (P10-P16, F5, F9, P19) over Spark variants.

``JSON.parse`` is stricter than Spark's parser: ``try_parse_json`` accepts trailing text. A text is
taken as strict JSON only when it parses inside both ``[`` ... ``]`` and ``{"v":`` ... ``}``: trailing
text can never close both wrappers, so the two parses together accept exactly one JSON value.
Duplicate keys keep the last value (``spark.sql.variant.allowDuplicateKeys``, set by
:func:`postmine.session.configure`).

Everything here is a Catalyst expression: no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, _c, text_lines, trim_ws

NUMERIC_PREFIXES = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL", "DOUBLE", "FLOAT")


# ----------------------------------------------------------------------------------------------
# variant helpers
# ----------------------------------------------------------------------------------------------
def vtype(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_json_null(v: Column) -> Column:
    """SQL null (absent) or JSON ``null``."""
    return v.isNull() | F.is_variant_null(v)


def is_array(v: Column) -> Column:
    """``Array.isArray``."""
    return F.coalesce(vtype(v).startswith("ARRAY"), F.lit(False))


def is_object(v: Column) -> Column:
    return F.coalesce(vtype(v).startswith("OBJECT"), F.lit(False))


def _is_number(t: Column) -> Column:
    cond = F.lit(False)
    for p in NUMERIC_PREFIXES:
        cond = cond | t.startswith(p)
    return cond


def truthy(v: Column) -> Column:
    """JavaScript truthiness of a JSON value: null/false/0/'' are falsy, objects and arrays truthy."""
    t = vtype(v)
    return (
        F.when(is_json_null(v), F.lit(False))
        .when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(_is_number(t), F.coalesce(F.try_variant_get(v, "$", "double") != 0, F.lit(False)))
        .when(t == "STRING", F.try_variant_get(v, "$", "string") != "")
        .otherwise(F.lit(True))
    )


def field(v: Column, path: str) -> Column:
    """``obj?.key`` as a variant (null when absent or when ``v`` is not an object)."""
    return F.try_variant_get(v, path, "variant")


def _scalar_string(x: Column) -> Column:
    t = vtype(x)
    d = F.try_variant_get(x, "$", "double")
    integral_double = (t == "DOUBLE") & (d == F.floor(d)) & (F.abs(d) < F.lit(1e15))
    return (
        F.when(t == "STRING", F.try_variant_get(x, "$", "string"))
        .when(t == "BOOLEAN", F.lower(x.cast("string")))
        .when(integral_double, F.floor(d).cast("bigint").cast("string"))
        .otherwise(x.cast("string"))
    )


def js_string(v: Column) -> Column:
    """``String(x)`` of a JSON value. Objects give ``[object Object]``; arrays join items with
    ``,`` (null items empty; nested arrays are written as JSON text)."""
    t = vtype(v)
    arr = F.try_variant_get(v, "$", "array<variant>")
    inner = F.transform(
        arr,
        lambda x: F.when(is_json_null(x), F.lit(""))
        .when(vtype(x).startswith("OBJECT"), F.lit("[object Object]"))
        .otherwise(_scalar_string(x)),
    )
    return (
        F.when(is_json_null(v), F.lit("null"))
        .when(t.startswith("OBJECT"), F.lit("[object Object]"))
        .when(t.startswith("ARRAY"), F.array_join(inner, ",", ""))
        .otherwise(_scalar_string(v))
    )


def or_empty(v: Column) -> Column:
    """``(x || '').toString()``."""
    return F.when(truthy(v), js_string(v)).otherwise(F.lit(""))


def string_items(v: Column) -> Column:
    """``Array.isArray(x) ? x.map(String) : []`` -> array<string> (never null)."""
    arr = F.try_variant_get(v, "$", "array<variant>")
    return F.when(is_array(v), F.transform(arr, js_string)).otherwise(F.array().cast("array<string>"))


def clean_items(items: Column) -> Column:
    """``.map(s => s.trim()).filter(Boolean)``."""
    return F.filter(F.transform(items, trim_ws), lambda x: x != "")


# ----------------------------------------------------------------------------------------------
# strict parse, repair, extraction windows
# ----------------------------------------------------------------------------------------------
def strict_json(t) -> Column:
    """``JSON.parse`` semantics: the variant, or null when the text is not exactly one JSON value."""
    t = _c(t)
    as_obj = F.try_parse_json(F.concat(F.lit('{"v":'), t, F.lit("}")))
    as_arr = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
    return F.when(as_obj.isNotNull() & as_arr.isNotNull(), F.try_variant_get(as_obj, "$.v", "variant"))


def repair_json(t) -> Column:
    """Drop commas before ``}``/``]`` and turn curly quotes into ``"``."""
    x = F.regexp_replace(_c(t), f",{WS}*([}}\\]])", "$1")
    return F.translate(x, "‘’“”", '""""')


def greedy_object_text(t) -> Column:
    """First ``{`` .. last ``}`` ('' when absent)."""
    return F.regexp_extract(_c(t), r"(?s)\{.*\}", 0)


def greedy_array_text(t) -> Column:
    """First ``[`` .. last ``]`` ('' when absent)."""
    return F.regexp_extract(_c(t), r"(?s)\[.*\]", 0)


def parse_or_repair(window_text: Column) -> Column:
    """Strict parse of the window; on failure strict parse of the repaired window; else null."""
    return F.when(
        window_text != "",
        F.coalesce(strict_json(window_text), strict_json(repair_json(window_text))),
    )


# ----------------------------------------------------------------------------------------------
# P10 reply text assembly
# ----------------------------------------------------------------------------------------------
def reply_text(envelope, api: str = "chat") -> Column:
    """P10: text of a service reply envelope (JSON text).

    ``responses``: concatenate string ``content``, string parts and ``part.text`` of each output item,
    or the item's ``text``; without ``output`` use ``output_text``; trimmed.
    ``chat``: ``choices[0].message.content || choices[0].text || ''``.
    """
    v = F.try_parse_json(_c(envelope))
    if api == "chat":
        a = field(v, "$.choices[0].message.content")
        b = field(v, "$.choices[0].text")
        return F.when(truthy(a), js_string(a)).when(truthy(b), js_string(b)).otherwise(F.lit(""))
    out = field(v, "$.output")
    items = F.try_variant_get(v, "$.output", "array<variant>")

    def part_text(p):
        pt = field(p, "$.text")
        return F.when(vtype(p) == "STRING", js_string(p)).when(truthy(pt), js_string(pt)).otherwise(F.lit(""))

    def item_text(o):
        c = field(o, "$.content")
        ot = field(o, "$.text")
        parts = F.try_variant_get(o, "$.content", "array<variant>")
        return (
            F.when(F.coalesce(vtype(c) == "STRING", F.lit(False)), js_string(c))
            .when(is_array(c), F.array_join(F.transform(parts, part_text), ""))
            .when(truthy(ot), js_string(ot))
            .otherwise(F.lit(""))
        )

    ot = field(v, "$.output_text")
    txt = (
        F.when(truthy(out) & is_array(out), F.array_join(F.transform(items, item_text), ""))
        .when(truthy(out), F.lit(""))
        .when(truthy(ot), js_string(ot))
        .otherwise(F.lit(""))
    )
    return trim_ws(txt)


# ----------------------------------------------------------------------------------------------
# DataFrame-level stages
#
# The column helpers above nest: a parse feeds several field extractions. Written as one
# expression, each extraction would repeat the parse (and the generated code can outgrow the
# compiler). The stages below compute every variant once into a column; the optimizer keeps
# projections apart when a costly column is used more than once, so each parse runs once per row.
# ----------------------------------------------------------------------------------------------
def _stage(df, cols: dict):
    return df.withColumns(cols)


def with_insight(df, reply_col: str = "reply", out_col: str = "ins"):
    """P11 (+F5, F9, P19): strict JSON, else greedy ``{..}``, else ``{summary: text, raw: text}``.

    Adds ``out_col`` = ``struct<status, ok, payload, summary, summary_text, reason, sentiment, topics,
    toxicity, raw>``; ``ok`` is the truthiness of the insight (falsy insights are skipped downstream)."""
    p = f"_{out_col}_"
    df = _stage(df, {p + "t": F.coalesce(F.col(reply_col), F.lit(""))})
    df = _stage(df, {p + "g": greedy_object_text(F.col(p + "t"))})
    df = _stage(df, {p + "v1": strict_json(F.col(p + "t")), p + "v2": strict_json(F.col(p + "g"))})
    t = F.col(p + "t")
    raw_obj = F.to_variant_object(F.struct(t.alias("summary"), t.alias("raw")))
    df = _stage(df, {
        p + "st": F.when(F.col(p + "v1").isNotNull(), F.lit("parsed"))
        .when(F.col(p + "v2").isNotNull(), F.lit("salvaged")).otherwise(F.lit("raw")),
        p + "v": F.coalesce(F.col(p + "v1"), F.col(p + "v2"), raw_obj),
    })
    v = F.col(p + "v")
    df = _stage(df, {
        p + "summ": field(v, "$.summary"), p + "sent": field(v, "$.sentiment"),
        p + "top": field(v, "$.topics"), p + "tox": field(v, "$.toxicityScore"),
    })
    summ, st = F.col(p + "summ"), F.col(p + "st")
    df = _stage(df, {p + "ss": F.when(summ.isNotNull(), js_string(summ)), p + "truthy_summ": truthy(summ)})
    ins = F.struct(
        st.alias("status"),
        F.when(st == "raw", F.lit(True)).otherwise(truthy(v)).alias("ok"),
        v.alias("payload"),
        F.col(p + "ss").alias("summary"),
        F.when(F.col(p + "truthy_summ"), F.col(p + "ss")).otherwise(F.lit("")).alias("summary_text"),
        F.when(F.col(p + "truthy_summ"), F.substring(F.col(p + "ss"), 1, 200)).alias("reason"),
        F.lower(or_empty(F.col(p + "sent"))).alias("sentiment"),
        string_items(F.col(p + "top")).alias("topics"),
        F.try_variant_get(F.col(p + "tox"), "$", "double").alias("toxicity"),
        F.when(st == "raw", t).alias("raw"),
    )
    temps = [c for c in df.columns if c.startswith(p)]
    return df.withColumn(out_col, ins).drop(*temps)


def with_posts(df, reply_col: str = "reply", out_col: str = "posts", missing: str = "lines"):
    """P12 (``missing='lines'``, chunk extractor) / P13 (``missing='empty'``, candidate extractor).

    Window = greedy ``{..}`` or the whole text; strict parse; ``posts`` array -> stringified, trimmed,
    non-blank items. P12: bad JSON or no ``posts`` array -> non-blank lines. P13: bad JSON (or JSON
    ``null``) -> lines; valid JSON without ``posts`` -> nothing."""
    p = f"_{out_col}_"
    df = _stage(df, {p + "t": F.coalesce(F.col(reply_col), F.lit(""))})
    df = _stage(df, {p + "g": greedy_object_text(F.col(p + "t"))})
    df = _stage(df, {p + "w": F.when(F.col(p + "g") != "", F.col(p + "g")).otherwise(F.col(p + "t"))})
    df = _stage(df, {p + "v": strict_json(F.col(p + "w"))})
    df = _stage(df, {p + "posts": field(F.col(p + "v"), "$.posts")})
    v, posts = F.col(p + "v"), F.col(p + "posts")
    df = _stage(df, {p + "isarr": is_array(posts), p + "null": is_json_null(v)})
    items = clean_items(string_items(posts))
    lines = text_lines(F.col(p + "t"))
    if missing == "lines":
        out = F.when(v.isNotNull() & F.col(p + "isarr"), items).otherwise(lines)
    elif missing == "empty":
        out = F.when(F.col(p + "null"), lines).when(F.col(p + "isarr"), items).otherwise(F.array().cast("array<string>"))
    else:
        raise ValueError(missing)
    temps = [c for c in df.columns if c.startswith(p)]
    return df.withColumn(out_col, out).drop(*temps)


def with_object(df, reply_col: str = "reply", out_col: str = "obj"):
    """P15 + P16 as stages: variant column or null."""
    p = f"_{out_col}_"
    df = _stage(df, {p + "w": greedy_object_text(F.coalesce(F.col(reply_col), F.lit("")))})
    df = _stage(df, {p + "s": strict_json(F.col(p + "w")), p + "r": repair_json(F.col(p + "w"))})
    df = _stage(df, {out_col: F.when(F.col(p + "w") != "", F.coalesce(F.col(p + "s"), strict_json(F.col(p + "r"))))})
    return df.drop(p + "w", p + "s", p + "r")


def with_string_array(df, reply_col: str = "reply", out_col: str = "arr", k: int = 3):
    """P14 + P16 as stages: array<string> (<= k) or null."""
    p = f"_{out_col}_"
    df = _stage(df, {p + "w": greedy_array_text(F.coalesce(F.col(reply_col), F.lit("")))})
    df = _stage(df, {p + "s": strict_json(F.col(p + "w")), p + "r": repair_json(F.col(p + "w"))})
    df = _stage(df, {p + "v": F.when(F.col(p + "w") != "", F.coalesce(F.col(p + "s"), strict_json(F.col(p + "r"))))})
    v = F.col(p + "v")
    df = _stage(df, {out_col: F.when(is_array(v), F.slice(clean_items(string_items(v)), 1, k))})
    return df.drop(p + "w", p + "s", p + "r", p + "v")
