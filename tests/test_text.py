"""Whitespace semantics of JavaScript (trim, \\s) and the small string helpers."""

from pyspark.sql import functions as F

from postmine.functions import text as T
from postmine.operators import gates as G


def test_unicode_whitespace(spark):
    s = " 　 a b\x0b\n c ﻿ "
    df = spark.createDataFrame([(s,)], "t string")
    r = df.select(T.trim_ws("t").alias("tr"), T.collapse_ws("t").alias("co"), T.word_count(T.trim_ws("t")).alias("wc"),
                  T.non_blank("t").alias("nb"), T.non_blank(F.lit("  \t")).alias("blank")).first()
    assert r.tr == "a b\x0b\n c"
    assert r.co == " a b c "
    assert r.wc == 3 and r.nb and not r.blank


def test_preview_and_example(spark):
    long = "word  " * 50
    df = spark.createDataFrame([(long,), ("  short\ttext ",)], "t string")
    rows = df.select(T.preview("t", 140).alias("p"), T.preview("t", 240, trim=False).alias("e")).collect()
    assert rows[0].p == ("word " * 28) + "..." and len(rows[0].p) == 143
    assert rows[1].p == "short text" and rows[1].e == " short text "


def test_sentiment_score_url_origin_escape(spark):
    df = spark.createDataFrame([("Very Positive",), ("NEGATIVE",), ("neutral",), (None,)], "s string")
    assert [r[0] for r in df.select(T.sentiment_score("s")).collect()] == [1, -1, 0, 0]
    u = spark.createDataFrame([("https://A.b.com:443/x?y",), ("http://a.b.com:8080/",), ("not a url",), ("ftp://h/x",)], "u string")
    assert [r[0] for r in u.select(T.url_origin("u")).collect()] == ["https://a.b.com", "http://a.b.com:8080", None, "ftp://h"]
    e = spark.createDataFrame([('a\\b """q""" \\"""',)], "t string")
    assert e.select(T.escape_prompt("t")).first()[0] == 'a\\\\b \\"""q\\""" \\\\\\"""'


def test_url_gate_and_candidate_gate(spark):
    p = spark.createDataFrame([("https://x.com/login",), ("https://x.com/Login",), ("https://x.com/?app=1",), ("https://x.com/a",)], "page_url string")
    kept, rejected = G.url_gate(p)
    assert sorted(r[0] for r in kept.collect()) == ["https://x.com/Login", "https://x.com/a"]
    assert rejected.count() == 2
