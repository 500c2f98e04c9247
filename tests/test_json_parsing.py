"""Golden cases for the tolerant parsers (P10-P16) and the idea cascade."""

from pyspark.sql import functions as F

from postmine.functions import ideas as I
from postmine.functions import jsonx as J


def _one(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(df)).collect()]


def test_strict_json_matches_json_parse(spark):
    cases = {
        '{"a":1}': True, ' {"a":1} ': True, '{"a":1} xyz': False, '{"a":1,}': False, "1],[2": False, "": False,
        "null": True, "0": True, '"s"': True, "{'a':1}": False, "NaN": False, '{"a":1}{"b":2}': False,
        "[1] [2]": False, '{"a":01}': False, "[1, 2]": True,
    }
    got = _one(spark, lambda d: J.strict_json("t").isNotNull(), list(cases))
    assert got == list(cases.values())


def test_duplicate_keys_keep_last(spark):
    got = _one(spark, lambda d: F.try_variant_get(J.strict_json("t"), "$.a", "int"), ['{"a":1,"a":2}'])
    assert got == [2]


def test_parse_insight_shapes(spark):
    vals = [
        '{"summary":"s","sentiment":"Positive","topics":["a",1,null,{"x":1}],"toxicityScore":0.5}',
        '```json\n{"summary":"f","sentiment":"neg"}\n```',
        'Here: {"summary":"p"} thanks',
        '{"summary":"x",}',
        "",
        "null",
        '"scalar"',
        '{"summary": "trunc',
    ]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, t string")
    rows = J.with_insight(df, "t", "ins").orderBy("i").select("ins.*").collect()
    assert [r.status for r in rows] == ["parsed", "salvaged", "salvaged", "raw", "raw", "parsed", "parsed", "raw"]
    assert [r.ok for r in rows] == [True, True, True, True, True, False, True, True]
    assert rows[0].topics == ["a", "1", "null", "[object Object]"]
    assert rows[0].sentiment == "positive" and rows[0].toxicity == 0.5
    assert rows[3].summary_text == '{"summary":"x",}' and rows[3].raw == '{"summary":"x",}'
    assert rows[4].summary_text == "" and rows[4].reason is None
    assert rows[6].summary_text == ""


def test_parse_posts_variants(spark):
    vals = ['{"posts":["a"," b ",""]}', 'x {"posts":["c"]} y', '{"items":[1]}', "l1\n\n  l2 ", "null", '{"posts": [1, "d"]}']
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, t string")
    chunk = [r[0] for r in J.with_posts(df, "t", "p", "lines").orderBy("i").select("p").collect()]
    cand = [r[0] for r in J.with_posts(df, "t", "p", "empty").orderBy("i").select("p").collect()]
    assert chunk == [["a", "b"], ["c"], ['{"items":[1]}'], ["l1", "l2"], ["null"], ["1", "d"]]
    assert cand == [["a", "b"], ["c"], [], ["l1", "l2"], ["null"], ["1", "d"]]


def test_parse_array_and_object_with_repair(spark):
    vals = ['["a","b","c","d"]', 'text ["a",\n "b",] end', "[“x”, “y”]", "no array", '["nested ] ok", "z"]', "[1, null]"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, t string")
    arr = [r[0] for r in J.with_string_array(df, "t", "a").orderBy("i").select("a").collect()]
    assert arr == [["a", "b", "c"], ["a", "b"], ["x", "y"], None, ["nested ] ok", "z"], ["1", "null"]]
    objs = ['pre {"ranked":[{"idea":"i"},]} post', "{bad", '{"a":“b”}']
    df2 = spark.createDataFrame([(i, v) for i, v in enumerate(objs)], "i int, t string")
    got = [r[0] for r in J.with_object(df2, "t", "o").orderBy("i").select(F.col("o").cast("string")).collect()]
    assert got == ['{"ranked":[{"idea":"i"}]}', None, '{"a":"b"}']


def test_reply_text_envelopes(spark):
    env = ['{"choices":[{"message":{"content":"hi"}}]}', '{"choices":[{"text":"t2"}]}',
           '{"output":[{"content":[{"text":"a"},"b"]},{"text":"c"},{"content":"d"}]}', '{"output_text":" ot "}',
           '{"output":[],"output_text":"ignored"}', "{}"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(env)], "i int, t string")
    rows = df.orderBy("i").select(J.reply_text("t", "chat"), J.reply_text("t", "responses")).collect()
    assert [r[0] for r in rows] == ["hi", "t2", "", "", "", ""]
    assert [r[1] for r in rows] == ["", "", "abcd", "ot", "", ""]


def test_idea_cascade(spark):
    long_line = "A long plausible idea line that is certainly over thirty characters"
    rows = [
        ('["Idea A — p | w | $1", "guide to X", "Idea A — p | w | $1", "Idea B"]', "s"),  # dup + generic, cap 3 first
        ('["guide one", "Curated two"]', "s"),  # all generic -> originals
        (long_line + "\nshort", "s"),  # loose lines
        ("n/a", "my   summary "),  # fallback
        ("n/a", "  "),  # blank summary -> []
        (None, "failed call"),  # model failure -> fallback
    ]
    df = spark.createDataFrame([(i, r, s) for i, (r, s) in enumerate(rows)], "i int, r string, s string")
    got = [x[0] for x in I.with_ideas(df, "r", "s", "ideas").orderBy("i").select("ideas").collect()]
    assert got[0] == ["Idea A — p | w | $1"]
    assert got[1] == ["guide one", "Curated two"]
    assert got[2] == [long_line]
    assert got[3] == ['Concise solution guide: "my summary" — targeted info product to validate demand.']
    assert got[4] == []
    assert got[5] == ['Concise solution guide: "failed call" — targeted info product to validate demand.']


def test_split_idea(spark):
    df = spark.createDataFrame([("Kit — does x | because y | Suggested: $1,299/site",)], "idea string")
    r = df.select(I.split_idea("idea").alias("s")).first().s
    assert (r.title, r.pitch, r.why, r.price_usd) == ("Kit", "does x", "because y", 1299.0)
