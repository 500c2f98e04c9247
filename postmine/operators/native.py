"""Native stand-ins for the model's insight fields (M6-M9) [ours].

They fill ``sentiment``, ``topics``, ``summary`` and ``toxicity`` so a run without a model service
is possible. They do not reproduce a model's judgement and must never be reported as equal to it.
All four are DataFrame jobs on built-in functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse_ws, trim_ws
from ..session import materialize
from .batching import top_k_by

TOKEN_SPLIT = r"[^\p{L}]+"

# Fixed values [ours]: a small sentiment lexicon (word, polarity) across the four test languages.
LEXICON = [
    ("good", 1), ("great", 1), ("love", 1), ("excellent", 1), ("happy", 1), ("best", 1), ("helpful", 1),
    ("bad", -1), ("terrible", -1), ("hate", -1), ("awful", -1), ("worst", -1), ("broken", -1), ("problem", -1),
    ("bon", 1), ("bien", 1), ("mauvais", -1), ("triste", -1),
    ("gut", 1), ("schön", 1), ("schlecht", -1),
    ("bueno", 1), ("feliz", 1), ("malo", -1),
]
SUMMARY_CHARS = 200
COMMON_TERMS = 200_000  # [ours] of which the document frequencies are broadcast; results do not depend on it


def _hits(text, polarity: int):
    """How many whole letter runs of a lower-cased text are lexicon words of one polarity."""
    words = "|".join(sorted({w for w, p in LEXICON if p == polarity}))
    return F.regexp_count(text, F.lit(rf"(?<!\p{{L}})({words})(?!\p{{L}})")).cast("bigint")


def native_sentiment(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """M6: sum of lexicon polarities -> ``positive`` / ``negative`` / ``neutral``. Counted inside the
    row: no tokens leave it and nothing is shuffled."""
    t = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    x = df.select(id_col, _hits(t, 1).alias("_p"), _hits(t, -1).alias("_n"))
    x = x.select(id_col, (F.col("_p") - F.col("_n")).alias("score"), (F.col("_p") + F.col("_n")).alias("n_hits"))
    return x.withColumn(
        "sentiment", F.when(F.col("score") > 0, "positive").when(F.col("score") < 0, "negative").otherwise("neutral")
    )


def native_topics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """M7: top-``k`` TF-IDF terms per document; ties by term. Every document has a row; one without
    letters has no topics.

    Whole texts meet by document, so its terms are counted without another exchange. The document frequencies
    of the commonest terms (at most ``COMMON_TERMS``, which make up most of the (document, term) rows) are broadcast; only the
    rows of the rarer terms meet theirs by term. Each task hands on the best ``k`` rows of a document."""
    by_doc = df.select(id_col, F.col(text_col).alias("_text")).repartition(id_col)
    tf = by_doc.select(id_col, F.explode(F.split(F.lower(F.coalesce(F.col("_text"), F.lit(""))), TOKEN_SPLIT)).alias("token"))
    tf = tf.filter(F.col("token") != "").groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("tf"))
    n_docs = df.select(id_col).distinct().select(F.count(F.lit(1))).scalar()  # scalar subquery
    dfreq = materialize(tf.groupBy("token").agg(F.count(F.lit(1)).alias("dfreq")))
    common = F.col("dfreq") >= _common_from(dfreq)
    x = tf.join(F.broadcast(dfreq.filter(common)), "token", "left")
    score = F.round(F.col("tf") * F.log(n_docs / F.col("dfreq")), 9).alias("score")
    rare = x.filter("dfreq IS NULL").drop("dfreq").join(dfreq.filter(~common), "token")
    best = lambda d: top_k_by(d.select(id_col, "token", score), [id_col], [F.desc("score"), F.asc("token")], k, "rank").drop("rank")
    top = top_k_by(best(x.filter("dfreq IS NOT NULL")).unionByName(best(rare)), [id_col], [F.desc("score"), F.asc("token")], k, "rank")
    top = top.groupBy(id_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("topics")
    )
    return df.select(id_col).join(top, id_col, "left").select(id_col, F.coalesce("topics", F.array().cast("array<string>")).alias("topics"))


def _common_from(dfreq: DataFrame) -> int:
    """The least document frequency, a power of two, that at most ``COMMON_TERMS`` terms have."""
    sizes = dfreq.groupBy(F.floor(F.log2("dfreq")).cast("int").alias("p")).count().collect()  # one row a power of two
    at, terms = 63, 0
    for p, n in sorted(((r["p"], r["count"]) for r in sizes), reverse=True):
        if (terms := terms + n) > COMMON_TERMS:
            break
        at = p
    return 1 << at if at < 63 else (1 << 63) - 1


def native_summary(text, n: int = SUMMARY_CHARS):
    """M8: the leading sentence of the collapsed text (or the text), at most ``n`` chars."""
    c = trim_ws(collapse_ws(F.coalesce(text if not isinstance(text, str) else F.col(text), F.lit(""))))
    lead = F.regexp_extract(c, r"^(.+?[.!?])(\s|$)", 1)
    return F.substring(F.when(lead != "", lead).otherwise(c), 1, n)


def fit_toxicity(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """M9: naive Bayes over the distinct words of a document, in closed form from two grouped counts:
    ``token, weight`` (log odds of the word in a toxic and in a clean document, add-one)."""
    d = labelled.select(id_col, F.col(label_col).cast("int").alias("y"), F.explode(_distinct_words(text_col)).alias("token"))
    n1, n0 = labelled.agg(F.count_if(F.col(label_col) == 1), F.count_if(F.col(label_col) == 0)).first()
    w = d.groupBy("token").agg(F.count_if(F.col("y") == 1).alias("c1"), F.count_if(F.col("y") == 0).alias("c0"))
    return w.select("token", (F.log((F.col("c1") + 1) / F.lit(n1 + 2)) - F.log((F.col("c0") + 1) / F.lit(n0 + 2))).alias("weight"))


def _distinct_words(text_col: str):
    return F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), TOKEN_SPLIT)), "")


def native_toxicity(df: DataFrame, model: DataFrame, prior: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """M9: score in (0, 1) of the toxic class: logistic of the mean log odds of the document's known
    words (the mean keeps long texts comparable); 0.5 without any."""
    x = df.select(id_col, F.explode(_distinct_words(text_col)).alias("token")).join(model, "token")
    x = x.groupBy(id_col).agg(F.avg("weight").alias("m"))
    m = F.coalesce(F.col("m"), F.lit(0.0)) + F.lit(prior)
    return df.select(id_col).join(x, id_col, "left").select(id_col, F.round(1 / (1 + F.exp(-m)), 6).alias("toxicity"))
