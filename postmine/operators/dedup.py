"""De-duplication and set operators.

U1 keeps the first occurrence of each post per page: ``groupBy(page, post).agg(min(seq))`` — a
partial (map-side) aggregation, so a post repeated a billion times costs one row per map task before
the shuffle. No per-page window: arrival order stays in ``seq``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import non_blank, trim_ws


def distinct_posts(posts: DataFrame, page_col: str = "page_url", text_col: str = "post") -> DataFrame:
    """U1 (+F4): trimmed, non-blank, first occurrence per ``(page, post)``; keeps ``seq`` of the
    first copy and the number of copies. Posts need a page and an arrival order (stated as a filter,
    so every consumer of the result shares one de-dup shuffle)."""
    ok = non_blank(text_col) & F.col(page_col).isNotNull() & F.col("seq").isNotNull()
    cleaned = posts.filter(ok).select(page_col, "seq", trim_ws(text_col).alias(text_col))
    return cleaned.groupBy(page_col, text_col).agg(
        F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n_copies")
    )


def union_ordered(*dfs: DataFrame, source_col: str = "source_ord") -> DataFrame:
    """Ordered concatenation; each input gets its position in ``source_col``."""
    tagged = [d.withColumn(source_col, F.lit(i)) for i, d in enumerate(dfs)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def new_posts(posts: DataFrame, seen: DataFrame, page_col: str = "page_url", text_col: str = "post") -> DataFrame:
    """U3 (+J5): posts of this round not seen before on the same page (left anti join)."""
    return posts.join(seen.select(page_col, text_col).distinct(), [page_col, text_col], "left_anti")


def round_counts(posts: DataFrame, page_col: str = "page_url", round_col: str = "round", text_col: str = "post") -> DataFrame:
    """Per page and round, posts collected so far and how many are new.

    A post is new in the first round it appears on its page. ``collected`` is the running number of
    distinct posts, a cumulative sum over the (small) per-page round table.
    """
    first = posts.filter(non_blank(text_col)).groupBy(page_col, text_col).agg(F.min(round_col).alias(round_col))
    new_per_round = first.groupBy(page_col, round_col).agg(F.count(F.lit(1)).alias("new_found"))
    rounds = posts.select(page_col, round_col).distinct()
    t = rounds.join(new_per_round, [page_col, round_col], "left").fillna(0, ["new_found"])
    from pyspark.sql import Window

    w = Window.partitionBy(page_col).orderBy(round_col).rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("collected", F.sum("new_found").over(w).cast("bigint")).withColumn(
        "new_found", F.col("new_found").cast("bigint")
    )
