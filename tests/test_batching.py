"""Properties of the batch plan, the chunker and size packing."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from postmine.operators import batching as B
from postmine.operators import dedup as U

# Batch sizes of a static page by number of posts: ten first, then threes for the other two rounds, then
# the rest; below ten, three threes and the rest.
SIZES = {1: [1], 2: [2], 3: [3], 4: [3, 1], 6: [3, 3], 8: [3, 3, 2], 9: [3, 3, 3], 10: [10], 11: [10, 1], 13: [10, 3],
         14: [10, 3, 1], 16: [10, 3, 3], 17: [10, 3, 3, 1], 25: [10, 3, 3, 9], 40: [10, 3, 3, 24]}


def _sizes(planned):
    got = {}
    for r in planned.orderBy("page_url", "seq").collect():
        got.setdefault(r.page_url, []).append(r.batch_id)
    for ids in got.values():
        assert ids == sorted(ids) and ids[0] == 0 and set(ids) == set(range(max(ids) + 1))  # in order, without a gap
    return {k: [v.count(b) for b in range(max(v) + 1)] for k, v in got.items()}


def test_batch_plan_sizes(spark):
    df = spark.createDataFrame([(f"p{n}", i, f"post {i}") for n in SIZES for i in range(n)], "page_url string, seq long, post string")
    assert _sizes(B.plan_batches(U.distinct_posts(df))) == {f"p{n}": s for n, s in SIZES.items()}


def test_batch_plan_offset_and_max_batches(spark):
    df = spark.createDataFrame([("p", i, f"x{i}") for i in range(35)], "page_url string, seq long, post string")
    got = B.plan_batches(df, offset=10)
    assert _sizes(got) == {"p": SIZES[25]} and got.agg({"seq": "min"}).first()[0] == 10
    assert B.plan_batches(df, max_batches=2).count() == 13


def test_large_offset_keeps_the_group_limit(spark):
    df = spark.createDataFrame([("p", i, f"x{i}") for i in range(2100)], "page_url string, seq long, post string")
    got = B.plan_batches(df, offset=2000)
    assert _sizes(got) == {"p": [10, 3, 3, 84]}
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_chunks_cover_the_text_and_overlap(spark):
    size, overlap = 12, 3
    texts = {n: "".join(chr(97 + (n * 7 + j) % 26) for j in range(n)) for n in (0, 1, 11, 12, 13, 20, 21, 22, 40, 99)}
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    got = {}
    for r in B.chunk_text(df, "text", size, overlap, keep=["id"]).orderBy("id", "chunk_no").collect():
        got.setdefault(r.id, []).append((r.start, r.chunk))
    for n, chunks in got.items():
        assert chunks[0][0] == 0 and chunks[-1][0] + len(chunks[-1][1]) == n
        assert all(texts[n][a:a + len(c)] == c for a, c in chunks)
        for (a, c), (a2, _) in zip(chunks, chunks[1:]):
            assert len(c) == size and a + len(c) - a2 == overlap
    assert set(got) == set(texts)


def test_packing_is_greedy_and_complete(spark):
    r = random.Random(3)
    pages = {p: [r.choice([1, 300, 2500, 5000, 9999, 10000, 12000]) for _ in range(n)] for p, n in (("a", 3), ("b", 150), ("c", 1))}
    rows = [(p, i * 3_000_000_000, "x" * n) for p, ls in pages.items() for i, n in enumerate(ls)]
    df = spark.createDataFrame(rows, "page_url string, pos long, block string")
    got = {}
    for x in B.pack_batches(df, subpage=1 << 60).orderBy("page_url", "pos").collect():
        got.setdefault(x.page_url, []).append((x.cand_batch, x.batch_pos, len(x.block)))
    for p, ls in pages.items():
        batches = {}
        for b, at, n in got[p]:
            batches.setdefault(b, []).append(n)
            assert at == len(batches[b])
        assert [n for b in sorted(batches) for n in batches[b]] == ls and sorted(batches) == list(range(len(batches)))
        for b, ns in batches.items():
            assert sum(ns) <= 10000 or len(ns) == 1
            if b + 1 in batches:  # the next block would not have fitted
                assert sum(ns) + batches[b + 1][0] > 10000


def test_packing_sub_pages_and_requests(spark):
    df = spark.createDataFrame([("p", i, "x") for i in range(130)], "page_url string, pos long, block string")
    packed = B.pack_batches(df, subpage=100)
    assert sorted((r.cand_batch, r["count"]) for r in packed.groupBy("cand_batch").count().collect()) == [(0, 100), (1, 30)]
    req = B.batch_requests_items(B.pack_batches(df))
    assert sorted((r.request_no, r.n_items) for r in req.collect()) == [(0, 50), (1, 50), (2, 30)]


def test_packing_borders_do_not_depend_on_ids_or_ranges(spark, monkeypatch):
    """The fold of the whole page, beyond position 100,000, with sparse positions and over many ranges."""
    r = random.Random(5)
    sizes = [0, 0, 1, 40, 900, 2500, 5000, 9999, 10000, 10001, 12000]
    pages = {"dense": [(99_900 + i, r.choice(sizes[:5])) for i in range(300)], "sparse": [(i * 70_001, r.choice(sizes)) for i in range(200)],
             "tiny": [(i, 1) for i in range(120)], "empty": [(100_000 + i, 0) for i in range(30)], "big": [(3, 12000), (100_001, 0), (200_002, 0), (300_003, 5)]}
    want = []
    for page, blocks in pages.items():
        batch = size = at = 0
        for pos, n in blocks:
            if at and size + n > 10000:
                batch, size, at = batch + 1, 0, 0
            size, at = size + n, at + 1
            want.append((page, pos, batch, at))
    df = spark.createDataFrame([(p, pos, "x" * n) for p, ls in pages.items() for pos, n in ls], "page_url string, pos long, block string")
    for bits, fan in ((B.RANGE_BITS, B.FAN), (4, 3), (0, 7)):  # one range a page, a tree of them, a range a block
        monkeypatch.setattr(B, "RANGE_BITS", bits)
        got = B.pack_batches(df, fan=fan).select("page_url", "pos", "cand_batch", "batch_pos").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_packing_keeps_every_row(spark):
    """Rows without a position, with equal ones, without a page or a text, and clashing columns."""
    rows = [("p", 1, "a" * 4000, "x"), ("p", 1, "b" * 7000, "y"), ("p", None, "c" * 100, "z"), ("p", 2, None, "w"), (None, 5, "d", "v"), ("p", 1, "a" * 4000, "x")]
    df = spark.createDataFrame(rows, "page_url string, pos long, block string, _page string").withColumn("_size", F.lit(1)).withColumn("c0", F.lit(2))
    x = B.pack_batches(df)
    got = x.collect()
    assert x.columns == [*df.columns, "cand_batch", "batch_pos"] and len(got) == len(rows)
    assert sorted((r.page_url, r.pos or 0, r.block or "", r._page, r._size, r.c0) for r in got) == sorted((p or "", i or 0, b or "", e, 1, 2) for p, i, b, e in rows)
    batches = {}
    for r in got:
        batches.setdefault((r.page_url, r.cand_batch), []).append((r.batch_pos, len(r.block or "")))
    for b in batches.values():
        assert sorted(i for i, _ in b) == list(range(1, len(b) + 1)) and sum(n for _, n in b) <= 10000
    assert B.pack_batches(df.limit(0)).count() == 0


def test_range_functions_compose(monkeypatch):
    """The function of two ranges is that of their blocks; any entry leads to the state of a plain fold."""
    r = random.Random(8)
    for case in range(60):
        limit = r.choice([5, 20, 100])
        lens = np.array([r.choice([0, 0, 1, 2, 3, limit // 2, limit, limit + 3]) for _ in range(r.randint(2, 40))])
        steps = lambda x: next(B._summary(limit)([pd.DataFrame({"_page": "p", "_part": 0, "_sub": 0, "_len": x})]))[["low", "n", "size", "at"]].to_numpy(np.int64).T
        cuts = sorted({0, len(lens), *r.sample(range(1, len(lens)), min(3, len(lens) - 1))})
        f = None
        for a, b in zip(cuts, cuts[1:]):
            f = steps(lens[a:b]) if f is None else B.compose(tuple(f), tuple(steps(lens[a:b])))
        for size, at in [(-1, 0), *((s, 3) for s in range(limit + 2))]:
            low, n, more, blocks = f
            k = int(np.searchsorted(-low, -size, "right")) if size >= 0 else 0
            got = (n[k], more[k], blocks[k]) if n[k] else (0, size + more[k], at + blocks[k])
            batch, s, c = 0, size, at
            for x in lens:
                if s < 0 or s + x > limit:
                    batch, s, c = batch + 1, 0, 0
                s, c = s + x, c + 1
            assert tuple(got) == (batch, s, c), (case, size)
            no, places, state = B.place(lens, limit, 0, size, at)
            assert state == (batch, s, c) and no[-1] == batch and places[-1] == c


def test_store_keeps_every_reason_and_payload_every_idea(spark):
    from postmine.operators.idea_store import idea_events, idea_store, rank_payload
    from postmine.operators.rank import rank_native

    rows = [("p", 0, i, f"post {i}", "positive", [f"t{i % 7}"], f"reason {i}", ["one idea", f"idea {i % 45}"]) for i in range(150)]
    posts = spark.createDataFrame(rows, "page_url string, batch_id int, seq long, post string, sentiment string, topics array<string>, reason string, ideas array<string>")
    st = idea_store(idea_events(posts))
    one = st.filter("idea = 'one idea'").first()
    assert (one.cnt, one.sentiment_sum, one.n_reasons, len(one.reasons)) == (150, 150, 150, 150)
    assert one.reasons[:2] == ["reason 0", "reason 1"] and one.topics == [f"t{i}" for i in range(7)] and one.examples == ["post 0", "post 1", "post 2"]
    assert st.count() == 46 and rank_native(st).count() == 46
    assert sorted((r.payload_no, r.n_ideas) for r in rank_payload(st).collect()) == [(0, 30), (1, 16)]


def test_distinct_posts_first_occurrence(spark):
    df = spark.createDataFrame([("p", 3, " a "), ("p", 1, "a"), ("p", 2, "b"), ("q", 5, "a"), ("p", 4, "  ")],
                               "page_url string, seq long, post string")
    got = sorted((r.page_url, r.post, r.seq, r.n_copies) for r in U.distinct_posts(df).collect())
    assert got == [("p", "a", 1, 2), ("p", "b", 2, 1), ("q", "a", 5, 1)]
