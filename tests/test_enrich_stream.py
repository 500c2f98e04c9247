"""Model connector with scripted failures (S7-S9), model tasks on the offline client, streams."""

import hashlib

from pyspark.sql import functions as F

import offline_client
from offline_client import OfflineClient, failure_kind, no_sleep, scripted_client
from pyspark import cloudpickle

from postmine.operators import enrich as E
from postmine.operators.requests import analysis_prompt, build_requests

cloudpickle.register_pickle_by_value(offline_client)  # the tasks do not have the test folder


def test_retry_policy_delays():
    p = E.RetryPolicy(5, 20000, 2, jitter_ms=0)
    assert [p.delay_ms(a) - 0 for a in range(5)] == [20000, 40000, 80000, 160000, 320000]
    assert E.is_retryable_error(E.ModelError("x", status=429))
    assert E.is_retryable_error(E.ModelError("socket", code="ECONNRESET"))
    assert E.is_retryable_error(Exception("TypeError: fetch failed"))
    assert not E.is_retryable_error(E.ModelError("400 Bad Request", status=400))


def test_enrich_attempts_and_dead_letters(spark):
    rows = [("p", i, f"post number {i} with some words") for i in range(200)]
    posts = spark.createDataFrame(rows, "page_url string, seq long, post string")
    req = build_requests(posts, "analyze", ["page_url", "seq"], analysis_prompt("post"))
    rep = E.enrich(req, scripted_client, sleep=no_sleep, partitions=4).collect()
    assert len(rep) == 200
    for r in rep:
        kind = failure_kind(r.key)
        if kind == 0:
            assert (r.status, r.attempts) == ("ok", 2)
        elif kind == 1:
            assert (r.status, r.attempts, r.error_code) == ("failed", 6, "ETIMEDOUT")
        elif kind == 2:
            assert (r.status, r.attempts, r.error_status) == ("failed", 1, 400)
        else:
            assert (r.status, r.attempts) == ("ok", 1)
    ok, dead = E.split_failures(spark.createDataFrame(rep))
    assert ok.count() + dead.count() == 200 and dead.count() > 0


def test_a_slow_key_blocks_nobody():
    """Calls overlap, retries wait beside them, results come as they are done, memory is bounded."""
    import threading
    import time

    open_now, most, lock = [0], [0], threading.Lock()
    tries, drawn, done = {}, [0], [0]

    def requests():
        for i in range(60):
            drawn[0] += 1
            assert drawn[0] - done[0] <= 4 + E.WAITING * 4 + 1  # open and waiting ones only
            yield i

    def call(i):
        with lock:
            open_now[0] += 1
            most[0] = max(most[0], open_now[0])
            tries[i] = tries.get(i, 0) + 1
        time.sleep(0.5 if i == 0 else 0.005)
        with lock:
            open_now[0] -= 1
        if i % 10 == 3 and tries[i] < 3:
            raise E.ModelError("busy", status=429)
        if i % 10 == 4:
            raise E.ModelError("bad", status=400)
        return f"r{i}"

    start, got = time.monotonic(), []
    for x in E.run_calls(requests(), call, lambda r: E.RetryPolicy(2, 200, 1, 0), in_flight=4):
        done[0] += 1
        got.append(x)
    wall = time.monotonic() - start
    assert sorted(x[0] for x in got) == list(range(60)) and most[0] == 4 and got[0][0] != 0
    assert wall < 1.2  # one slow call and twelve retries of 0.2 s beside each other, not 0.5 + 12 * 0.2 + 60 * 0.005
    for i, reply, err, attempts in got:
        assert (reply, attempts) == ((None, 1) if i % 10 == 4 else (f"r{i}", 3 if i % 10 == 3 else 1)) and (err is None) == (reply is not None)


def test_a_rate_budget_holds():
    now, starts = [0.0], []
    wait = lambda s: now.__setitem__(0, now[0] + s)
    list(E.run_calls(range(20), lambda i: starts.append(now[0]), lambda r: E.RetryPolicy(0), in_flight=1, rate=10, sleep=wait, clock=lambda: now[0]))
    assert all(b - a > 0.0999 for a, b in zip(starts, starts[1:])) and len(starts) == 20


def test_request_keys_are_stable(spark):
    df = spark.createDataFrame([("p", 7, "x")], "page_url string, seq long, post string")
    k = build_requests(df, "analyze", ["page_url", "seq"], F.col("post")).first().key
    assert k == hashlib.sha256("analyze\u0001p\u00017".encode()).hexdigest()


def test_model_tasks_on_offline_client(spark):
    from postmine.operators import model_tasks as M
    from postmine.operators.idea_store import idea_events, idea_store

    rows = [("p", i, f"Sentence number {i % 40} about tools. More text.") for i in range(120)]
    posts = spark.createDataFrame(rows, "page_url string, seq long, post string")
    req = M.analyze_requests(posts)
    rep = M.call(req, OfflineClient, sleep=no_sleep)
    ins = M.analyze_results(req, rep)
    assert M.dead_letters(req, rep).count() == 0 and ins.count() == 120
    ireq = M.idea_requests(ins.drop("key").join(posts, ["page_url", "seq"]).withColumn("batch_id", F.lit(0)))
    ideas = M.idea_results(ireq, M.call(ireq, OfflineClient, sleep=no_sleep))
    assert ideas.filter(F.size("ideas") == 1).count() == 120
    ev = idea_events(ideas.withColumn("sentiment", F.col("ins.sentiment")).withColumn("topics", F.col("ins.topics"))
                     .withColumn("reason", F.col("ins.reason")))
    st = idea_store(ev)
    assert st.agg(F.sum("cnt")).first()[0] == 120 and st.count() == 40
    rreq = M.rank_requests(st)
    assert rreq.count() == 2  # 30 ideas a request, none lost
    ranked, fallback = M.rank_results(st, rreq, M.call(rreq, OfflineClient, sleep=no_sleep))
    assert ranked.count() == 40 and fallback.count() == 0
    ranked, fallback = M.rank_results(st, rreq, rep.limit(0))
    assert ranked.count() == 0 and fallback.count() == 40


def test_stored_replies_are_not_called_again(spark):
    from postmine.operators import model_tasks as M

    posts = spark.createDataFrame([("p", i, f"post {i}") for i in range(6)], "page_url string, seq long, post string")
    req = M.analyze_requests(posts)
    stored = M.call(req.filter("seq < 4"), OfflineClient, sleep=no_sleep).withColumn("reply", F.lit("stored"))
    rep = M.call(req, OfflineClient, stored, sleep=no_sleep)
    assert sorted(r.reply == "stored" for r in rep.collect()) == [False] * 2 + [True] * 4


def test_empty_analysis_is_an_insight_and_summaries_are_trimmed(spark):
    from postmine.operators import model_tasks as M

    posts = spark.createDataFrame([("p", i, f"post {i}") for i in range(4)], "page_url string, seq long, post string")
    req = M.analyze_requests(posts)
    rep = E.enrich(req, lambda: (lambda key, task, system, prompt: "" if "post 0" in prompt else "  plain words  "), sleep=no_sleep)
    got = {r.seq: r.ins for r in M.analyze_results(req, rep).collect()}
    assert got[0].status == "raw" and got[0].summary_text == "" and got[1].summary_text == "plain words"
    other = build_requests(posts, "rank", ["seq"], F.col("post"))
    assert {r.status for r in E.enrich(other, lambda: (lambda *a: ""), sleep=no_sleep).collect()} == {"failed"}
    envelopes = rep.withColumn("envelope", F.lit('{"output_text": " from envelope "}'))
    assert {r.ins.summary_text for r in M.analyze_results(req, envelopes).collect()} == {"from envelope"}


def _rounds(spark, tmp_path, snapshots):
    from postmine.streaming.stream import SEEN, Release, run_stream

    rel = Release(spark, str(tmp_path / "tables"))
    for r, rows in enumerate(snapshots):
        spark.createDataFrame(rows, SEEN).coalesce(1).write.parquet(str(tmp_path / f"in/r{r}"))
        run_stream(spark.readStream.schema(SEEN).parquet(str(tmp_path / "in/*")), rel.round, str(tmp_path / "ck")).awaitTermination()
    rel.finish()
    return rel


def test_stream_release_equals_batch_plan(spark, tmp_path):
    from postmine.operators.batching import plan_batches
    from postmine.operators.dedup import distinct_posts

    rows = [(f"p{n}", i, f"t{n}-{i}") for n in (2, 5, 9, 10, 11, 14, 25) for i in range(n)]
    rel = _rounds(spark, tmp_path, [rows] * 3)
    posts = spark.createDataFrame(rows, "page_url string, seq long, post string")
    got = {(r.page_url, r.seq): r.batch_id for r in rel.released().collect()}
    assert got == {(r.page_url, r.seq): r.batch_id for r in plan_batches(distinct_posts(posts)).collect()}
    assert {r.dry_rounds for r in rel.pages().collect()} == {2}


def test_stream_release_loses_nothing(spark, tmp_path):
    one = [("one", i, f"a{i}") for i in range(5)]
    grow = [("grow", i, f"g{i}") for i in range(30)]
    rel = _rounds(spark, tmp_path, [one + grow[:2], grow[:12], grow[:12], grow])
    got = {}
    for r in rel.released().collect():
        got.setdefault((r.page_url, r.batch_id), []).append(r.seq)
    # a page of one round releases three posts, its other two are flushed at the end of the input
    assert {k: sorted(v) for k, v in got.items() if k[0] == "one"} == {("one", 0): [0, 1, 2], ("one", 1): [3, 4]}
    # two posts, then ten more; the third round is dry and the last: a fourth snapshot is not read
    assert {k[1]: sorted(v) for k, v in got.items() if k[0] == "grow"} == {0: list(range(10)), 1: [10, 11]}
    assert {r.page_url: (r.rounds, r.dry_rounds, r.done) for r in rel.pages().collect()} == {"one": (1, 0, True), "grow": (3, 1, True)}


def test_seen_posts_with_and_without_room_in_the_filters(spark, tmp_path):
    """Exact with a filter that is full, over rewritten buckets and a replayed epoch; pages without news are not read."""
    import random

    from postmine.streaming.seen import SeenPosts

    r = random.Random(6)
    for bits, epochs in ((64, 2), (1 << 14, 16)):
        store, seen = SeenPosts(spark, str(tmp_path / f"s{bits}"), buckets=4, bits=bits, epochs=epochs), set()
        wrong = 0
        for epoch in range(4 if bits == 64 else 2):
            rows = [(f"p{r.randrange(6)}", f"post {r.randrange(150)}", i) for i in range(120)]
            df = spark.createDataFrame(rows, "page_url string, post string, seq long")
            want = sorted(x for x in rows if x[:2] not in seen)
            for _ in range(2 if epoch == 2 else 1):  # epoch 2 runs twice
                assert sorted(map(tuple, store.new(df, epoch).collect())) == want
            seen |= {x[:2] for x in rows}
            wrong += store.metrics[epoch]["false_positives"]
        assert (wrong > 20) == (bits == 64)
        fresh = spark.createDataFrame([("p1", f"never {i}", 0) for i in range(20)], "page_url string, post string, seq long")
        assert store.new(fresh, 9).count() == 20 and (bits == 64 or store.metrics[9]["buckets_read"] <= 1)


def test_a_failed_epoch_is_invisible_and_its_replay_counts_once(spark, tmp_path):
    from postmine.streaming.stream import SEEN, Release

    def break_down(posts, epoch):
        if epoch == 1 and not state["up"]:
            raise RuntimeError("down")
        posts.write.mode("overwrite").parquet(str(tmp_path / f"handed/epoch={epoch}"))

    state = {"up": False}
    rel = Release(spark, str(tmp_path / "t"), buckets=4, on_release=break_down)
    page = lambda n: spark.createDataFrame([(p, i, f"{p}{i}") for p in "ab" for i in range(n)], SEEN)
    rel.round(page(12), 0)
    try:
        rel.round(page(20), 1)
        raise AssertionError("it should have failed")
    except RuntimeError:
        pass
    assert rel.released().count() == 20 and {r.rounds for r in rel.pages().collect()} == {1}
    state["up"] = True
    rel.round(page(20), 1)
    rel.round(page(21), 2)
    rel.finish()
    got = sorted((r.page_url, r.seq) for r in rel.released().collect())
    assert got == sorted((p, i) for p in "ab" for i in range(21))
    assert spark.read.parquet(str(tmp_path / "handed")).count() == 42
    assert rel.metrics[1] == {"posts_read": 40, "new_found": 16, "released": 6}
    # state of closed pages is one row each, older versions are gone
    assert rel.tables["open"].read(rel.manifest.before(None).get("open", {})).count() == 0
    assert len(rel.tables["pages"].names(rel.tables["pages"].path, "epoch=")) <= 2


def test_incremental_store_equals_the_batch_store(spark, tmp_path):
    from postmine.operators.idea_store import idea_events, idea_store
    from postmine.streaming.store import IncrementalStore
    from postmine.streaming.stream import SEEN, Release

    def ideas(posts):
        return posts.select("page_url", "batch_id", "seq", "post", F.lit("positive").alias("sentiment"), F.array(F.concat(F.lit("t"), (F.col("seq") % 3).cast("string"))).alias("topics"),
                            F.lit("r").alias("reason"), F.array(F.concat(F.lit("idea "), (F.col("seq") % 4).cast("string"))).alias("ideas"))

    st = IncrementalStore(spark, str(tmp_path / "store"), ideas, buckets=4)
    rel = Release(spark, str(tmp_path / "t"), buckets=4, on_release=st)
    for epoch, n in enumerate((12, 15, 30)):
        rel.round(spark.createDataFrame([(p, i, f"{p} post {i}") for p in "ab" for i in range(n)], SEEN), epoch)
        batch = idea_store(idea_events(ideas(rel.released())))
        key = lambda r: (r.page_url, r.batch_id, r.idea)
        assert sorted((tuple(r) for r in st.store().collect()), key=str) == sorted((tuple(r) for r in batch.collect()), key=str)
        totals = {(r.page_url, r.idea): (r.cnt, r.sentiment_sum, r.n_batches, [x.example for x in r.examples]) for r in st.totals().collect()}
        want = {}
        for r in sorted(batch.collect(), key=key):
            c, s, b, e = want.get((r.page_url, r.idea), (0, 0, 0, []))
            want[r.page_url, r.idea] = (c + r.cnt, s + r.sentiment_sum, b + 1, (e + r.examples)[:3])
        assert totals == want


def test_segmented_ranks(spark):
    """Groups larger and smaller than a partition, null keys, ties by the order given."""
    import random

    from postmine.operators.segmented import segment_rank

    r = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 50}" if i % 7 else None, r.randrange(40), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, x int, i int").repartition(4)
    got = {x.i: x.r for x in segment_rank(df, ["k"], [F.desc("x"), F.asc("i")], "r", partitions=7).collect()}
    groups = {}
    for k, x, i in rows:
        groups.setdefault(k, []).append((-x, i))
    assert got == {i: n + 1 for g in groups.values() for n, (_, i) in enumerate(sorted(g))}
    assert segment_rank(df.limit(0), ["k"], [F.asc("i")], "r").count() == 0


def test_replayed_epoch_overwrites(spark, tmp_path):
    from postmine.streaming.stream import SEEN, Release

    rel = Release(spark, str(tmp_path / "t"))
    df = spark.createDataFrame([("p", i, f"x{i}") for i in range(12)], SEEN)
    rel.round(df, 0)
    rel.round(df, 0)
    assert rel.released().count() == 10 and rel.pages().first().rounds == 1


def test_release_keeps_a_text_once_beside_its_keys(spark, tmp_path, monkeypatch):
    """The state that rounds rewrite holds no texts; a text is kept once until its page is closed, over rewritten
    buckets; posts at the same place come by their text."""
    from postmine.streaming import stream
    from postmine.streaming.stream import SEEN, Release

    monkeypatch.setattr(stream, "EPOCHS", 2)
    rel = Release(spark, str(tmp_path / "t"), buckets=1)
    a = [("a", 0, f"t{i:02d}") for i in (7, 3, 11, 0, 5, 9, 1, 10, 2, 8, 4, 6)]
    rounds = [[*a, a[0]], [("b", i, f"b{i}") for i in range(2)], [("c", 0, "c0"), ("c", 1, None)], [*a, ("a", 1, "new")], [("b", 0, "b0"), ("b", 5, "b5")]]
    for epoch, rows in enumerate(rounds):
        rel.round(spark.createDataFrame(rows, SEEN), epoch)
        if epoch == 0:
            assert sorted(r.post for r in rel.released().collect()) == [f"t{i:02d}" for i in range(10)]
            held = rel.tables["open"].read(rel.manifest.before(None)["open"])
            assert held.count() == 12 and "post" not in held.columns
        texts = rel.tables["texts"].read(rel.manifest.before(None)["texts"])
        assert texts.count() == texts.select("page_url", "post").distinct().count()
    rel.finish()
    got = sorted((r.page_url, r.seq, r.post) for r in rel.released().collect())
    assert got == sorted({x for rows in rounds for x in rows if x[2] is not None})
    assert {(r.page_url, r.batch_id) for r in rel.released().collect() if r.post in ("t10", "t11", "new")} == {("a", 1)}
    assert rel.manifest.before(None)["texts"] == {} and len(rel.tables["texts"].names(rel.tables["texts"].path, "epoch=")) <= 2


def test_posts_and_replies_are_cut_to_what_ideas_need(spark):
    """Replies are read before they meet, so no whole text is dealt over tasks; the events are the same."""
    from postmine.functions import ideas as I
    from postmine.operators.idea_store import idea_events, with_example
    from postmine.plans.queries import parsed_replies, planned_posts

    assert set(parsed_replies(spark, "/root/testdata/sf0.001").columns) == {"page_url", "seq", "insight_ok", "sentiment", "topics", "reason", "ideas"}
    assert "post" not in planned_posts(spark, "/root/testdata/sf0.001").columns
    texts = [" " + "x" * 299 + " tail ", "short ", "  ", None]
    df = spark.createDataFrame([("p", 0, i, t, "positive", ["t"], "r", ["an idea"]) for i, t in enumerate(texts)],
                               "page_url string, batch_id int, seq long, post string, sentiment string, topics array<string>, reason string, ideas array<string>")
    rows = sorted(map(str, idea_events(with_example(df)).collect()))
    assert rows == sorted(map(str, idea_events(df).collect())) and len(rows) == 4
    assert sorted(r.example or "" for r in idea_events(df).collect()) == ["", "", "short", "x" * 299 + " "]
    long = "a line of more than thirty characters "
    replies = [None, "", "n/a", '["one", "a guide"]', '["a guide"]', long + "1\n" + long + "2", "[]"]
    r = I.with_ideas(spark.createDataFrame([(i, x, "sum") for i, x in enumerate(replies)], "i int, r string, s string"), "r", "s")
    fb = ['Concise solution guide: "sum" — targeted info product to validate demand.']
    assert [x.ideas for x in r.orderBy("i").collect()] == [fb, fb, fb, ["one"], ["a guide"], [(long + "1").strip(), (long + "2").strip()], fb]


def test_topics_are_the_same_whatever_terms_are_common(spark, monkeypatch):
    """Against a plain computation: no, some or all terms broadcast; repeated, null and empty documents."""
    import math
    import random
    import re
    from collections import Counter

    from postmine.operators import native

    r = random.Random(4)
    letters = "abcdefghij"
    rows = [(r.randrange(30) if i % 9 else None, " ".join("".join(r.choice(letters[: 1 + i % 10]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(12)))) for i in range(60)]
    rows += [(100, None), (101, "1 2 ..."), (102, "Only one")]
    tf = {}
    for d, t in rows:
        tf.setdefault(d, Counter()).update(w for w in re.split(r"[^a-z]+", (t or "").lower()) if w)
    dfreq = Counter(w for c in tf.values() for w in c)
    want = {d: [w for _, w in sorted((-round(n * math.log(len(tf) / dfreq[w]), 9), w) for w, n in c.items())[:5]] for d, c in tf.items() if d is not None}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for common in (0, 8, 10_000):
        monkeypatch.setattr(native, "COMMON_TERMS", common)
        top = native.native_topics(df)
        got = top.collect()
        assert len(got) == len(rows) and {x.doc_id: x.topics for x in got if x.doc_id is not None} == want
        assert all(x.topics == [] for x in got if x.doc_id is None)
    # the rows of terms are not dealt by document and term: the texts meet by document
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [doc_id" in plan


def test_idea_requests_of_cut_inputs_are_the_same(spark):
    """Posts and insights cut before they meet give the prompts and ideas of whole ones, and carry no texts."""
    from postmine.functions.jsonx import with_insight
    from postmine.operators import model_tasks as M

    long = "word \t " * 400
    replies = ['{"summary": "%s", "sentiment": "Positive", "topics": ["a", 1, "c", "d", "e", "f"], "examples": ["x", "y", "z"]}' % ("s " * 900), '{"summary": ""}', "null", "plain " + long, ""]
    ins = with_insight(spark.createDataFrame([("p", i, r) for i, r in enumerate(replies)], "page_url string, seq long, reply string"), "reply", "ins").drop("reply")
    posts = spark.createDataFrame([("p", i, t) for i, t in enumerate([long, "short", "x", None, ' "quoted" '])], "page_url string, seq long, post string")
    whole = M.idea_requests(ins.filter("ins.ok").join(posts, ["page_url", "seq"]))
    cut = M.idea_requests(M.idea_inputs(ins, posts))
    assert cut.columns == ["page_url", "seq", "fallback", "key", "task", "system", "prompt"]
    rows = lambda d: sorted(map(tuple, d.select("seq", "key", "task", "system", "prompt").collect()))
    assert rows(cut) == rows(whole) and len(rows(cut)) == 4
    keys = [r.key for r in whole.orderBy("seq").collect()]
    rep = spark.createDataFrame(list(zip(keys, ['["one", "two"]', "n/a", '["three"]'], ["ok", "ok", "failed"])), "key string, reply string, status string")
    got = [{r.seq: r.ideas for r in M.idea_results(d, rep).collect()} for d in (cut, whole)]
    assert got[0] == got[1] and got[0][0] == ["one", "two"] and got[0][1] == [] and got[0][3][0].startswith("Concise solution guide")


def test_insight_log_roundtrip(spark, tmp_path):
    from postmine.functions.jsonx import with_insight
    from postmine.sources.insight_log import append_insights, log_quality, read_insights

    df = spark.createDataFrame([("u", 1, '{"summary":"s","sentiment":"neutral","topics":["a"],"toxicityScore":0}'),
                                ("u", 2, "{truncated"), ("u", 3, ""), ("u", 4, "null")], "page_url string, seq long, reply string")
    append_insights(with_insight(df, "reply", "ins"), str(tmp_path / "log"))
    log = read_insights(spark, str(tmp_path / "log"))
    q = log_quality(log).first()
    assert (q.n, q.n_raw, q.n_empty_summary, q.n_with_topics) == (3, 2, 1, 1)
    assert read_insights(spark, str(tmp_path / "missing")).count() == 0
    (tmp_path / "array.json").write_text('[{"insight": {"summary": "a"}, "timestamp": "t"},\n {"insight": {"summary": "", "raw": ""}, "timestamp": "u"}]')
    arr = read_insights(spark, str(tmp_path / "array.json")).collect()
    assert [r.insight.summary for r in arr] == ["a", ""] and arr[1].insight.raw == ""
    ts = log.first().timestamp
    assert ts.endswith("Z") and "T" in ts and len(ts) == 24


def test_repeated_and_killed_appends_leave_one_copy(spark, tmp_path):
    from postmine.functions.jsonx import with_insight
    from postmine.sources.insight_log import append_insights, read_insights

    log = tmp_path / "log"
    df = lambda n: with_insight(spark.createDataFrame([("u", i, f'{{"summary":"s{i}"}}') for i in range(n)], "page_url string, seq long, reply string"), "reply", "ins")
    append_insights(df(3), str(log), key="job-1")
    append_insights(df(3), str(log), key="job-1")
    append_insights(df(2), str(log), key=7)
    assert read_insights(spark, str(log)).count() == 5
    (log / "append=8").mkdir()
    (log / "append=8" / "part-0.json").write_text('{"seq": 1}\n')  # killed before its commit
    assert read_insights(spark, str(log)).count() == 5
    append_insights(df(1), str(log), key=8)
    append_insights(df(1), str(log))
    append_insights(df(1), str(log))
    assert read_insights(spark, str(log)).count() == 8


def test_an_array_file_is_read_by_several_tasks(spark, tmp_path):
    import json
    import random

    from postmine.sources.array_log import pieces, records
    from postmine.sources.insight_log import read_insights

    r = random.Random(2)
    texts = ['plain', 'br{ack}ets [in] {text', 'quote \\" and } ]', 'back\\\\', "}}}", '"', "", "é漢 {", '\\"}', "line\nbreak"]
    rows = [{"page_url": r.choice(texts), "seq": i, "timestamp": "t", "insight": {"summary": r.choice(texts), "topics": r.sample(texts, 2), "raw": None}} for i in range(300)]
    shapes = {"one line": json.dumps(rows), "indented": json.dumps(rows, indent=2, ensure_ascii=False), "lines": "\n".join(map(json.dumps, rows)),
              "spaced": " \n[\n" + " ,\n ".join(map(json.dumps, rows)) + "\n]\n"}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        for name, text in shapes.items():
            p = tmp_path / f"{name.replace(' ', '-')}.json"
            p.write_text(text)
            assert pieces(spark, str(p)).select("block").distinct().count() > 5
            got = sorted((x.record, json.loads(x.json)) for x in records(spark, str(p)).collect())
            assert got == list(enumerate(rows)), name
            log = sorted(read_insights(spark, str(p)).collect(), key=lambda x: x.seq)
            assert [(x.page_url, x.insight.summary, x.insight.topics) for x in log] == [(x["page_url"], x["insight"]["summary"], x["insight"]["topics"]) for x in rows], name
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (tmp_path / "empty.json").write_text("[]")
    assert records(spark, str(tmp_path / "empty.json")).count() == 0 and read_insights(spark, str(tmp_path / "empty.json")).count() == 0


def test_stream_round_counts_and_foreach_batch(spark, tmp_path):
    from postmine.streaming.stream import run_stream, stream_distinct, stream_round_counts

    rows = [("p", r, f"post {i}") for r in range(3) for i in range(2 + 2 * r)]  # growing page
    posts = spark.createDataFrame(rows, "page_url string, round int, post string")
    for r in range(3):
        posts.filter(F.col("round") == r).coalesce(1).write.parquet(str(tmp_path / f"in/r{r}"))
    s = spark.readStream.schema(posts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    d = stream_distinct(s)
    counted = {}

    def keep(df, epoch_id):
        counted.update({r["round"]: r.new_found for r in df.collect()})

    q = stream_round_counts(d).writeStream.foreachBatch(keep).outputMode("complete") \
        .option("checkpointLocation", str(tmp_path / "ck1")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = counted
    assert got == {0: 2, 1: 2, 2: 2}

    out = str(tmp_path / "out")

    def handle(df, epoch_id):
        df.withColumn("epoch", F.lit(epoch_id)).write.mode("append").parquet(out)

    run_stream(d, handle, str(tmp_path / "ck2")).awaitTermination()
    assert spark.read.parquet(out).count() == 6


def test_write_report(spark, tmp_path):
    from postmine.operators.rank import ranked_rows, report_document, report_lines, write_report

    reply = ('{"ranked":[{"idea":"A","priority":1,"score":4.2,"estimated_revenue_usd":12345,'
             '"recommended_price_range":"$","go_to_market_channels":["x","y"],"rationale":"r","examples":["e  1"]},'
             '{"idea":"B","score":null}]}')
    rep = spark.createDataFrame([("u", 0, reply)], "page_url string, batch_id int, reply string")
    lines = report_lines(ranked_rows(rep)).orderBy("pos").collect()
    assert lines[0].block == ("\n1. A\nPriority: 1\nScore: 4.20\nEstimated revenue (USD): $12345\nRecommended price range: $\n"
                              "Go-to-market channels: x, y\nRationale: r\nExamples:\n  1. e 1\n---")
    assert lines[1].block == "\n2. B\nScore: 0.00\n---"
    counts = spark.createDataFrame([("u", 0, 2), ("u", 1, 1), ("v", 0, 0)], "page_url string, batch_id int, n_ideas long")
    fallback = spark.createDataFrame([("u", 1, 1, "C")], "page_url string, batch_id int, pos int, idea string")
    write_report(report_document(counts, report_lines(ranked_rows(rep)), fallback), str(tmp_path / "report"))
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*")))
    assert text.startswith("--- Product Ideas (LLM-ranked) ---\n\n1. A\n") and "2. B" in text
    assert text.index("2. B") < text.index("Fallback — listing idea headlines:\n - C\n") < text.index("No product ideas generated")
