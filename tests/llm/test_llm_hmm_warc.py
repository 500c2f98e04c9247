"""Operators 6 and 10: hidden Markov scores and WARC archives."""

import hashlib
import io
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from postmine.llm import hmm as H
from postmine.llm import warc as W

DOCS = "doc_id bigint, text string, row string, held_out string"


def model(k=3, s=40, seed=1):
    r = np.random.RandomState(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return H.HMM(norm(r.rand(k), 0), norm(r.rand(k), 0), norm(r.rand(k, k), 1), norm(r.rand(s, k), 0))


def brute_log10(m, codes):
    a = m.start * m.emit[codes[0]]
    for c in codes[1:]:
        a = (a @ m.move) * m.emit[c]
    return math.log10(a.sum())


def test_forward_is_exact(monkeypatch):
    m, r = model(), np.random.RandomState(2)
    seqs = [r.randint(0, 40, n) for n in (1, 2, 7, 150, 60, 1, 120)]
    flat, n = np.concatenate(seqs), np.array([len(x) for x in seqs])
    at = np.cumsum(n) - n
    want = [brute_log10(m, x) for x in seqs]
    assert np.allclose(m.log10(flat, at, n), want)
    monkeypatch.setattr(H, "LONG", 3)
    monkeypatch.setattr(H, "SEGMENT", 16)
    assert np.allclose(m.log10(flat, at, n), want)


def test_expected_counts_match_enumeration():
    m, codes = model(2, 4), np.array([0, 3, 1, 1])
    into = H.Expected(2, 4)
    m.expected(codes, np.array([0]), np.array([4]), np.array([True]), into)
    total, move, emit = 0.0, np.zeros((2, 2)), np.zeros((4, 2))
    for path in np.ndindex(2, 2, 2, 2):
        p = m.start[path[0]] * m.emit[0, path[0]]
        for t in range(1, 4):
            p *= m.move[path[t - 1], path[t]] * m.emit[codes[t], path[t]]
        total += p
        for t in range(4):
            emit[codes[t], path[t]] += p
            if t:
                move[path[t - 1], path[t]] += p
    assert np.allclose(into.emit, emit / total) and np.allclose(into.move, move / total) and math.isclose(into.log10, math.log10(total), rel_tol=1e-6)


def hmm_corpus(n=120):
    r = random.Random(4)
    vocab = [[f"{c}{i}" for i in range(30)] for c in "ab"]
    return [(i, " ".join(r.choices(vocab[i % 2], k=r.randint(1, 80)) + (["Rare%d" % i] if i % 5 else [])), "c", "c") for i in range(n)]


def test_scores_and_base(spark):
    rows = hmm_corpus() + [(500, None, "c", "c"), (501, "", "c", "c"), (None, "a1 a2", "c", "c"), (3, "a1 unseen unseen", "c", "c")]
    got = H.scored(spark.createDataFrame(rows, DOCS), states=4, frequent=24, buckets=8, rounds=9).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    toks = [(i, (t or "").lower().split() + [""]) for i, t, *_ in rows]
    c = Counter(w for i, t in toks if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for i, t in toks)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    out = [r for r in got if r.held_out and r.n_tokens > 2]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # two kinds of documents are told apart


def test_probabilities_of_words_sum_to_one(spark):
    """One-word texts over the training words and one unknown word a bucket: all of the mass."""
    rows = hmm_corpus(30)
    d = spark.createDataFrame(rows, DOCS).withColumnRenamed("text", "t")
    from pyspark.sql import functions as F

    d = d.select("doc_id", F.lower("t").cast("binary").alias("_bin"))
    voc = H.vocabulary(d, frequent=10, buckets=4)
    share = (voc.counts + 0.5) / (voc.counts + 0.5).sum()
    m = H.HMM.initial(share, 3)
    assert np.allclose(m.emit.sum(axis=0), 1)
    words = {bytes(r["word"]): r["c"] for r in voc.words.collect()}
    inside = {b: sum(c + 0.5 for w, c in words.items() if w not in voc.frequent and H.buckets_of([w], 4)[0] == b) + 0.5 for b in range(4)}
    assert all(math.isclose(inside[b], voc.counts[len(voc.frequent) + b] + 0.5 * (voc.kinds[b] + 1)) for b in range(4))


def test_every_round_reads_all_rows_until_the_likelihood_stands(spark, monkeypatch):
    """The same model from any split of the rows, after rounds over all of them."""
    rows, seen = hmm_corpus(60), []
    inner = H.train_round

    def counted(model, codes, share):
        new, fit = inner(model, codes, share)
        seen.append((codes.count(), fit))
        return new, fit

    monkeypatch.setattr(H, "train_round", counted)
    got = []
    for parts in (1, 7):
        d = spark.createDataFrame(rows, DOCS).select("doc_id", "text").repartition(parts, "doc_id")
        got.append({r.doc_id: r.score for r in H.scored(d, states=3, frequent=24, buckets=8, rounds=2).collect()})
        train = sum(zlib.crc32(str(i).encode()) % 5 != 1 for i, *_ in rows)
        fits = [f for _, f in seen]
        assert {n for n, _ in seen} == {train} and len(seen) > 2
        assert fits[-1] - fits[-2] < H.TOLERANCE and all(b - a >= H.TOLERANCE for a, b in zip(fits[2:], fits[3:-1]))
        seen.clear()
    assert got[0].keys() == got[1].keys() and np.allclose([got[0][i] for i in got[0]], [got[1][i] for i in got[0]])


def test_hmm_without_training_rows(spark):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    got = H.scored(spark.createDataFrame([(held, "a b", "c", "c")], DOCS), frequent=4, buckets=4, rounds=2).collect()
    assert got[0].n_known == 0 and got[0].train_tokens == 0 and math.isfinite(got[0].score)
    assert H.scored(spark.createDataFrame([], DOCS), frequent=4, buckets=4, rounds=2).count() == 0


# ---- WARC -------------------------------------------------------------------------------------
PAGES = "page_id bigint, url string, html string, path string"


def pages():
    big = "<p>" + "é" * 90 + "</p>"
    return [(1, "http://a/ b\r\nWARC-Type: x", big, "c"), (2, None, big, "c"), (0, "http://c", big, "c"), (3, "u", None, "c"), (4, "u", "", "c"),
            (5, "u", "short", "c"), (6, "u", "short", "c"), (None, "u", big, "c"), (7, "u", "x" * 300_000 + "\r\n\r\n", "c"), (7, "u", "x" * 300_000 + "\r\n\r\n", "c")]


@pytest.mark.parametrize("file_bytes", [1 << 28, 1])
def test_warc_round_trip(spark, file_bytes):
    d = spark.createDataFrame(pages(), PAGES)
    manifest = W.write_warc(d, file_bytes=file_bytes)
    assert manifest.agg({"records": "sum"}).first()[0] == 10
    got = W.read_warc(manifest).collect()
    key = lambda x: (x is None, x or 0)
    first = {}
    for p, _, h, _ in pages():
        first[h or ""] = min(first.get(h or "", key(p)), key(p))
    want = []
    for p, _, h, _ in pages():
        data = (h or "").encode()
        want.append((p, len(data), hashlib.sha256(data).hexdigest()))
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in got if r.page_id is not None) == sorted(w for w in want if w[0] is not None)
    for r in got:
        if r.record_type == "revisit":
            assert r.payload is None and r.payload_bytes >= 100
        else:
            assert hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_digest and r.refers_to is None
    assert sorted((key(r.page_id), r.refers_to) for r in got if r.record_type == "revisit") == [((False, 1), 0), ((False, 2), 0), ((False, 7), 7), ((True, 0), 0)]
    assert W.read_warc(W.write_warc(d.limit(0))).count() == 0


def archive():
    data = b"payload " * 9000
    sha = hashlib.sha256(data).hexdigest()
    return [W.record_bytes("response", W.record_id(i, "k"), "http://x", data, sha, None) for i in range(3)]


def test_reader_blocks_and_gzip_tool_compatibility():
    import gzip

    raw = b"".join(map(W.member, archive()))
    assert gzip.decompress(raw) == b"".join(archive())

    class Drip(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, 7))

    assert [W.page_of(r["id"]) for r in W.read_records(Drip(raw))] == [0, 1, 2]


def test_reader_refuses_damage():
    a = archive()
    raw = b"".join(map(W.member, a))
    bad = [raw[:-9], W.member(a[0].replace(b"payload payload", b"Payload payload", 1)), W.member(a[0] + a[1]), W.member(a[0][:-4]), W.member(b"HTTP/1.1\r\n\r\n"),
           W.member(a[0].replace(b"Content-Length: 72", b"Content-Length: 71", 1))]
    for x in bad:
        with pytest.raises((W.WarcError, zlib.error, KeyError)):
            list(W.read_records(io.BytesIO(x)))
