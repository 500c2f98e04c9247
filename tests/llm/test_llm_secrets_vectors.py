"""Operators 11 to 13 against brute force: secret scans, vector codes, hard negatives."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmine.llm import hard_negatives as N
from postmine.llm import secret_scan as S
from postmine.llm import vector_codes as V

DOCS = "doc_id bigint, text string, spans string, _bin string, kind string"
VECS = "vec_id bigint, embedding array<float>, label int, v string, id string, code string"


# ----------------------------------------------------------------------------------------------
# secret scans
# ----------------------------------------------------------------------------------------------
def brute_spans(text):
    """Spans by Python regular expressions over characters and a fresh count of every window."""
    out = []
    assign = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    for k, c in enumerate(S.CLASSES):
        for m in re.finditer(f"[{c.chars}]+", text):
            run, w = m[0], c.window
            if len(run) < w or any(x in run.lower() for x in S.ALLOW_WORDS) or any(re.fullmatch(p, run) for p in S.ALLOW_PATTERNS):
                continue
            merged = []
            for o in range(len(run) - w + 1):
                h = -sum(n / w * math.log2(n / w) for n in Counter(run[o:o + w]).values())
                if h >= c.bits - 1e-7:
                    if merged and o < merged[-1][1]:
                        merged[-1][1] = o + w
                    else:
                        merged.append([o, o + w])
            out += [(m.start() + a, 3 + k, m.start() + b) for a, b in merged]
    kinds = [*S.BASE_KINDS, *(c.kind for c in S.CLASSES)]
    return [(kinds[k], a, b) for a, k, b in sorted(out)]


def secret_texts(seed=1, n=120):
    r = random.Random(seed)
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    hexa, alnum, b64 = "0123456789abcdef", "abcdefXYZ0123456789ghKLM", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789+/=_-"
    parts = [
        lambda: pick(hexa, r.randint(8, 60)), lambda: pick(alnum, r.randint(10, 50)), lambda: pick(b64, r.randint(20, 90)),
        lambda: f"{r.choice(['Password', 'api_key', 'TOKEN', 'secret', 'passwd', 'apikey'])}{r.choice(['', chr(34)])} {r.choice(':= ')} '{pick(alnum, r.randint(5, 12))}",
        lambda: "AKIA" + pick("ABCDEFGHJK234567", r.randint(5, 20)), lambda: "ordinary words", lambda: "größe Straße 漢字", lambda: "ſecret: abcdefgh1234 toKen=abcdefghi",
        lambda: "123e4567-e89b-12d3-a456-426614174000", lambda: pick(alnum, 20) + "EXAMPLE" + pick(alnum, 20), lambda: "a1" * r.randint(5, 40),
        lambda: pick("ab", 10) + pick(alnum, 30) + "a0" * 30 + pick(alnum, 30)]
    return [r.choice([" ", "\n", "é"]).join(r.choice(parts)() for _ in range(r.randint(0, 8))) for _ in range(n)]


@pytest.mark.parametrize("n,window,symbols", [(0, 5, 3), (4, 5, 3), (5, 5, 1), (500, 20, 4), (2000, 32, 60), (300, 1, 9)])
def test_incremental_counts(n, window, symbols):
    x = np.random.RandomState(n).randint(0, symbols, n).astype(np.uint8)
    g = S.steps(window)
    want = [sum(int(g[c]) for c in Counter(x[i:i + window].tolist()).values()) for i in range(n - window + 1)]
    assert S.window_sums(x, window).tolist() == want


def test_spans_equal_brute_force(monkeypatch):
    texts = secret_texts()
    for size in (S.SLICE, 97):  # also where slices cut candidates
        monkeypatch.setattr(S, "SLICE", size)
        for text, found in zip(texts, S.Scanner().scan([t.encode() for t in texts])):
            to = S.code_points(text.encode(), [x for s in found for x in s[1:]])
            kinds = [*S.BASE_KINDS, *(c.kind for c in S.CLASSES)]
            assert [(kinds[k], to[a], to[b]) for k, a, b in found] == brute_spans(text), text


def test_scan_report_and_edges(spark):
    texts = secret_texts(2, 40)
    long = "word " * 50_000 + "password=abcdefgh12 " + "é" * 1000 + hashlib.sha512(b"x").hexdigest() * 2000
    rows = [(i, t, "a", "b", "c") for i, t in enumerate([*texts, None, "", long])]
    d = spark.createDataFrame([*rows, rows[0], (None, texts[1], "a", "b", "c")], DOCS)
    got = S.report(S.scan_secrets(d)).collect()
    assert len(got) == len(rows) + 2
    name = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[0][0] == by_id[0][1] and by_id[None][0].spans == by_id[1][0].spans
    for i, text, *_ in rows:
        r = by_id[i][0]
        if text is not long:
            spans = brute_spans(text or "")
            base = [s for s in spans if s[0] in S.BASE_KINDS]
            assert r.spans == name(spans) and r.base_sha256 == hashlib.sha256(name(base).encode()).hexdigest()
            assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in spans) for k in S.BASE_KINDS]
        else:
            assert r.n_assign == 1 and r.n_hex == 1 and f"hex:{len(long) - 256_000}:{len(long)}" in r.spans
            assert f"entropy_hex:{len(long) - 256_000}:{len(long)}" in r.spans
    assert S.report(S.scan_secrets(d.limit(0))).count() == 0


def test_allow_list_and_redaction(spark):
    key = "Zx81kQmP02vLtR7bYw5NcJ4h"
    d = spark.createDataFrame([(1, f"use {key} or password=hunter2hunter2 now")], "doc_id bigint, text string")
    kinds = lambda **kw: [s.kind for s in S.scan_secrets(d, **kw).first().spans]
    assert kinds() == ["entropy_alnum", "assign"] and kinds(allow_words=("zx81",)) == ["assign"]
    assert kinds(allow_patterns=(r"Z.*",)) == ["assign"] and kinds(classes=()) == ["assign"]
    found = S.scan_secrets(d).join(d, "doc_id").select(S.redacted(F.col("text"), F.col("spans")).alias("t")).first()
    assert found.t == "use <secret> or <secret> now"


# ----------------------------------------------------------------------------------------------
# vector codes
# ----------------------------------------------------------------------------------------------
@pytest.mark.parametrize("n,width,spread", [(1, 1, 5), (64, 4, 3), (64, 4, 400), (17, 3, 50), (64, 1, 40), (40, 8, 2)])
def test_nearest_entries_are_exact(n, width, spread):
    r = np.random.RandomState(n * width)
    book, x = r.randint(-spread, spread + 1, (n, width)), r.randint(-2 * spread, 2 * spread + 1, (700, width))
    x[:n] = book[:len(x)]
    entry, dist = V.SliceIndex(book).nearest(x)
    d = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (dist == d.min(axis=1)).all() and (entry == d.argmin(axis=1)).all()


def test_few_candidates():
    r = np.random.RandomState(3)
    index = V.SliceIndex(r.randint(-200, 200, (64, 4)))
    x = r.randint(-200, 200, (2000, 4))
    mask = index.candidates(x, index.radius(x))
    some = [bin(int(m)).count("1") for m in mask]
    assert min(some) >= 1 and np.mean(some) < 16  # a fraction of the 64 entries is compared


def brute_codes(rows, parts, entries=64, rounds=2):
    """``rows``: (vec_id, integer list, label), by plain loops."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * w:(p + 1) * w]
    books = [[cut(v, p) for _, v, _ in rows[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in rows:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(groups[i]) for c in zip(*groups[i])] if i in groups else e for i, e in enumerate(books[p])]
    out = []
    for i, v, label in rows:
        best = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
    total = Counter()
    for _, _, e, label in out:
        total[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, total[label], sha) for i, c, e, label in out), key=str)


def vectors(spark, n=150, dim=32, seed=4, bad=True):
    r = np.random.RandomState(seed)
    x = [(i, [float(v) for v in r.randint(-400, 400, dim) / 256], int(r.randint(0, 4)) if i % 9 else None, "a", "b", "c") for i in range(n)]
    x += [x[3], (3, x[5][1], 1, "a", "b", "c"), (None, x[7][1], 2, "a", "b", "c"), (n, x[8][1], 3, "a", "b", "c"), (n + 1, x[8][1], 3, "a", "b", "c")]
    broken = [(n + 2, None, 1), (n + 3, [None] * dim, 1), (n + 4, [float("nan")] * dim, 2), (n + 5, [float("inf")] + [0.0] * (dim - 1), 2), (n + 6, [0.5] * (dim - 1) + [float("-inf")], None)]
    return x, spark.createDataFrame(x + [(*b, "a", "b", "c") for b in broken if bad], VECS)


def scaled(v):
    return [math.floor(256 * float(np.float32(c))) for c in v]


@pytest.mark.parametrize("n", [150, 20])
def test_codes_equal_brute_force(spark, n):
    rows, d = vectors(spark, n)
    got = sorted((tuple(r) for r in V.code_report(d, parts=8).collect()), key=str)
    assert got == brute_codes([(i, scaled(v), label) for i, v, label, *_ in rows], 8)


def test_codes_edges(spark):
    rows, d = vectors(spark, 30)
    assert V.code_report(d.limit(0)).count() == 0 and V.code_report(d.filter("embedding IS NULL")).count() == 0
    odd = spark.createDataFrame([(99, [1.0, 2.0], 1, "", "", ""), (98, [], 1, "", "", "")], VECS)
    got = {r.vec_id: r for r in V.code_report(d.unionByName(odd), parts=8).collect()}
    assert got[99].code is None and got[98].error is None and got[1].code is not None
    assert all(r.code is None for r in V.code_report(d, parts=7).collect())  # 32 components in 7 parts
    same = spark.createDataFrame([(i, [0.25] * 16, 0, "", "", "") for i in range(5)], VECS)
    assert {tuple(r)[1:4] for r in V.code_report(same).collect()} == {("00" * 16, 0, 0)}
    with pytest.raises(Exception, match="larger than"):
        V.code_report(spark.createDataFrame([(1, [1e30] * 16, 0, "", "", "")], VECS)).collect()
    coded, books = V.compressed(d, parts=8)
    r = coded.filter("id = 1").first()
    assert sum((a - b) ** 2 for a, b in zip(scaled(rows[1][1]), V.decoded([r.code], books)[0].tolist())) == r.error


# ----------------------------------------------------------------------------------------------
# hard negatives
# ----------------------------------------------------------------------------------------------
@pytest.mark.parametrize("dim,largest", [(1, 1), (64, 200), (3, 60_000), (1500, 256), (2100, 3000), (5, 1 << 26)])
def test_residue_products_are_exact(dim, largest):
    r = np.random.RandomState(dim)
    a, b = r.randint(-largest, largest + 1, (9, dim)), r.randint(-largest, largest + 1, (11, dim))
    a[0], b[0], b[1] = largest, largest, -largest
    primes = N.small_primes(dim * largest * largest)
    assert math.prod(primes) > 2 * dim * largest**2 and max(primes) < 256
    assert (N.scores(N.Residues(a, primes), N.Residues(b, primes)) == a.astype(np.int64) @ b.T).all()


def test_scores_too_large():
    with pytest.raises(ValueError):
        N.small_primes(1 << 62)


def brute_negatives(rows, is_anchor, positives=5, negatives=3):
    rows = [(i, scaled(v), label) for i, v, label, *_ in rows if label is not None]
    out, done = [], set()
    for i, v, label in rows:
        if i is None or not is_anchor(i) or (i, tuple(v), label) in done:
            continue
        done.add((i, tuple(v), label))
        others = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, m) for j, w, m in rows if j != i)
        pos = [o for o in others if o[3] == label][:positives]
        for s, z, p, _ in pos:
            fits = [o for o in others if o[3] != label and -50 * s <= -100 * o[0] <= -95 * s][:negatives]
            out += [(i, None if z else p, k + 1, None if o[1] else o[2], -s, -o[0]) for k, o in enumerate(fits)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [N.ANCHORS, 7])
def test_negatives_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(N, "TILE_ROWS", 13)
    monkeypatch.setattr(N, "TILE_ANCHORS", 3)
    rows, d = vectors(spark, 120, 8, seed=9)
    # copies of one vector: ties, more of them than are kept
    rows += [(500 + i, rows[40][1], i % 2, "a", "b", "c") for i in range(20)]
    d = d.unionByName(spark.createDataFrame(rows[-20:], VECS)).repartition(5)
    got = N.hard_negatives(d, F.col("id") % 4 == 0, block=block).collect()
    assert got and sorted((tuple(r) for r in got), key=str) == brute_negatives(rows, lambda i: i % 4 == 0)


def test_negatives_edges(spark):
    rows, d = vectors(spark, 30, 8)
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    for x in (d.limit(0), d.filter("embedding IS NULL"), d.filter("vec_id IS NULL"), d.withColumn("label", F.lit(None).cast("int"))):
        got = N.hard_negatives(x, F.col("id") % 2 == 0)
        assert got.columns == cols and got.count() == 0
    odd = spark.createDataFrame([(98, [1.0, 2.0], 1, "", "", ""), (100, [], 1, "", "", "")], VECS)
    one = sorted(map(str, N.hard_negatives(d, F.col("id") == 2).collect()))
    assert one == sorted(map(str, N.hard_negatives(d.unionByName(odd), F.col("id") == 2).collect()))
    zero = spark.createDataFrame([(i, [0.0] * 4, i % 2, "", "", "") for i in range(6)], VECS)
    assert {tuple(r) for r in N.hard_negatives(zero, F.col("id") == 0).collect()} == {(0, p, k + 1, n, 0, 0) for p in (2, 4) for k, n in enumerate((1, 3, 5))}
