"""Operators 2 and 9: statistics, decision list, Fourier-feature classifier."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmine.llm import quality_classifier as K
from postmine.llm import quality_rules as Q

DOCS = "doc_id bigint, text string, n_words string, _w string"
LABELS = "doc_id bigint, quality int, toxic int"


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if c[tuple(w[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def corpus(n=240, seed=3):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(900)]
    rows, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        w = r.choices(words, k=r.randint(60, 200)) if good else [x + r.choice("#$&") * 3 for x in r.choices(words, k=r.randint(60, 200))]
        rows.append((i, " ".join(w), "clash", "clash"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_statistics_match_brute_force(spark):
    r = random.Random(1)
    texts = [None, "", " \n\t\x0b\x0c\r ", "one", "a b", "a b c a b c", "x x x x x", "é é é é", "l\nl\n \nl", "#*$%&|<> <b>", "a" * 5000]
    texts += [" ".join(r.choices("ab" if i % 2 else "abcdefghij", k=r.randint(0, 60))) for i in range(40)] + [" ".join(r.choices("abc", k=20_000))]
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOCS)
    got = {x.doc_id: tuple(x[c] for c in Q.BASE) for x in Q.statistics(d).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_rules_are_learned_and_native(spark):
    rows, labels = corpus()
    d, y = spark.createDataFrame(rows + [(900, None, "x", "y"), (None, rows[1][1], "x", "y"), rows[1]], DOCS), spark.createDataFrame(labels + [(1, None, 0), (None, 1, 0)], LABELS)
    x, rules = Q.judged(d, y)
    assert rules.rules and min(rules.precision) >= Q.MIN_PRECISION and "symbol_ratio" in str(rules)
    got = x.collect()
    assert len(got) == len(rows) + 3
    for r in got:
        assert r.kept == (r.doc_id is None or (r.doc_id != 900 and r.doc_id % 3 != 0)), r
    kept = Q.kept_documents(d, y)
    assert kept.columns == d.columns and kept.count() == sum(r.kept for r in got)
    plan = kept._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def plain_covering(rows):
    """Sequential covering in plain Python on binned rows ``(y, prune, {feature: bin})``: same gains, same order of
    ties (first feature, lower threshold, "at least" before "less than")."""
    holds = lambda t, b: b[t[0]] >= t[2] if t[1] else b[t[0]] < t[2]
    rules, rest = [], rows
    bins = {f: max((b[f] for _, _, b in rows), default=0) for f in Q.FEATURES}
    while len(rules) < Q.MAX_RULES:
        terms, grow = [], [r for r in rest if not r[1]]
        while len(terms) < Q.MAX_TERMS:
            p0, n0 = (sum(y == v for y, _, _ in grow) for v in (0, 1))
            if not p0 or not n0:
                break
            best, gain = None, 1e-9
            for f in Q.FEATURES:
                for b in range(1, bins[f] + 1):
                    for above in (True, False):
                        p, n = (sum(y == v and holds((f, above, b), x) for y, _, x in grow) for v in (0, 1))
                        if p and (g := p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))) > gain:
                            best, gain = (f, above, b), g
            if best is None:
                break
            terms.append(best)
            grow = [r for r in grow if holds(best, r[2])]
        options = []
        for k in range(1, len(terms) + 1):
            hit = [y for y, prune, b in rest if prune and all(holds(t, b) for t in terms[:k])]
            if hit:
                p = hit.count(0)
                options.append(((2 * p - len(hit)) / len(hit), -k, p / len(hit), len(hit)))
        if not options:
            break
        _, k, precision, covered = max(options)
        if precision < Q.MIN_PRECISION or covered < Q.MIN_COVERED:
            break
        rules.append((terms[:-k], precision))
        rest = [r for r in rest if not all(holds(t, r[2]) for t in terms[:-k])]
    return rules


def test_learner_equals_plain_covering(spark):
    """Noisy labels, statistics with many equal values and rows that repeat."""
    r = random.Random(12)
    rows, labels = corpus(240, 8)
    labels = [(i, q if r.random() < 0.93 else 1 - q, 0) for i, q, _ in labels]
    d = spark.createDataFrame(rows + rows[:20], DOCS)
    stats = Q.statistics(d)
    y = spark.createDataFrame(labels, LABELS).selectExpr("doc_id AS _l", "quality AS y")
    joined = stats.join(y, stats["doc_id"] == y["_l"]).drop("_l")
    rules = Q.learn(joined)
    x = joined.withColumn("prune", F.expr("pmod(crc32('prune:' || cast(doc_id AS string)), 3) = 0"))
    binned, _ = Q._binned(x)
    plain = plain_covering([(b.y, b.prune, {f: b[f"b_{f}"] for f in Q.FEATURES}) for b in binned.collect()])
    terms = lambda ts: sorted((t.feature, t.above, t.bin) for t in ts)
    want = [sorted((t.feature, t.above, t.bin) for t in Q._tightest([Q.Term(f, a, float(b), b) for f, a, b in ts])) for ts, _ in plain]
    assert rules.rules and [terms(t) for t in rules.rules] == want
    assert all(math.isclose(a, b) for a, (_, b) in zip(rules.precision, plain))


def test_rules_without_labels_or_rows(spark):
    rows, _ = corpus(9)
    none = spark.createDataFrame([], LABELS)
    x, rules = Q.judged(spark.createDataFrame(rows, DOCS), none)
    assert not rules.rules and str(rules) == "keep all" and x.filter("kept").count() == 9
    assert Q.judged(spark.createDataFrame([], DOCS), none)[0].count() == 0


def test_tightest_bound_only():
    t = [Q.Term("words", True, 3.0, 1), Q.Term("words", True, 5.0, 2), Q.Term("words", False, 9.0, 4)]
    assert Q._tightest(t) == [t[1], t[2]]


def test_classifier_on_held_out_rows(spark):
    rows, labels = corpus(300, 5)
    d, y = spark.createDataFrame(rows + [(900, None, "", ""), (901, "", "", ""), (None, "x", "", "")], DOCS), spark.createDataFrame(labels + [(900, None, 0)], LABELS)
    got = {r.doc_id: r for r in K.scored(d, y).collect()}
    assert len(got) == 303 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [r for i, r in got.items() if i is not None and r.held_out and i < 300]
    assert len(held) > 60 and sum(r.predicted == int(r.doc_id % 3 != 0) for r in held) / len(held) > 0.95
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows, labels = corpus(150, 6)
    d = spark.createDataFrame(rows, DOCS)
    import zlib

    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in labels]
    a, b = (sorted(K.scored(d, spark.createDataFrame(x, LABELS)).collect()) for x in (labels, flipped))
    assert all(abs(x.score - y.score) < 1e-9 for x, y in zip(a, b))


def plain_describe(t):
    """The statistics of a text by plain Python over its bytes."""
    w, size = t.split(), sum(len(x) for x in t.split())
    if not w:
        return [0.0] * len(K.FEATURES)
    lines = [x for x in t.split(b"\n") if x.strip()]
    lens, c = [len(x) for x in w], Counter(t)
    mean = size / len(w)
    pairs = list(zip(w, w[1:]))
    kinds = {"digit": b"0123456789", "upper": bytes(range(65, 91))}
    share = lambda cs: sum(c[x] for x in cs) / size
    return [math.log(1 + len(w)), math.log(1 + len(t)), mean, math.sqrt(sum((x - mean) ** 2 for x in lens) / len(w)), len(set(w)) / len(w),
            1 - len(set(pairs)) / len(pairs) if pairs else 0.0, None, 1 - len(set(lines)) / len(lines), math.log(1 + len(w) / len(lines)),
            share(kinds["digit"]), share(kinds["upper"]), None, sum(n for x, n in c.items() if x >= 128) / size,
            -sum(n / len(t) * math.log2(n / len(t)) for n in c.values()), max(Counter(w).values()) / len(w), sum(x > 12 for x in lens) / len(w)]


def test_describe_matches_plain_python():
    r = random.Random(3)
    texts = ["", "  ", "one", "A1 b2\nA1 b2\n\nend.", "é漢 é漢 Straße", "# # $ %", "x" * 30 + " y", " ".join(r.choices("abc de fghijklmnopqrst 12".split(), k=300)), "word " * 100_000]
    for t in texts:
        got, want = K.describe(t.encode()), plain_describe(t.encode())
        assert len(got) == len(want) == len(K.FEATURES)
        assert all(b is None or math.isclose(a, b, abs_tol=1e-12) for a, b in zip(got, want)), (t[:40], got, want)


def test_fit_matches_plain_normal_equations(spark):
    """The map approximates its kernel; weights, levels and scores equal one numpy computation over all rows."""
    r = np.random.RandomState(5)
    x = r.normal(size=(400, len(K.FEATURES)))
    x[:, 3] = 7.0  # a constant statistic
    y = (x[:, 0] + x[:, 1] ** 2 + r.normal(scale=0.3, size=400) > 0.6).astype(float)
    d = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, y double").repartition(5)
    model = K.fit(d, dims=64)
    sd = x.std(axis=0)
    f = K.Fourier(x.mean(axis=0), np.where(sd > 1e-9, sd, 1.0), K.GAMMA, 64)
    z = f.map(x)
    s = np.clip((x - f.mean) / f.sd, -K.CLIP, K.CLIP)
    wide = K.Fourier(f.mean, f.sd, K.GAMMA, 20_000).map(x[:30])[:, :-1]
    kernel = np.exp(-K.GAMMA * ((s[:30, None] - s[None, :30]) ** 2).sum(axis=2))
    assert np.abs(wide @ wide.T - kernel).max() < 0.05
    penalty = np.eye(65) * K.RIDGE * 400 / 64
    penalty[-1, -1] = 0
    w = np.linalg.solve(z.T @ z + penalty, z.T @ y)
    raw = np.clip(z @ w, -0.5, 1.5)
    assert np.allclose(model.raw(x), z @ w, atol=1e-6)
    bins = np.minimum(((raw + 0.5) / 2 * K.SCORE_BINS).astype(int), K.SCORE_BINS - 1)
    used = np.unique(bins)
    levels = K.pool_adjacent([y[bins == b].mean() for b in used], [(bins == b).sum() for b in used])
    assert np.allclose(model.levels, levels, atol=1e-6) and all(a <= b for a, b in zip(levels, levels[1:]))
    want = (1 - K.TIE) * np.interp(raw, [raw[bins == b].mean() for b in used], levels) + K.TIE * (raw + 0.5) / 2
    assert np.allclose(model.score(x), want, atol=1e-6)


@pytest.mark.parametrize("seed", range(4))
def test_isotonic_levels_are_the_best_monotone_ones(seed):
    """Against min-max formula of isotonic regression."""
    r = random.Random(seed)
    m, w = [r.random() for _ in range(12)], [r.randint(1, 5) for _ in range(12)]
    mean = lambda a, b: sum(x * v for x, v in zip(m[a:b], w[a:b])) / sum(w[a:b])
    want = [max(min(mean(a, b) for b in range(i + 1, 13)) for a in range(i + 1)) for i in range(12)]
    assert np.allclose(K.pool_adjacent(m, w), want)


def test_classifier_without_labels(spark):
    rows, _ = corpus(6)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in K.scored(spark.createDataFrame(rows, DOCS), none).collect()} == {0.5}
    assert K.scored(spark.createDataFrame([], DOCS), none).count() == 0


def test_pool_adjacent():
    assert K.pool_adjacent([0.1, 0.4, 0.2, 0.9], [1, 1, 1, 1]) == [0.1, 0.30000000000000004, 0.30000000000000004, 0.9]
