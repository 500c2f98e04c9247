"""Operators 5, 7 and 8 against brute force."""

import hashlib
import math
import random
import re

import pytest

from postmine.llm import exact_dedup as X
from postmine.llm import near_dedup as N
from postmine.llm import substring_dedup as S

DOCS = "doc_id bigint, text string, fp string, node string"
WS = re.compile(r"[\x20\x09-\x0D]")


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "c", "c") for i, t in enumerate(texts)], DOCS)


# ---- exact ------------------------------------------------------------------------------------
def exact_brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(WS.sub("", t or ""), []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}


EXACT = ["", None, " ", "a b", "ab", "a\tb ", "b a", "é x", "éx", "x" * 100, "x" * 99 + " x", "long " * 400, "long" * 400, "ba", " "]


@pytest.mark.parametrize("huge", [1 << 20, 7])
def test_exact_groups(spark, huge):
    got = X.exact_dedup(frame(spark, EXACT), huge_bytes=huge, chunk_bytes=16).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in got} == exact_brute(list(enumerate(EXACT)))
    assert all(r.kept == (r.keep_id == r.doc_id) for r in got)


def test_exact_collisions_are_split(spark, monkeypatch):
    monkeypatch.setattr(X, "PRIME", 3)  # nearly every pair of equal length collides
    r = random.Random(2)
    texts = ["".join(r.choices("ab ", k=6)) for _ in range(120)]
    got = X.exact_dedup(frame(spark, texts)).collect()
    assert {x.doc_id: (x.keep_id, x.group_size, x.text_sha256) for x in got} == exact_brute(list(enumerate(texts)))


def test_exact_repeated_rows_null_ids_and_empty(spark):
    d = frame(spark, ["a", "a", "a", "b"], [5, 5, None, None])
    got = X.exact_dedup(d).collect()
    assert sum(r.kept for r in got) == 2 and {r.keep_id for r in got if r.group_size == 3} == {5}
    kept = X.deduplicated(d)
    assert kept.columns == d.columns and sorted(r.text for r in kept.collect()) == ["a", "b"]
    assert X.exact_dedup(d.limit(0)).count() == 0


def test_fingerprints_compose():
    data = bytes(range(256)) * 9
    parts = [data[:100], data[100:101], data[101:]]
    fp = 0
    for p in parts:
        fp = X.combine(fp, X.fingerprint(p), len(p))
    assert fp == X.fingerprint(data)


# ---- near -------------------------------------------------------------------------------------
def near_brute(rows, size, percent=80):
    sets = [(i, N.word_set((t or "").encode(), size)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1:]:
            c = len(a & b)
            if c and 100 * c >= percent * (len(a) + len(b) - c):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (find(i), len(s)) for i, s in sets}


def variants(seed, groups=6, copies=25, words=80):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(150)]
    out = ["", None, "One", "one", "one two", "ONE two", "the the the the", "the the"]
    for _ in range(groups):
        base = r.choices(vocab, k=words)
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randint(0, 9)):
                w[r.randrange(len(w))] = r.choice(vocab)
            out.append(" ".join(w))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("size,rounds", [(2, 2), (2, 0), (1, 1)])
def test_near_components(spark, size, rounds):
    texts = variants(size + rounds)
    got = N.near_duplicates(frame(spark, texts), size=size, star_rounds=rounds).rows.collect()
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in got} == near_brute(list(enumerate(texts)), size)


def test_near_hot_block_split(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_PAIRS", 4)
    texts = variants(9, groups=1, copies=120, words=200)
    got = N.near_duplicates(frame(spark, texts), size=2).rows.collect()
    assert {r.doc_id: r.component_id for r in got} == {k: v[0] for k, v in near_brute(list(enumerate(texts)), 2).items()}


@pytest.mark.parametrize("cell,dense,long,percent,rounds", [(2048, 4, 4096, 80, 0), (16, 0, 4096, 80, 2), (16, 0, 120, 80, 0), (7, 1, 4096, 60, 0)])
def test_near_hot_group_in_cells(spark, monkeypatch, cell, dense, long, percent, rounds):
    """A group of chained copies most of which are linked with few others: whole cells, split cells, sets
    compared in the task, long sets as candidates, another similarity."""
    monkeypatch.setattr(N, "CELL", cell)
    monkeypatch.setattr(N, "DENSE", dense)
    monkeypatch.setattr(N, "LONG_SET", long)
    r = random.Random(cell + dense + long)
    vocab = [f"w{i}" for i in range(400)]
    texts = [" ".join(r.choices(vocab, k=120))]
    for _ in range(110):
        w = r.choice(texts).split()
        for _ in range(r.randint(3, 14) if percent == 80 else r.randint(12, 35)):
            w[r.randrange(len(w))] = r.choice(vocab)
        texts.append(" ".join(w))
    want = near_brute(list(enumerate(texts)), 2, percent)
    got = N.near_duplicates(frame(spark, texts), size=2, percent=percent, star_rounds=rounds).rows.collect()
    assert {x.doc_id: x.component_id for x in got} == {k: v[0] for k, v in want.items()}
    assert 5 < len({v[0] for v in want.values()}) < 105


def test_near_lists_grow_with_the_input(spark, monkeypatch):
    """Unrelated texts of common words share many shingles; few of them may meet, or the families outgrow the input."""
    found, lists = [], N.inverted_lists

    def spy(classes, percent):
        found.append((classes.count(), lists(classes, percent)))
        return found[-1][1]

    monkeypatch.setattr(N, "inverted_lists", spy)
    r = random.Random(21)
    vocab = [f"w{i}" for i in range(120)]
    texts = [" ".join(r.choices(vocab, k=r.randint(100, 300))) for _ in range(800)]
    rows = N.near_duplicates(frame(spark, [*texts, texts[5] + " end"]), size=2).rows.collect()
    n, listed = found[0]
    assert n == 801 and listed.select("node").distinct().count() < 0.2 * n and listed.count() < n
    assert {x.doc_id: x.component_id for x in rows if x.doc_id != x.component_id} == {800: 5}


@pytest.mark.parametrize("percent", [60, 80])
def test_near_links_across_the_border_of_small_sets(spark, percent):
    """Sets of at most K shingles and larger ones: pairs within, beyond and across the border."""
    r = random.Random(percent)
    texts = []
    for n in (60, 76, 77, 78, 79, 90, 95, 96, 97, 98, 99, 100, 115, 120, 121, 122, 150):
        base = [f"b{n}x{i}" for i in range(n)]
        for share in (percent - 1, percent, percent + 1):
            more = [f"m{n}x{share}x{i}" for i in range(n * 100 // share - n)]
            texts += [" ".join(base), " ".join(base + more), " ".join(r.sample(base, -(-n * share // 100)))]
    want = near_brute(list(enumerate(texts)), 1, percent)
    got = N.near_duplicates(frame(spark, texts), size=1, percent=percent).rows.collect()
    assert {x.doc_id: (x.component_id, x.n_shingles) for x in got} == want
    assert 17 < len({v[0] for v in want.values()}) < len(texts)


def test_near_texts_are_cut_before_they_are_joined(spark):
    """Few listed classes: the join reads few texts, and gives each listed class its own."""
    d = spark.range(4000).selectExpr("id % 7 AS _file_key", "id AS _row_index", "cast(concat('text ', id) AS binary) AS _bin")
    nodes = d.filter("_row_index % 400 = 3").selectExpr("_row_index AS node", "_file_key", "_row_index")
    got = N.listed_texts(d, nodes)
    assert {r.node: bytes(r._bin).decode() for r in got.collect()} == {i: f"text {i}" for i in range(3, 4000, 400)}
    bits = spark.sparkContext.broadcast(N._bitmap(nodes.selectExpr("xxhash64(_file_key, _row_index) AS h"), 1 << 16))
    passed = d.selectExpr("xxhash64(_file_key, _row_index) AS h").mapInArrow(N._listed(bits), "h bigint").count()
    assert 10 <= passed < 40


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_keys_of_ranges(percent):
    """The chance that no range agrees, and the keys against a plain version."""
    ranges = N.key_ranges(percent)
    assert (1 - (percent / 100) ** N.DEEP) ** ranges <= N.TAIL and N.key_ranges(100) == 1
    r = random.Random(percent)
    x = sorted(r.randrange(-(1 << 63), 1 << 63) for _ in range(3 * ranges))
    group = lambda v: ((v + (1 << 63)) >> 32) * ranges >> 32
    plain = [(g, tuple([v for v in x if group(v) == g][:N.DEEP])) for g in sorted({group(v) for v in x})]
    y = sorted([v for v in x if v not in plain[0][1]] + [x[-1] - 1])
    other = [(g, tuple([v for v in y if group(v) == g][:N.DEEP])) for g in sorted({group(v) for v in y})]
    with N.np.errstate(over="ignore"):
        a, b = N.range_keys(N.np.array(x), ranges).tolist(), N.range_keys(N.np.array(y), ranges).tolist()
    assert len(a) == len(plain) and len(set(a)) == len(a)
    assert len(set(a) & set(b)) == len(set(plain) & set(other)) > 0


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_limits_follow_the_similarity(percent):
    """Binomial tails beyond the limits."""
    j, k = percent / 100, N.K
    tail = sum(math.comb(k, i) * j**i * (1 - j) ** (k - i) for i in range(N.shared_values(percent)))
    p = (1 - j) / 2
    bits = sum(math.comb(N.RANGES, i) * p**i * (1 - p) ** (N.RANGES - i) for i in range(N.most_bits(percent) + 1, N.RANGES + 1))
    assert tail <= N.TAIL and bits <= N.TAIL * 1.001


def test_near_very_long_texts(spark):
    r = random.Random(3)
    w = [f"w{r.randrange(5000)}" for _ in range(60_000)]
    v = list(w)
    for i in range(0, len(v), 70):
        v[i] = "changed"
    texts = [" ".join(w), " ".join(v), " ".join(w[:30_000]), "short text", None]
    got = N.near_duplicates(frame(spark, texts), size=5).rows.collect()
    assert {x.doc_id: x.component_id for x in got} == {k: c[0] for k, c in near_brute(list(enumerate(texts)), 5).items()}
    assert got and {x.component_id for x in got if x.doc_id in (0, 1)} == {0}


def test_near_repeated_rows_and_empty(spark):
    d = frame(spark, ["a b c d e f", "a b c d e f", "A b c d e f", "", ""], [4, 4, None, 7, 8])
    kept = N.representatives(d)
    assert kept.columns == d.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == [(4, "a b c d e f"), (7, ""), (8, "")]
    assert N.near_duplicates(d.limit(0)).rows.count() == 0


# ---- repeated passages ------------------------------------------------------------------------
def spans_brute(rows, window):
    first, out = {}, {}
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    key = lambda i: (i is None, i or 0)
    for i, w in docs:
        for a in range(len(w) - window + 1):
            k = tuple(w[a:a + window])
            first[k] = min(first.get(k, key(i)), key(i))
    for i, w in docs:
        gone = set()
        for a in range(len(w) - window + 1):
            if first[tuple(w[a:a + window])] < key(i):
                gone |= set(range(a, a + window))
        out.setdefault(i, []).append((len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return out


def passages(seed):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(9 if seed % 2 else 60)]
    shared = [r.choices(vocab, k=r.randint(8, 40)) for _ in range(5)]
    texts = ["", None, "x " * 40, "x " * 41, "short"]
    for _ in range(60):
        w = []
        for _ in range(r.randint(1, 5)):
            p = r.choice(shared) if r.random() < 0.5 else r.choices(vocab, k=r.randint(1, 20))
            a, b = sorted((r.randint(0, len(p)), r.randint(0, len(p))))
            w += p if r.random() < 0.6 else p[a:b]
        texts.append(" ".join(w))
    return texts + texts[10:14]


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_match_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_REQUESTS", 3)
    texts = passages(seed)
    got = S.without_repeats(frame(spark, texts), window=10, gram=6).collect()
    want = spans_brute(list(enumerate(texts)), 10)
    assert {r.doc_id: [(r.n_words, r.n_removed, r.kept_sha256)] for r in got} == want
    assert any(r.n_removed for r in got)


def test_passages_with_null_and_equal_ids(spark):
    p = " ".join(f"p{i}" for i in range(70))
    texts, ids = [p + " a", "b " + p, p + " c", "d " + p], [3, 3, None, None]
    got = S.without_repeats(frame(spark, texts, ids)).collect()
    want = spans_brute(list(zip(ids, texts)), 50)
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept_sha256))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    assert S.without_repeats(frame(spark, texts).limit(0)).count() == 0
