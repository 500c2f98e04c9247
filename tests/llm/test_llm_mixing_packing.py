"""Operators 3 and 4: Poisson replication and packing."""

import math
import random
import zlib

import numpy as np
import pytest

from postmine.llm import mixing as M
from postmine.llm import packing as P
from postmine.llm.queries import tokenizer_path

DOCS = "doc_id bigint, text string, source string, _mix string, length string"


def docs(spark, n=600):
    rows = [(i, "x" * (10 + i % 7), "big" if i % 3 else f"s{i % 4}", "a", "b") for i in range(n)]
    return spark.createDataFrame(rows + [(None, "null id", None, "a", "b"), (n, None, "empty", "a", "b"), rows[0], rows[0]], DOCS)


def test_mix_meets_target_weights(spark):
    d = docs(spark, 3000)
    x = M.replicate(d).select("source", "text", "__mix.*").collect()
    mass = {}
    for r in x:
        mass[r.source] = mass.get(r.source, 0) + len(r.text or "")
    total = d.selectExpr("sum(length(text))").first()[0]
    big = sorted(mass[s] for s in ("big", "s0", "s1", "s2", "s3"))
    assert "empty" not in mass and max(big) < 1.3 * total / 6 and min(big) > 0.7 * total / 6
    assert [r.key for r in x] != sorted(r.key for r in x) or len(x) < 2
    again = M.replicate(d.drop("_mix")).select("source", "text", "_mix.*").collect()
    assert sorted(map(str, x)) == sorted(map(str, again))


def test_mix_given_weights_and_edges(spark):
    d = docs(spark)
    w = spark.createDataFrame([("big", 3.0), ("s0", 0.0), ("nowhere", 5.0)], "source string, weight double")
    got = M.replicate(d, w)
    assert {(r.source, r._mix) for r in got.collect()} == {("big", "a")} and got.columns == [*d.columns, "__mix"]
    rates = {r.source: r.rate for r in M.rates(d, w).collect()}
    assert rates["big"] > 1 and rates[None] == 0 and rates["empty"] == 0
    assert M.replicate(d.limit(0)).count() == 0
    same = M.replicate(spark.createDataFrame([(1, "t", "a", "", "")] * 50, DOCS), epochs=4.0).select("__mix.copies").distinct().collect()
    assert len(same) <= 1  # repeated rows share their number


def test_mix_of_a_tiny_source_and_a_very_long_text(spark):
    """A source of one short document beside a hot one is repeated as often as its rate says, without a cap."""
    rows = [(1, "x", "tiny", "", ""), (2, "y" * 300_000, "hot", "", ""), (3, "z" * 700_000, "hot", "", "")]
    got = M.replicate(spark.createDataFrame(rows, DOCS))
    n = got.filter("source = 'tiny'").count()
    rate = 1_000_001 / 2
    assert abs(n - rate) < 7 * math.sqrt(rate)


@pytest.mark.parametrize("rate", [0.05, 1.0, 7.3, 900.0])
def test_distribution_function(spark, rate):
    r = M.distribution(spark.createDataFrame([("a", 1, rate)], "source string, mass bigint, rate double")).first()
    log = [k * math.log(rate) - rate - math.lgamma(k + 1) for k in range(r.first, r.first + len(r.cdf))]
    assert np.allclose(np.cumsum(np.exp(log)), r.cdf, atol=1e-9) and abs(r.cdf[-1] - 1) < 1e-12


def lengths(seed, n, cap):
    r = random.Random(seed)
    return [min(cap, max(1, int(r.lognormvariate(5, 1.2)))) for _ in range(n)]


@pytest.mark.parametrize("seed,n,cap", [(1, 0, 64), (2, 1, 64), (3, 500, 64), (4, 3000, 1024), (5, 2000, 16)])
def test_plan_is_valid_and_tight(seed, n, cap):
    ls = lengths(seed, n, cap)
    counts = {s: ls.count(s) for s in set(ls)}
    placed, bins = P.plan(counts, cap, 32, max(2, cap // 8))
    used = {}
    for s, runs in placed.items():
        assert sum(k for k, _, _ in runs) == counts[s]
        for k, first, off in runs:
            for i in range(k):
                used.setdefault(first + i, []).append((off, s))
    for parts in used.values():
        at = 0
        for off, s in sorted(parts):
            assert off == at
            at += s
        assert at <= cap
    best_fit = P.Runs(cap)
    for s in sorted(counts, reverse=True):
        best_fit.best_fit(s, counts[s])
    assert len(used) <= max(best_fit.next * 1.01, best_fit.next + 2)


def test_one_size_holds_a_third():
    placed, bins = P.plan({400: 1000, 300: 700, 200: 900, 100: 400, 7: 50})
    assert sum(k for r in placed.values() for k, _, _ in r) == 3050
    assert bins <= 831  # sizes are multiples of 100, so 1,000 tokens of a sequence can be used


def test_words_with_and_without_marks_are_encoded_once(monkeypatch):
    """Ids of the tokenizer itself, of texts in several slices and through a full cache; letters known from one
    chunk are not encoded again with other marks behind them."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    r = random.Random(4)
    words = ["".join(r.choices("abcdefgéñß×÷Ωж1_", k=r.randint(1, 8))) for _ in range(60)] + ["it", "don", "s", "ll", "T"]
    marks = ["", ".", ",", "'", "''", "'s", "'S.", "...", "%$", "]", "[\\]^_`", "-x", "\"", "’", "—", "!a!", "<", "|>", "1."]
    texts = ["".join(r.choice([" ", " ", "  ", "\n", "", "\t"]) + r.choice(words) + r.choice(marks) for _ in range(80)) for _ in range(60)]
    texts = [x.replace("<|", "<") for x in texts]
    for limit in (P.ChunkIds.LIMIT, 50):
        monkeypatch.setattr(P.ChunkIds, "LIMIT", limit)
        ids_of = P.ChunkIds(t)
        got = [x for k in range(0, len(texts), 7) for x in ids_of.ids(texts[k:k + 7])]
        assert got == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    monkeypatch.undo()
    ids_of, encoded = P.ChunkIds(t), []
    lines = ids_of._lines
    monkeypatch.setattr(ids_of, "_lines", lambda chunks: encoded.extend(chunks) or lines(chunks))
    ids_of.ids(["one word. one word"])
    ids_of.ids(["a word, a (word) one; word? one... word!"])
    assert encoded.count(" word") == 1 and not any(c in (" word,", " one...", " word!") for c in encoded)


def test_letters_digits_and_marks_are_looked_up_apart(monkeypatch):
    """Ids of the tokenizer itself for every kind of neighbours, and what is remembered has a bound."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    ids_of, encoded = P.ChunkIds(t), []
    lines = ids_of._lines
    monkeypatch.setattr(ids_of, "_lines", lambda chunks: encoded.extend(chunks) or lines(chunks))
    ids_of.ids(["a word1 word22", "(word333) word4444word", "x.word"])
    assert encoded.count(" word") == 1 and encoded.count("word") == 1 and not any("word1" in c or "word22" in c for c in encoded)
    r = random.Random(6)
    alphabet = ["a", "Z", "é", "×", "÷", "ж", "漢", "e\u0301", "1", "٣", "½", "'", "'s", "'ll", "’", ".", "_", "\x7f", "\x00", "\x1c", "\x85", " ", "  ", "\n", "\r\n", "\t", "\x0b", "\xa0", "\u3000", "\u200b", "😀", "<"]
    texts = ["".join(r.choices(r.choice([alphabet, [c for c in alphabet if c not in ("\x85", "\xa0", "\u3000")]]), k=r.choice([0, 1, 2, 4, 40]))) for _ in range(1500)] + ["y" * 500, " " * 300]
    monkeypatch.setattr(P.ChunkIds, "LIMIT", 200)
    ids_of = P.ChunkIds(t)
    for k in range(0, len(texts), 5):
        part = texts[k:k + 5]
        assert ids_of.ids(part) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in part]
        assert len(ids_of.at) <= 200 + 5 * 80 and max(map(len, ids_of.at), default=0) <= 64


def test_little_is_remembered_between_tasks(monkeypatch):
    """A process that waits, or serves other steps, holds only the frequent chunks; ids stay right."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    r = random.Random(8)
    monkeypatch.setattr(P.ChunkIds, "KEPT", 300)
    ids_of = P.ChunkIds(Tokenizer.from_file(tokenizer_path()))
    monkeypatch.setattr(P, "chunk_ids", lambda path: ids_of)
    run = P._pieces(tokenizer_path(), 1024, 2, True)
    for task in range(3):
        texts = [" ".join(["the", "of"] + ["".join(r.choices("abcdefgh", k=7)) for _ in range(90)]) for _ in range(40)]
        batch = pa.RecordBatch.from_arrays([pa.array([0] * 40), pa.array(range(40)), pa.array(range(40)), pa.array(texts)], names=["_file_key", "_row_index", "doc_id", "_t"])
        got = [bytes(x) for t in run(iter([batch.slice(0, 20), batch.slice(20)])) for x in t.column("ids").to_pylist()]
        assert got == [np.array(ids_of.tokenizer.encode(x, add_special_tokens=False).ids + [2], "<u4").tobytes() for x in texts]
        assert len(ids_of.at) == len(ids_of.ends) == 300 and b" of" in ids_of.at and len(ids_of.known) < 300 * 10


def test_packed_documents(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    r = random.Random(9)
    texts = ["", None, " ", "  a  b\n\n c\t", "don't we'll it's", "x" * 3000, "é𝄞 " * 900, "a\x1cb\x85c 　 d", "<|endoftext|> a <|endoftext|>", "12 345,67!"]
    texts += [" ".join("".join(r.choices("abcdeé ,.", k=6)) for _ in range(r.randint(1, 900))) for _ in range(60)]
    d = spark.createDataFrame([(i, x, "s", "c", "c") for i, x in enumerate(texts)] + [(3, texts[3], "s", "c", "c"), (None, "null", "s", "c", "c")], DOCS)
    got = P.packed_documents(d, tokenizer_path(), keep_ids=True)
    rows = got.collect()
    by, seqs = {}, {}
    for x in rows:
        by.setdefault(x.doc_id, []).append(x)
        seqs.setdefault(x.sequence_id, []).append((x.offset, x.length, bytes(x.ids)))
        assert zlib.crc32(bytes(x.ids)) == x.ids_crc32
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        parts = sorted(by[i], key=lambda x: x.piece)
        if i == 3:
            assert len(parts) == 2
            continue
        assert [(x.start, x.length) for x in parts] == P.cut(len(ids), 1024)
        assert b"".join(bytes(x.ids) for x in parts) == np.array(ids, "<u4").tobytes()
    assert len(by[None]) == 1
    for s in P.sequences(got).collect():
        at = 0
        for off, n, ids in sorted(seqs[s.sequence_id]):
            assert off == at
            at += n
        assert at <= 1024 and bytes(s.ids) == b"".join(i for _, _, i in sorted(seqs[s.sequence_id]))
    assert P.packed_documents(d.limit(0), tokenizer_path()).count() == 0
