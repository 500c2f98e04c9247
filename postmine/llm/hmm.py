"""Hidden Markov language model (operator 6): Baum-Welch over partitions, exact scaled forward scores.

Symbols: the ``FREQUENT`` most frequent training tokens have a code each; every other word belongs to
one of ``BUCKETS`` hash buckets, and inside a bucket its probability is its smoothed share of the
bucket's training count (one unknown word per bucket included). The emission table therefore has a
fixed size, while the counts behind it cover every word: the rare part of a score is a plain sum that
a shuffle join of (document, rare word) with the counts delivers.

Training: tasks run forward-backward on segments of ``SEGMENT`` tokens (whole documents, all segments)
and return expected counts per symbol; Spark adds them by symbol; the driver normalises the fixed-size
table. Every round reads all training rows: ``MIN_ROUNDS`` at least, then as many as it
takes until a round gains less than ``TOLERANCE`` in log10 likelihood per token.
Scoring: the scaled forward recursion over the whole text; long texts multiply scaled transfer matrices
of their segments, which is the same recursion in another order.

Defined cases: null text is empty and has the end token only; a null ``doc_id`` is a training row; rows
repeat as they are; without training rows every word is unknown and the model is uniform; extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_words, scratch

STATES = 8
FREQUENT, BUCKETS = 32_768, 4_096
SEGMENT = 256
BLOCK = 2_048  # segments trained together
HASH_SLOTS = 1 << 20
BINS_PER_OCTAVE = 64  # of the histogram of word counts
MIN_ROUNDS = 10  # rounds that always run
TOLERANCE = 1e-3  # least gain of a further round, log10 likelihood per token
PRIOR = 20.0  # pseudo counts per state, spread like the symbols' overall shares
STAY = 0.95  # initial probability of staying in a state
LONG = 8_192  # tokens from which transfer matrices are used
SEED = 6
SLICE_BYTES = 1 << 20  # texts encoded together
END = b""  # the end token; no word is empty
FLUSH = 150_000  # distinct words a counting task holds before it hands them on


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1, F.lit(False))


def buckets_of(words: list[bytes], buckets: int) -> np.ndarray:
    """Hash bucket of each word."""
    with np.errstate(over="ignore"):
        return (hash_words(b"\n".join(words))[1] % np.uint64(buckets)).astype(np.int64)


# ----------------------------------------------------------------------------------------------
# counts and codes
# ----------------------------------------------------------------------------------------------
def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.binary()), pa.array(c.values(), pa.int64())], names=["word", "c"])

    counts: Counter = Counter()
    for b in batches:
        for v in b.column("_bin"):
            counts.update((v.as_py() or b"").lower().split())
            counts[END] += 1
            if len(counts) > FLUSH:
                yield batch(counts)
                counts = Counter()
    yield batch(counts)


def _with_bucket(buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(buckets_of(b.column("word").to_pylist(), buckets), pa.int32()), b.column("c")], names=["bucket", "c"])

    return run


@dataclass
class Vocabulary:
    words: DataFrame  # word, c
    tokens: int  # N
    distinct: int  # V
    frequent: dict[bytes, int]  # word -> code
    counts: np.ndarray  # training count of each symbol (words, then buckets)
    kinds: np.ndarray  # distinct words of each bucket
    buckets: int

    def base(self, c):
        return (c + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))


def vocabulary(train: DataFrame, frequent: int = FREQUENT, buckets: int = BUCKETS) -> Vocabulary:
    words = scratch(train.select("_bin").mapInArrow(_count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c")), "hmm-words")
    total = words.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    # the words above a count that at most ``frequent`` words reach: from a histogram of fixed size, so
    # no task sends its own candidates to the driver; the end token always has a code of its own
    bin_ = F.floor(F.log2(F.col("c").cast("double")) * BINS_PER_OCTAVE).cast("int")
    held, chosen, least = 1, F.octet_length("word") == 0, None
    for r in sorted(words.groupBy(bin_.alias("b")).count().collect(), key=lambda r: -r["b"]):
        share = (frequent - held) / r["count"]
        if share < 1:  # of the first bin that does not fit, the words whose hash is in a share of its range
            slots = int(share * HASH_SLOTS * (1 - 4 / math.sqrt(max(16, frequent - held))))
            chosen = chosen | ((bin_ == r["b"]) & (F.pmod(F.xxhash64("word"), F.lit(HASH_SLOTS)) < slots))
            break
        held += r["count"]
        least = r["b"]
    if least is not None:
        chosen = chosen | (bin_ >= least)
    top = sorted(words.filter(chosen).collect(), key=lambda r: (len(r["word"]) > 0, -r["c"], bytes(r["word"])))
    codes = {bytes(r["word"]): i for i, r in enumerate(top)}
    codes.setdefault(END, len(codes))
    counts = np.zeros(len(codes) + buckets)
    counts[:len(top)] = [r["c"] for r in top]
    kinds = np.zeros(buckets)
    known = words.sparkSession.sparkContext.broadcast(codes)

    def rare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([w not in known.value for w in b.column("word").to_pylist()], pa.bool_()))

    per = words.mapInArrow(rare, "word binary, c bigint").mapInArrow(_with_bucket(buckets), "bucket int, c bigint")
    for r in per.groupBy("bucket").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("k")).collect():
        counts[len(codes) + r["bucket"]] = r["c"]
        kinds[r["bucket"]] = r["k"]
    return Vocabulary(words, int(total["n"] or 0), int(total["v"]), codes, counts, kinds, buckets)


def _encode(known, buckets: int):
    """Symbol codes of a text (16-bit) and its words without a code, with their number. Texts are handled
    in slices: one buffer is split and hashed, the arrays are then divided by text."""
    entry = pa.struct([("word", pa.binary()), ("bucket", pa.int32()), ("tf", pa.int64())])

    def slice_(b: pa.RecordBatch, at: int, texts: list[bytes], codes: dict) -> pa.RecordBatch:
        data = b"\n".join(texts).lower()
        words = data.split()
        with np.errstate(over="ignore"):
            starts, h = hash_words(data)
        begin = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
        text = np.repeat(np.arange(len(texts)), np.diff(begin))
        got = np.fromiter(map(codes.get, words, repeat(-1)), np.int64, len(words))
        rare = np.flatnonzero(got < 0)
        bucket = (h[rare] % np.uint64(buckets)).astype(np.int64)
        got[rare] = len(codes) + bucket
        out = np.insert(got, begin[1:], codes[END]).astype(np.uint16)
        ends = begin[1:] + np.arange(1, len(texts) + 1)
        # equal rare words of a text are neighbours in this order
        order = np.lexsort((h[rare], text[rare]))
        t, x = text[rare][order], h[rare][order]
        new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (x[1:] != x[:-1])])) if len(t) else np.zeros(0, np.int64)
        tf = np.diff(np.concatenate([new, [len(t)]]))
        first = rare[order][new]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(t[new], minlength=len(texts)))]).astype(np.int32)), pa.StructArray.from_arrays(
            [pa.array([words[i] for i in first.tolist()], pa.binary()), pa.array(bucket[order][new].astype(np.int32)), pa.array(tf)], fields=list(entry)))
        raw = out.tobytes()
        cuts = [0, *(2 * ends).tolist()]
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id").slice(at, len(texts)), b.column("held_out").slice(at, len(texts)), pa.array([raw[i:j] for i, j in zip(cuts, cuts[1:])], pa.binary()), lists],
            names=["doc_id", "held_out", "codes", "rare"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = known.value
        for b in batches:
            at, texts, size = 0, [], 0
            for v in b.column("_bin"):
                texts.append(v.as_py() or b"")
                size += len(texts[-1])
                if size > SLICE_BYTES:
                    yield slice_(b, at, texts, codes)
                    at, texts, size = at + len(texts), [], 0
            if texts:
                yield slice_(b, at, texts, codes)

    return run


# ----------------------------------------------------------------------------------------------
# the model
# ----------------------------------------------------------------------------------------------
@dataclass
class HMM:
    start: np.ndarray  # first state of a document
    resume: np.ndarray  # first state of a later segment (training only)
    move: np.ndarray
    emit: np.ndarray  # symbol x state

    @classmethod
    def initial(cls, share: np.ndarray, states: int = STATES, seed: int = SEED) -> HMM:
        r = np.random.RandomState(seed)
        emit = share[:, None] * (0.3 + 1.4 * r.uniform(size=(len(share), states)))
        move = np.full((states, states), (1 - STAY) / max(1, states - 1))
        np.fill_diagonal(move, STAY if states > 1 else 1.0)
        flat = np.full(states, 1 / states)
        return cls(flat, flat.copy(), move, emit / emit.sum(axis=0))

    def arrays(self) -> tuple[np.ndarray, ...]:
        """What tasks are sent: plain arrays, so workers need no copy of this package."""
        return self.start, self.resume, self.move, self.emit

    def expected(self, flat: np.ndarray, at: np.ndarray, length: np.ndarray, first: np.ndarray, into: Expected) -> None:
        """Forward-backward over segments ``flat[at:at + length]``, longest first. Single precision, one row
        per state: the steps lie one after the other and work along the segments; sums are double."""
        top = int(length[0])
        active = np.searchsorted(-length, -np.arange(1, top + 1), "right")  # segments that have step t
        cut = np.concatenate([[0], np.cumsum(active)])
        step = np.repeat(np.arange(top), active)
        symbols = flat[at[np.arange(cut[-1]) - cut[step]] + step]
        move, back = self.move.T.astype(np.float32), self.move.astype(np.float32)
        seen = np.take(self.emit.T.astype(np.float32), symbols, axis=1)
        alpha, scale = np.empty_like(seen), np.empty(cut[-1], np.float32)
        a = np.where(first, self.start[:, None], self.resume[:, None]).astype(np.float32)
        for t in range(top):
            lo, hi = cut[t], cut[t + 1]
            a = (a if t == 0 else move @ a[:, :hi - lo]) * seen[:, lo:hi]
            scale[lo:hi] = c = a.sum(axis=0)
            a /= c
            alpha[:, lo:hi] = a
        beta, moved = np.ones((len(self.start), len(at)), np.float32), np.zeros_like(self.move)
        for t in range(top - 1, 0, -1):
            lo, hi = cut[t], cut[t + 1]
            alpha[:, lo:hi] *= beta[:, :hi - lo]  # from here on the state probabilities
            v = seen[:, lo:hi] * beta[:, :hi - lo]
            v /= scale[lo:hi]
            moved += alpha[:, cut[t - 1]:cut[t - 1] + hi - lo] @ v.T
            beta[:, :hi - lo] = back @ v
        alpha[:, :cut[1]] *= beta
        into.move += self.move * moved
        into.start += alpha[:, :cut[1]][:, first].sum(axis=1, dtype=np.float64)
        into.resume += alpha[:, :cut[1]][:, ~first].sum(axis=1, dtype=np.float64)
        for k, gamma in enumerate(alpha):
            into.emit[:, k] += np.bincount(symbols, weights=gamma, minlength=len(into.emit))
        into.log10 += float(np.log10(scale).sum(dtype=np.float64))
        into.tokens += int(length.sum())

    def log10(self, flat: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """log10 likelihood of each sequence by the scaled forward recursion."""
        out = np.zeros(len(at))
        for i in np.nonzero(length > LONG)[0]:
            out[i] = self._log10_long(flat[at[i]:at[i] + length[i]])
        order = np.argsort(-length, kind="stable")
        order = order[length[order] <= LONG]
        emit, move = np.ascontiguousarray(self.emit.T), np.ascontiguousarray(self.move.T)
        for lo in range(0, len(order), 2048):
            rows = order[lo:lo + 2048]
            a0, n0 = at[rows], length[rows]
            active = np.searchsorted(-n0, -np.arange(1, int(n0[0]) + 1), "right")
            total, a = np.zeros(len(rows)), np.repeat(self.start[:, None], len(rows), axis=1)
            for t, n in enumerate(active):
                a = (move @ a[:, :n] if t else a) * np.take(emit, flat[a0[:n] + t], axis=1)
                c = a.sum(axis=0)
                total[:n] += np.log10(c)
                a /= c
            out[rows] = total
        return out

    def _log10_long(self, codes: np.ndarray) -> float:
        a = self.start * self.emit[codes[0]]
        total = math.log10(a.sum())
        a = a / a.sum()
        rest = codes[1:]
        whole = len(rest) // SEGMENT
        k = len(self.start)
        for lo in range(0, whole, 1024):
            part = rest[lo * SEGMENT:min(whole, lo + 1024) * SEGMENT].reshape(-1, SEGMENT)
            m, logs = np.tile(np.eye(k), (len(part), 1, 1)), np.zeros(len(part))
            for t in range(SEGMENT):
                m = (m @ self.move) * self.emit[part[:, t]][:, None, :]
                c = m.sum(axis=(1, 2))
                logs += np.log10(c)
                m /= c[:, None, None]
            for x, g in zip(m, logs):
                a = a @ x
                total += g + math.log10(a.sum())
                a = a / a.sum()
        for s in rest[whole * SEGMENT:]:
            a = (a @ self.move) * self.emit[s]
            total += math.log10(a.sum())
            a = a / a.sum()
        return total


class Expected:
    """Expected counts of one task."""

    def __init__(self, states: int, symbols: int):
        self.start, self.resume, self.move = np.zeros(states), np.zeros(states), np.zeros((states, states))
        self.emit, self.log10, self.tokens = np.zeros((symbols, states)), 0.0, 0


# rows of the added table that are not symbols
_START, _RESUME, _SUMS, _MOVE = -1, -2, -3, -10


def _expect(shared, symbols: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = HMM(*shared.value)
        k = len(model.start)
        into = Expected(k, symbols)
        for b in batches:
            parts = [np.frombuffer(v.as_py(), np.uint16) for v in b.column("codes")]
            if not parts:
                continue
            flat = np.concatenate(parts).astype(np.int64)
            n = np.array([len(p) for p in parts])
            begin = np.concatenate([[0], np.cumsum(n)[:-1]])
            per = -(-n // SEGMENT)
            no = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
            at = np.repeat(begin, per) + no * SEGMENT
            length = np.minimum(SEGMENT, np.repeat(begin + n, per) - at)
            order = np.argsort(-length, kind="stable")
            for lo in range(0, len(order), BLOCK):
                o = order[lo:lo + BLOCK]
                model.expected(flat, at[o], length[o], no[o] == 0, into)
        used = np.nonzero(into.emit.any(axis=1))[0]
        ids = np.concatenate([used, [_START, _RESUME, _SUMS], _MOVE - np.arange(k)])
        sums = np.zeros(k)
        sums[:1] = into.log10
        if k > 1:
            sums[1] = into.tokens
        rows = np.vstack([into.emit[used], into.start, into.resume, sums, into.move])
        yield _id_rows(ids, rows)

    return run


def _id_rows(ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32))
    return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))], names=["id", "v"])


def _add(states: int):
    """Adds rows of equal id; a task meets a bounded number of ids."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, total = np.zeros(0, np.int64), np.zeros((0, states))
        for b in batches:
            i = np.concatenate([ids, np.asarray(b.column("id"), np.int64)])
            v = np.vstack([total, np.asarray(b.column("v").flatten()).reshape(-1, states)])
            ids, where = np.unique(i, return_inverse=True)
            total = np.stack([np.bincount(where, weights=v[:, k], minlength=len(ids)) for k in range(states)], axis=1)
        if len(ids):
            yield _id_rows(ids, total)

    return run


def train_round(model: HMM, codes: DataFrame, share: np.ndarray) -> tuple[HMM, float]:
    """One round of Baum-Welch; also the log10 likelihood per token under the old model."""
    sc = codes.sparkSession.sparkContext
    k = len(model.start)
    shared = sc.broadcast(model.arrays())
    parts = codes.select("codes").mapInArrow(_expect(shared, len(share)), "id int, v array<double>")
    table = parts.repartition("id").mapInArrow(_add(k), "id int, v array<double>").toArrow()  # symbols + states + 3 rows
    ids = np.asarray(table.column("id"), np.int64)
    v = np.asarray(table.column("v").combine_chunks().flatten()).reshape(-1, k) if len(ids) else np.zeros((0, k))
    shared.unpersist()
    row = {int(i): x for i, x in zip(ids[ids < 0], v[ids < 0])}
    emit = share[:, None] * PRIOR
    emit = np.repeat(emit, k, axis=1)
    emit[ids[ids >= 0]] += v[ids >= 0]
    zero = np.zeros(k)
    move = np.stack([row.get(_MOVE - i, zero) for i in range(k)]) + 0.5
    start, resume = row.get(_START, zero) + 0.5, row.get(_RESUME, zero) + 0.5
    sums = row.get(_SUMS, zero)
    new = HMM(start / start.sum(), resume / resume.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return new, float(sums[0] / max(1.0, sums[1] if k > 1 else 1.0))


def train(codes: DataFrame, vocab: Vocabulary, states: int = STATES, rounds: int = MIN_ROUNDS, tolerance: float = TOLERANCE) -> HMM:
    """``codes``: the training rows; each round reads all of them. ``rounds`` always run, more follow until a
    round gains less than ``tolerance``."""
    share = (vocab.counts + 0.5) / (vocab.counts + 0.5).sum()
    model, last, r = HMM.initial(share, states), -math.inf, 0
    while True:
        new, fit = train_round(model, codes, share)  # ``fit`` is the likelihood of ``model``
        r += 1
        if r >= rounds and fit - last < tolerance:
            return new
        model, last = new, fit


def _score(shared):
    names = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, base, known = shared.value
        model = HMM(*arrays)
        for b in batches:
            parts = [np.frombuffer(v.as_py(), np.uint16) for v in b.column("codes")]
            if not parts:
                continue
            flat = np.concatenate(parts).astype(np.int64)
            n = np.array([len(p) for p in parts])
            at = np.concatenate([[0], np.cumsum(n)[:-1]])
            sums = [np.add.reduceat(x[flat], at) for x in (known, base)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("held_out"), pa.array(n.astype(np.int64)),
                                              pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(model.log10(flat, at, n))], names=names)

    return run


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, frequent: int = FREQUENT,
           buckets: int = BUCKETS, rounds: int = MIN_ROUNDS) -> DataFrame:
    """Per row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    sc = docs.sparkSession.sparkContext
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_bin")).withColumn("held_out", held_out())
    if frequent + buckets >= 1 << 16:
        raise ValueError("symbols are 16-bit numbers: frequent + buckets must stay below 65,536")
    vocab = vocabulary(d.filter(~F.col("held_out")), frequent, buckets)
    known = sc.broadcast(vocab.frequent)
    rows = d.mapInArrow(_encode(known, buckets), "doc_id bigint, held_out boolean, codes binary, rare array<struct<word:binary,bucket:int,tf:bigint>>")
    rows = scratch(rows.withColumn("row", F.monotonically_increasing_id()), "hmm-codes")
    model = train(rows.filter(~F.col("held_out")), vocab, states, rounds)
    # symbols: a word's own base term and whether it is known; a bucket's words follow by the join
    words = len(vocab.frequent)
    base = np.concatenate([np.log10(vocab.base(vocab.counts[:words])), np.zeros(buckets)])
    is_known = np.concatenate([(vocab.counts[:words] > 0).astype(np.float64), np.zeros(buckets)])
    shared = sc.broadcast((model.arrays(), base, is_known))
    scores = rows.select("row", "doc_id", "held_out", "codes").mapInArrow(
        _score(shared), "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, score double")
    inside = docs.sparkSession.createDataFrame(
        [(i, float(vocab.counts[words + i]), float(vocab.kinds[i])) for i in range(buckets)], "bucket int, bc double, bk double")
    rare = rows.select("row", F.inline("rare")).join(vocab.words, "word", "left").join(F.broadcast(inside), "bucket")  # one row per bucket
    c = F.coalesce(F.col("c"), F.lit(0)).cast("double")
    rare = rare.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("rk"),
        F.sum(F.col("tf") * F.log10((c + 0.5) / F.lit(vocab.tokens + 0.5 * (vocab.distinct + 1)))).alias("rb"),
        F.sum(F.col("tf") * F.log10((c + 0.5) / (F.col("bc") + 0.5 * (F.col("bk") + 1)))).alias("rs"))
    x = scores.join(rare, "row", "left")
    return x.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rk", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(vocab.tokens).cast("bigint").alias("train_tokens"), (F.col("base") + F.coalesce("rb", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rs", F.lit(0.0))).alias("score"))
