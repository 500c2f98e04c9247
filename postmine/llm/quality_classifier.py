"""Quality classifier (operator 9): random Fourier features, ridge regression, isotonic calibration.

A document becomes a vector of statistics of its whole text. Random Fourier features approximate a
Gaussian kernel over the standardised vector; each task sums its part of the normal equations (one
fixed-size matrix), the parts are added by matrix row, and the driver solves one ridge system of
``DIMS + 1`` unknowns. Pool-adjacent-violators over a fixed grid of score bins, counted by Spark,
turns ridge scores into probabilities. Labels are learned only where crc32(doc_id) mod 3 is not 1.

Defined cases: null or empty text has the statistics of no words and gets a score like any other;
rows without label, with a null label or a null doc_id teach nothing (a null ``doc_id`` is not held
out); without any usable label every score is 0.5; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch

FEATURES = ["log_words", "log_chars", "word_length", "word_length_sd", "distinct", "repeat_pairs", "symbols", "dup_lines", "words_per_line",
            "digits", "upper", "punctuation", "non_ascii", "byte_entropy", "top_word", "long_words"]
DIMS, GAMMA, RIDGE, SEED = 256, 0.05, 1e-3, 20
SCORE_BINS, TIE = 2000, 1e-3
CLIP = 6.0  # standardised statistics beyond this many deviations count as this many
_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_DIGITS, _UPPER, _PUNCT = (bytes(c for c in range(256) if chr(c) in s) for s in ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "!\"'(),-./:;?[]_`{}~"))


def describe(text: bytes) -> list[float]:
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    lengths = np.fromiter(map(len, words), np.float64, n)
    total = lengths.sum()
    distinct = set(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    p = counts[counts > 0] / chars
    low = counts[:128]
    share = lambda cs: float(sum(low[c] for c in cs)) / total
    common = max(map(words[:64].count, set(words[:64]))) if n <= 64 else None
    if common is None:
        ids = {w: i for i, w in enumerate(distinct)}
        common = int(np.bincount(np.fromiter(map(ids.__getitem__, words), np.int64, n)).max())
    return [math.log1p(n), math.log1p(chars), total / n, float(lengths.std()), len(distinct) / n,
            1 - len(set(zip(words, words[1:]))) / max(1, n - 1) if n > 1 else 0.0, len(_SYMBOLS.findall(text)) / total,
            1 - len(set(lines)) / len(lines), math.log1p(n / len(lines)), share(_DIGITS), share(_UPPER), share(_PUNCT),
            float(counts[128:].sum()) / total, float(-(p * np.log2(p)).sum()), common / n, float((lengths > 12).mean())]


def _describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = np.array([describe(v.as_py() or b"") for v in b.column("_bin")], np.float64).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists(x)], names=["doc_id", "x"])


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def _matrix(col, width: int) -> np.ndarray:
    return np.asarray(col.flatten(), np.float64).reshape(-1, width)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_bin"))
    return d.mapInArrow(_describe, "doc_id bigint, x array<double>")


def held_out(doc_id: Column | str = "doc_id") -> Column:
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(c.cast("string")), F.lit(3)) == 1, F.lit(False))


@dataclass
class Fourier:
    """Standardisation and random projection; fixed by the seed."""

    mean: np.ndarray
    sd: np.ndarray
    gamma: float = GAMMA
    dims: int = DIMS
    seed: int = SEED

    def map(self, x: np.ndarray) -> np.ndarray:
        r = np.random.RandomState(self.seed)
        w = r.normal(scale=math.sqrt(2 * self.gamma), size=(len(self.mean), self.dims))
        phase = r.uniform(0, 2 * math.pi, self.dims)
        s = np.clip((x - self.mean) / self.sd, -CLIP, CLIP)
        return np.hstack([np.cos(s @ w + phase) * math.sqrt(2 / self.dims), np.ones((len(x), 1))])


def _normal_parts(fourier: Fourier):
    """One matrix per task: rows of [Z'Z | Z'y]."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = fourier.dims + 1
        total = np.zeros((n, n + 1))
        for b in batches:
            x, y = _matrix(b.column("x"), len(fourier.mean)), np.asarray(b.column("y"), np.float64)
            for at in range(0, len(x), 4096):
                z = fourier.map(x[at:at + 4096])
                total[:, :n] += z.T @ z
                total[:, n] += z.T @ y[at:at + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), _lists(total)], names=["i", "v"])

    return run


def _add_rows(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, v in zip(b.column("i").to_pylist(), _matrix(b.column("v"), width)):
                sums[i] = sums[i] + v if i in sums else v.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), _lists(np.array(list(sums.values())))], names=["i", "v"])

    return run


def pool_adjacent(means: list[float], weights: list[float]) -> list[float]:
    """Isotonic regression of means with weights."""
    blocks: list[list[float]] = []
    for m, w in zip(means, weights):
        blocks.append([m, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return [m for m, _, n in blocks for _ in range(int(n))]


@dataclass
class Model:
    fourier: Fourier
    weights: np.ndarray
    centres: np.ndarray | None = None
    levels: np.ndarray | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.fourier.map(x[at:at + 4096]) @ self.weights for at in range(0, len(x), 4096)] or [np.zeros(0)])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability; a small share of the ridge score keeps the order inside a level."""
        r = np.clip(self.raw(x), -0.5, 1.5)
        return (1 - TIE) * np.interp(r, self.centres, self.levels) + TIE * (r + 0.5) / 2


def _raw(model: Model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = np.clip(model.raw(_matrix(b.column("x"), len(model.fourier.mean))), -0.5, 1.5)
            bins = np.minimum(((r + 0.5) / 2 * SCORE_BINS).astype(np.int32), SCORE_BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(r), b.column("y")], names=["bin", "r", "y"])

    return run


def fit(train: DataFrame, gamma: float = GAMMA, dims: int = DIMS, ridge: float = RIDGE) -> Model | None:
    """``train``: ``x, y`` (y 0.0 or 1.0). None if there are no rows."""
    d = len(FEATURES)
    row = train.agg(F.count(F.lit(1)).alias("n"), *[f(F.col("x")[i]).alias(f"{a}{i}") for i in range(d) for a, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not row["n"]:
        return None
    sd = np.array([row[f"s{i}"] for i in range(d)])
    fourier = Fourier(np.array([row[f"m{i}"] for i in range(d)]), np.where(sd > 1e-9, sd, 1.0), gamma, dims)
    parts = train.select("x", "y").mapInArrow(_normal_parts(fourier), "i int, v array<double>")
    rows = parts.repartition("i").mapInArrow(_add_rows(dims + 2), "i int, v array<double>").collect()  # dims + 1 rows
    total = np.zeros((dims + 1, dims + 2))
    for r in rows:
        total[r["i"]] = r["v"]
    penalty = np.eye(dims + 1) * ridge * row["n"] / dims
    penalty[-1, -1] = 0
    model = Model(fourier, np.linalg.lstsq(total[:, :-1] + penalty, total[:, -1], rcond=None)[0])
    bins = (train.select("x", "y").mapInArrow(_raw(model), "bin int, r double, y double")
            .groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("r"), F.avg("y").alias("y")).orderBy("bin").collect())
    model.centres = np.array([b["r"] for b in bins])
    model.levels = np.array(pool_adjacent([b["y"] for b in bins], [float(b["n"]) for b in bins]))
    return model


def _score(model: Model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(_matrix(b.column("x"), len(model.fourier.mean))))], names=["doc_id", "score"])

    return run


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``."""
    x = scratch(features(docs), "classifier-x")
    y = labels.filter(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("bigint").alias("_l"), F.col("quality").cast("double").alias("y"))
    train = scratch(x.filter(~held_out()).join(y, x["doc_id"] == y["_l"]).select("x", "y"), "classifier-train")
    model = fit(train)
    out = x.mapInArrow(_score(model), "doc_id bigint, score double") if model else x.select("doc_id", F.lit(0.5).alias("score"))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
