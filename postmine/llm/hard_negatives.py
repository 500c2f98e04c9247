"""Hard-negative mining (operator 13): exact integer scores by a residue number system, then windows.

Scores are inner products of integer vectors. The component matrices are reduced modulo a few small
primes to residues around zero, multiplied in float32 (each partial sum stays below 2**24, where float32 is
exact), reduced again, and the signed score is put together by the Chinese remainder theorem in mixed
radix. How many primes are needed follows from the largest component of the table.

Anchors are a stated query set, held against all rows in blocks: blocks of ``ANCHORS`` anchors, each one
broadcast (at most ``ANCHOR_BYTES``) and multiplied with every row where Spark reads it. First each task keeps
its best rows of the anchor's label, at most ``positives`` an anchor; a window over what the tasks kept gives
the positives. Then each task keeps, per anchor and positive, its best ``negatives`` rows of other labels within
the score window, and a second window gives the result. What a task keeps is bounded by the block,
whatever the number of rows, ties or copies; nothing else is cut.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part, nor do
rows with another number of components than the table's (that of its smallest id). Rows with the anchor's
id are never its positives or negatives; other repeated rows count as often as they occur; an anchor that repeats
as a whole is one anchor. Null ids are no anchors and come last in ties. Extra columns are ignored; an empty
table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import indexed, scratch, small_batches
from .vectors import int_vectors, matrix

ANCHORS = 8_192  # of a block
ANCHOR_BYTES = 64 << 20  # of a block's components
TILE_ROWS, TILE_ANCHORS = 1_000, 1_024  # scored at a time
POSITIVES, NEGATIVES = 5, 3
LEAST, MOST = 50, 95  # percent of the positive's score
EXACT = 1 << 24  # float32 holds every integer up to here
DIMS = 1_024  # summed in float32 at a time
NULL_ID = np.iinfo(np.int64).max


def small_primes(bound: int, top: int = 2 * math.isqrt(EXACT // DIMS)) -> list[int]:
    """Odd primes, largest first, whose product exceeds ``2 * bound``. With residues of at most half a prime,
    ``DIMS`` products add up to less than ``EXACT``."""
    found, product, n = [], 1, top - 1 | 1
    while not found or product <= 2 * bound:
        n -= 2
        if n < 3:
            raise ValueError("scores too large for small primes")
        if all(n % q for q in range(3, math.isqrt(n) + 1, 2)):
            found.append(n)
            product *= n
    if product >= 1 << 63:
        raise ValueError("scores beyond 64-bit integers")
    return found


class Residues:
    """An integer matrix in residues around zero, one float32 matrix per prime."""

    def __init__(self, x: np.ndarray, primes: list[int]):
        self.primes = primes
        self.of = [((x + p // 2) % p - p // 2).astype(np.float32) for p in primes]

    def rows(self, lo: int, hi: int) -> Residues:
        part = object.__new__(Residues)
        part.primes, part.of = self.primes, [r[lo:hi] for r in self.of]
        return part


def scores(a: Residues, b: Residues) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with all rows of ``b``: multiply per prime, then Garner's
    mixed radix digits, the last wrap around giving the sign."""
    digits, product, total = [], 1, None
    for i, p in enumerate(a.primes):
        x, y = a.of[i], b.of[i]
        r = np.zeros((len(x), len(y)), np.int32)
        for lo in range(0, x.shape[1], DIMS):
            r += (x[:, lo:lo + DIMS] @ y[:, lo:lo + DIMS].T).astype(np.int32) % p
        r %= p
        # the digit of p: what is left of the residue after the lower digits, over their primes
        for q, d in zip(a.primes, digits):
            r = (r - d) * pow(q, -1, p) % p
        digits.append(r)
        part = r.astype(np.int64) * product
        total = part if total is None else total + part
        product *= p
    total[total > product // 2] -= product
    return total


def best_rows(group: np.ndarray, score: np.ndarray, ident: np.ndarray, keep: int) -> np.ndarray:
    """Positions of the first ``keep`` of each group by score down, then id."""
    order = np.lexsort((ident, -score, group))
    g = group[order]
    new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(new, np.diff(np.concatenate([new, [len(g)]])))
    return order[rank < keep]


class _Kept:
    """The best rows of each group so far; holds at most ``keep`` a group and one round of new ones."""

    def __init__(self, keep: int, room: int):
        self.keep, self.room, self.parts, self.size = keep, room, [], 0

    def add(self, group, score, ident) -> None:
        if len(group):
            i = best_rows(group, score, ident, self.keep)
            self.parts.append((group[i], score[i], ident[i]))
            self.size += len(i)
            if self.size > 2 * self.room:
                self.settle()

    def settle(self):
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        x = [np.concatenate(c) for c in zip(*self.parts)]
        i = best_rows(*x, self.keep)
        self.parts = [tuple(c[i] for c in x)]
        self.size = len(i)
        return self.parts[0]


def _tiles(batches: Iterable[pa.RecordBatch], anchors: Residues, dim: int):
    """Scores of tiles: first anchor of the tile, its scores, and the ids and labels of the rows."""
    for b in batches:
        ids = b.column("id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
        labels = b.column("label").to_numpy(zero_copy_only=False)
        x = matrix(b, dim)
        for lo in range(0, len(x), TILE_ROWS):
            rows = Residues(x[lo:lo + TILE_ROWS], anchors.primes)
            for at in range(0, len(anchors.of[0]), TILE_ANCHORS):
                yield at, scores(anchors.rows(at, at + TILE_ANCHORS), rows), ids[lo:lo + TILE_ROWS], labels[lo:lo + TILE_ROWS]


def _found(kept: _Kept) -> pa.RecordBatch:
    group, score, ident = kept.settle()
    return pa.RecordBatch.from_arrays([pa.array(group), pa.array(score), pa.array(ident, mask=ident == NULL_ID)], names=["g", "score", "other"])


def _positives(block, dim: int, primes: list[int], keep: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, v = block.value
        anchors, kept = Residues(v, primes), _Kept(keep, keep * len(ids))
        for at, s, row_ids, row_labels in _tiles(batches, anchors, dim):
            some = slice(at, at + len(s))
            a, r = np.nonzero((labels[some, None] == row_labels) & (ids[some, None] != row_ids))
            kept.add(a + at, s[a, r], row_ids[r])
        yield _found(kept)

    return run


def _negatives(block, dim: int, primes: list[int], windows, keep: int, least: int, most: int):
    """``windows``: per anchor of the block its positives' scores in order, and how many there are."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, v = block.value
        wanted, n = windows.value
        anchors, kept = Residues(v, primes), _Kept(keep, keep * int(n.sum()))
        for at, s, row_ids, row_labels in _tiles(batches, anchors, dim):
            some = slice(at, at + len(s))
            other = (labels[some, None] != row_labels) & (ids[some, None] != row_ids)
            low = np.where(n[some] > 0, wanted[some].min(axis=1, where=np.arange(wanted.shape[1]) < n[some, None], initial=np.iinfo(np.int64).max >> 8), 0)
            a, r = np.nonzero(other & (100 * s >= least * low[:, None]))
            x = s[a, r]
            for p in range(wanted.shape[1]):
                w = wanted[some][a, p]
                fits = np.flatnonzero((n[some][a] > p) & (least * w <= 100 * x) & (100 * x <= most * w))
                kept.add((a[fits] + at) * wanted.shape[1] + p, x[fits], row_ids[r[fits]])
        yield _found(kept)

    return run


def _ranked(found: DataFrame, keep: int) -> DataFrame:
    """The first ``keep`` of each group over all tasks, with their rank."""
    w = Window.partitionBy("g").orderBy(F.col("score").desc(), F.col("other").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def hard_negatives(df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                   label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST,
                   block: int = ANCHORS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``. ``is_anchor`` is a condition
    on the column ``id``; ``label`` an expression in place of the label column."""
    spark = df.sparkSession
    sc = spark.sparkContext
    small_batches(spark)
    x = int_vectors(df, id_col, vec_col, F.col(label_col) if label is None else label, "negative-ints", labelled=True)
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if x.dim == 0:
        return spark.createDataFrame([], schema)
    rows = x.rows.filter(F.size("v") == x.dim)
    primes = small_primes(x.dim * x.largest * x.largest)
    block = max(1, min(block, ANCHOR_BYTES // (8 * x.dim)))
    anchors = indexed(rows.filter(is_anchor).distinct(), ["id", "label", "v"], "negative-anchors")
    total, out = anchors.count(), None
    for lo in range(0, total, block):
        part = anchors.filter((F.col("_idx") >= lo) & (F.col("_idx") < lo + block)).orderBy("_idx").toArrow().combine_chunks().to_batches()[0]
        ids = part.column("id").to_numpy()
        shared = sc.broadcast((ids, part.column("label").to_numpy(), matrix(part, x.dim)))
        near = _ranked(rows.mapInArrow(_positives(shared, x.dim, primes, positives), "g bigint, score bigint, other bigint"), positives)
        near = scratch(near, "negative-positives")
        wanted, n = np.zeros((len(ids), positives), np.int64), np.zeros(len(ids), np.int64)
        for r in near.select("g", "rank", "score").toArrow().to_pylist():  # at most ``positives`` an anchor of the block
            wanted[r["g"], r["rank"] - 1] = r["score"]
            n[r["g"]] += 1
        windows = sc.broadcast((wanted, n))
        hard = _ranked(rows.mapInArrow(_negatives(shared, x.dim, primes, windows, negatives, least, most), "g bigint, score bigint, other bigint"), negatives)
        hard = hard.select((F.col("g") % positives + 1).cast("int").alias("p"), F.floor(F.col("g") / positives).cast("bigint").alias("a"),
                           "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
        near = near.select(F.col("g").alias("a"), F.col("rank").alias("p"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
        names = anchors.select((F.col("_idx") - lo).alias("a"), F.col("id").alias("anchor_id"))
        found = scratch(hard.join(near, ["a", "p"]).join(names, "a").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
        shared.unpersist()
        windows.unpersist()
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def oracle_sql(anchors: str = "vec_id % 50 = 0", label: str = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END") -> str:
    """DuckDB SQL of the default parameters: all scores, then two numberings."""
    return f"""
WITH v AS (SELECT vec_id, {label} AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
      FROM (SELECT * FROM v WHERE {anchors}) AS a JOIN v AS b ON a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {LEAST} * p.score <= 100 * s.score AND 100 * s.score <= {MOST} * p.score)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id))::INT AS rank,
       negative_id, positive_score, negative_score
FROM n QUALIFY rank <= {NEGATIVES}
"""
