"""Vector code compression (operator 12): product codes, nearest entries by slice and intersect.

A vector of integers is cut into ``parts`` equal consecutive parts; each part position has a codebook of
at most 64 entries, so a set of entries is one 64-bit mask. Per position and dimension the entries'
coordinates are sorted and carry prefix masks: bit set of the first k of them. For a part, the entries
nearest in one coordinate give an initial radius (the least of their distances). In every dimension the
coordinates within the radius are a range of the sorted order, so the entries in it are the exclusive or of
two prefix masks; the masks of all dimensions ANDed leave the entries of a cube around the part. An
entry at most as far as the initial one lies in the cube, so the candidates contain every nearest entry
and the exact squared distances of these few decide, ties to the lower index.

Each round sums parts and counts per (position, entry) in the tasks; Spark adds the sums, of which there
are ``parts * 64``, and the driver keeps the codebooks: a table of fixed size, broadcast to the tasks.

Defined cases: rows whose vector is null or holds null or non-finite components have no code and are
dropped; rows with another number of components than the table's (that of its smallest id) are returned with
null code and error, as are all where that number is no multiple of ``parts``. Null ids come last among the
first entries; repeated ids are ordered by vector, and each row is coded. Fewer than 64 rows give fewer
entries. Null labels are one label. Extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, small_batches, small_join
from .vectors import int_vectors, matrix

PARTS, ENTRIES, ROUNDS = 16, 64, 2
ROWS = 4_096  # parts coded together


class SliceIndex:
    """Codebook of one part position (at most 64 integer entries) with sorted coordinates and prefix masks."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        n, width = self.entries.shape
        bits = np.uint64(1) << np.arange(n, dtype=np.uint64)
        self.order = np.argsort(self.entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.entries, self.order, axis=0)
        self.prefix = np.zeros((n + 1, width), np.uint64)
        self.prefix[1:] = np.bitwise_or.accumulate(bits[self.order], axis=0)

    def _distance(self, x: np.ndarray, e: np.ndarray) -> np.ndarray:
        d = x - self.entries[e]
        return (d * d).sum(axis=1)

    def radius(self, x: np.ndarray) -> np.ndarray:
        """A radius that reaches an entry: the least distance to the entries nearest in one dimension."""
        best, top = None, len(self.entries) - 1
        for d in range(x.shape[1]):
            s = self.sorted[:, d]
            hi = np.minimum(np.searchsorted(s, x[:, d]), top)
            lo = np.maximum(hi - 1, 0)
            near = np.where(np.abs(s[lo] - x[:, d]) <= np.abs(s[hi] - x[:, d]), lo, hi)
            dist = self._distance(x, self.order[near, d])
            best = dist if best is None else np.minimum(best, dist)
        return np.sqrt(best.astype(np.float64)).astype(np.int64) + 1  # no less than the root, however rounded

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Mask of the entries whose coordinates are all within the radius."""
        mask = np.full(len(x), ~np.uint64(0))
        for d in range(x.shape[1]):
            lo = np.searchsorted(self.sorted[:, d], x[:, d] - radius, "left")
            hi = np.searchsorted(self.sorted[:, d], x[:, d] + radius, "right")
            mask &= self.prefix[lo, d] ^ self.prefix[hi, d]
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row (ties to the lower) and its squared distance."""
        mask = self.candidates(x, self.radius(x))
        some = (mask[:, None] >> np.arange(len(self.entries), dtype=np.uint64)) & np.uint64(1)
        row, entry = np.nonzero(some)  # in order of row, then entry
        dist = self._distance(x[row], entry)
        starts = np.searchsorted(row, np.arange(len(x)))
        least = np.minimum.reduceat(dist, starts)
        hit = np.flatnonzero(dist == least[row])
        first = hit[np.searchsorted(row[hit], np.arange(len(x)))]
        return entry[first], least


def _coded(books: list[SliceIndex], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (row x part) and the total squared distance of the rows of a matrix."""
    width = x.shape[1] // len(books)
    codes, error = np.empty((len(x), len(books)), np.int64), np.zeros(len(x), np.int64)
    for lo in range(0, len(x), ROWS):
        for p, book in enumerate(books):
            codes[lo:lo + ROWS, p], d = book.nearest(x[lo:lo + ROWS, p * width:(p + 1) * width])
            error[lo:lo + ROWS] += d
    return codes, error


def _sums(shared, dim: int):
    """Counts and component sums of the parts of each (position, entry) of a task."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [SliceIndex(e) for e in shared.value]
        parts, n, width = len(books), len(books[0].entries), dim // len(books)
        total = np.zeros((parts * n, width + 1), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b, dim)
            slot = _coded(books, x)[0] + np.arange(parts) * n
            np.add.at(total, slot.ravel(), np.concatenate([np.ones((len(x) * parts, 1), np.int64), x.reshape(-1, width)], axis=1))
        used = np.flatnonzero(total[:, 0])
        ends = pa.array(np.arange(0, len(used) * (width + 1) + 1, width + 1, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(total[used].ravel()))], names=["slot", "s"])

    return run


def _codes(shared, dim: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [SliceIndex(e) for e in shared.value]
        for b in batches:
            codes, error = _coded(books, matrix(b, dim)) if b.num_rows else (np.zeros((0, len(books)), np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("label"), pa.array([bytes(c).hex() for c in codes.astype(np.uint8)], pa.string()), pa.array(error)],
                names=["id", "label", "code", "error"])

    return run


def first_books(rows: DataFrame, dim: int, parts: int, entries: int) -> list[np.ndarray]:
    """The parts of the vectors with the smallest ids, ascending; nulls last, repeated ids by vector."""
    top = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    x = np.array([r["v"] for r in top], np.int64).reshape(len(top), parts, dim // parts)
    return [x[:, p] for p in range(parts)]


def refined(rows: DataFrame, books: list[np.ndarray], dim: int) -> list[np.ndarray]:
    """Entries replaced by the floored mean of their parts; unused ones stay."""
    n, width = books[0].shape
    shared = rows.sparkSession.sparkContext.broadcast(books)
    per = rows.select("v").mapInArrow(_sums(shared, dim), "slot int, s array<bigint>")
    total = per.groupBy("slot").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width + 1)]).collect()
    shared.unpersist()
    out = np.stack(books)
    for r in total:
        out[r["slot"] // n, r["slot"] % n] = [r[f"s{i + 1}"] // r["s0"] for i in range(width)]
    return list(out)


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, as decimal integers joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def decoded(codes: list[str], books: list[np.ndarray]) -> np.ndarray:
    """Integer vectors that some codes stand for."""
    at = np.frombuffer(bytes.fromhex("".join(codes)), np.uint8).reshape(len(codes), len(books))
    return np.concatenate([b[at[:, p]] for p, b in enumerate(books)], axis=1)


def compressed(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
               entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """``id, label, code, error`` per row, and the codebooks (one array of entries per part position)."""
    if not 0 < entries <= 64:
        raise ValueError("an entry is a bit of a 64-bit mask: 1 to 64 entries")
    small_batches(df.sparkSession)
    x = int_vectors(df, id_col, vec_col, F.col(label_col), "vector-ints")
    schema = "id bigint, label bigint, code string, error bigint"
    uncoded = lambda rows: rows.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    if x.dim == 0 or x.dim % parts:
        return uncoded(x.rows), []
    fit = x.rows.filter(F.size("v") == x.dim)
    books = first_books(fit, x.dim, parts, entries)
    for _ in range(rounds):
        books = refined(fit, books, x.dim)
    coded = fit.mapInArrow(_codes(df.sparkSession.sparkContext.broadcast(books), x.dim), schema)
    return coded.unionByName(uncoded(x.rows.filter(F.size("v") != x.dim))), books


def code_report(df: DataFrame, **kw) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``."""
    rows, books = compressed(df, **kw)
    rows = scratch(rows, "vector-codes")
    per = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    x = small_join(rows, per, ["label"])
    return x.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle_sql() -> str:
    """DuckDB SQL of the report with the default parameters (by plain comparison with all entries)."""
    def assign(i: int) -> str:
        return (f"q{i} AS (SELECT p.vec_id, p.k, b.e, list_sum(list_transform(p.x, lambda y, j: (y - b.x[j]) * (y - b.x[j])))::BIGINT AS d "
                f"FROM p JOIN b{i} AS b USING (k)), n{i} AS (SELECT vec_id, k, min({{'d': d, 'e': e}}) AS m FROM q{i} GROUP BY vec_id, k)")

    def books(i: int) -> str:
        return (f"b{i + 1} AS (SELECT b.k, b.e, coalesce(y.x, b.x) AS x FROM b{i} AS b LEFT JOIN (SELECT k, e, list(f ORDER BY j) AS x FROM ("
                f"SELECT k, n.m.e AS e, j, floor(sum(p.x[j])::DOUBLE / count(*))::BIGINT AS f FROM n{i} AS n JOIN p USING (vec_id, k), range(1, (SELECT any_value(w) FROM s) + 1) AS g(j) "
                f"GROUP BY k, n.m.e, j) GROUP BY k, e) AS y ON y.k = b.k AND y.e = b.e)")

    steps = [assign(0)]
    for i in range(ROUNDS):
        steps += [books(i), assign(i + 1)]
    last = f"n{ROUNDS}"
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({256} * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT any_value(len(v)) // {PARTS} AS w FROM v),
p AS (SELECT vec_id, k, v[k * w + 1:(k + 1) * w] AS x FROM v, s, range(0, {PARTS}) AS g(k)),
b0 AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS e, x FROM p JOIN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id)),
{", ".join(steps)},
c AS (SELECT vec_id, string_agg(printf('%02x', m.e::INT), '' ORDER BY k) AS code, sum(m.d)::BIGINT AS error FROM {last} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY k, e)) AS h FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM c JOIN v USING (vec_id), h
"""
