"""Near-duplicate detection with sketches of one hash function (operator 8).

A document's set is its distinct word shingles, as values of one 64-bit hash; documents with equal sets are
one class. Inverted lists map keys to classes, so that two classes with the similarity asked for share a list:

* Both of at most ``K`` shingles: at least that share of the values of either is common, so by the pigeonhole
  principle one of the ``size - shared + 1`` rarest values of each is. Those are the keys, without any chance of a miss.
* Else: the hash values are cut into equal ranges (32 at 80 %). The key of a range is its ``DEEP`` smallest
  values in the set (all, if there are fewer). The share of pairs at exactly 0.8 that have no key in common is at most
  1.1e-10, as one range agrees with a chance of 0.8 ** 3. A key stands for several shingles, so texts that
  merely use the same words seldom meet, and the lists grow with the input where those of single shingles grew faster.

Classes near the border have keys of both kinds. No list, no number of candidates and no number of partners is
capped.

Only components are asked for, so pairs inside a known component need no look. Star rounds compare
each list with one pivot, then labels are merged. What is still in several components is compared
exhaustively, but not list by list: the open lists with the same largest component are one family, in which
a class stands once, and the classes outside that component are held against all of the family. Families are
dealt over cells of bounded size; a task compares the rows of a cell by their bit signatures (one bit of the
smallest hash in each of 256 ranges) and hands on the pairs that differ in at most ``most_bits`` (at 80 %
a linked pair differs in more with a probability of 1e-10). In a cell where too many pairs pass, as
in a large group of near copies, the sets themselves are compared in the task, and one link to each component is
handed on. So the pairs of a group are never rows of a table; the number of comparisons still grows with the
square of the group's part that the star rounds left alone. Candidates must then pass the estimate from the
union sketch; links are confirmed on the full sets, streamed block by block with the pivot first.

Defined cases: null or empty text has an empty set and is linked with nothing; a text with fewer words
than a shingle has one shingle; null ids never represent a group that has another id; extra columns are
ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_scratch, hash_words, mix64, scratch, stored, with_row_key, without_rows
from .substring_dedup import FILTER_BITS, _bitmap, _has

K = 96  # values of a sketch; sets of at most so many are looked up by their rarest values
DEEP = 3  # smallest values of a range that make its key
RANGES = 256
TAIL = 2e-10  # chance that a pair at exactly the similarity asked for fails one of the two bounds
CELL = 2_048  # classes of a family on each side of a cell
PAIRS = 1 << 19  # compared at a time
DENSE = 4  # pairs a row of a cell may give before the sets are compared in the task
LONG_SET = 4_096  # shingles; larger sets are always compared as candidates
SIGN = ["s0", "s1", "s2", "s3"]
CELL_KEY = ["main", "i", "j"]
PERCENT = 80
SHINGLE = 2
BLOCK_PAIRS = 256  # members compared with one copy of their pivot
STAR_ROUNDS = 2
_MULT, _LONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x2545F4914F6CDD1D)


def _log_binomial(n: int, k: int, p: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)


def shared_values(percent: int, k: int = K) -> int:
    """Retained values that two large sets of a similarity share at least, but for a chance of ``TAIL``."""
    tail = 0.0
    for i in range(k if percent < 100 else 0):
        tail += math.exp(_log_binomial(k, i, percent / 100))
        if tail > TAIL:
            return max(1, i)
    return k


def most_bits(percent: int) -> int:
    """Bits in which the signatures of two sets of a similarity differ at most, likewise."""
    tail = 0.0
    for i in range(RANGES if percent < 100 else 0, 0, -1):
        tail += math.exp(_log_binomial(RANGES, i, (1 - percent / 100) / 2))
        if tail > TAIL:
            return i
    return 0


def key_ranges(percent: int) -> int:
    """Ranges of hash values, one of which has the same key in two sets of a similarity but for a chance of ``TAIL``."""
    same = (percent / 100) ** DEEP
    return math.ceil(math.log(TAIL) / math.log1p(-same)) if same < 1 else 1


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct signed 64-bit hashes of the word shingles of a lower-cased text."""
    h = hash_words(text)[1]
    if not len(h):
        return np.zeros(0, np.int64)
    n = len(h) - size + 1
    if n < 1:
        x, n, size = np.full(1, _LONE + np.uint64(len(h))), 1, len(h)
    else:
        x = np.zeros(n, np.uint64)
    for i in range(size):
        x = mix64(x * _MULT + h[i:i + n])
    return np.unique(x.view(np.int64))


def word_set(text: bytes, size: int) -> set:
    w = text.lower().split()
    if not w:
        return set()
    return set(zip(*[w[i:] for i in range(size)])) if len(w) >= size else {tuple(w)}


def signature(x: np.ndarray) -> np.ndarray:
    """One bit of the smallest value in each of 256 equal ranges, as four 64-bit words."""
    bits = np.zeros(RANGES, np.uint8)
    if len(x):
        at = (x >> np.int64(56)) + 128
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        bits[at[first]] = (x[first] & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def range_keys(x: np.ndarray, ranges: int) -> np.ndarray:
    """One key for each of equal ranges of hash values that the (sorted) set meets: its ``DEEP`` smallest values there."""
    u = x.view(np.uint64) ^ np.uint64(1 << 63)  # in the order of ``x``
    at = ((u >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    end, key = np.append(first[1:], len(x)), at[first]
    for i in range(DEEP):
        key = np.where(first + i < end, mix64(key * _MULT + u[np.minimum(first + i, len(x) - 1)]), key)
    return key.view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(a) for a in arrays])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)])))


def _summary(size: int, percent: int):
    """Each row's set as its class, size, signature and what it is looked up by: the values of a small set,
    the keys of one that may be linked with a larger set."""
    ranges = key_ranges(percent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, cls, whole, keys, signs = [], [], [], [], []
            with np.errstate(over="ignore"):
                for v in b.column("_bin"):
                    x = shingle_hashes((v.as_py() or b"").lower(), size)
                    n.append(len(x))
                    cls.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
                    whole.append(x if len(x) <= K else x[:0].copy())  # not a view that keeps the whole set alive
                    keys.append(range_keys(x, ranges) if len(x) * 100 >= (K + 1) * percent else np.zeros(0, np.int64))
                    signs.append(signature(x))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in ("_file_key", "_row_index", "doc_id")], pa.array(n, pa.int64()), pa.array(cls, pa.binary()),
                 _lists(whole), _lists(keys), *[pa.array([g[i] for g in signs], pa.int64()) for i in range(4)]],
                names=["_file_key", "_row_index", "doc_id", "n_shingles", "cls", "whole", "keys", *SIGN])

    return run


def _sketch(size: int):
    """The ``K`` smallest values of each text's set (all, if it is smaller)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, values = [], []
            with np.errstate(over="ignore"):
                for v in b.column("_bin"):
                    x = shingle_hashes((v.as_py() or b"").lower(), size)
                    n.append(len(x))
                    values.append(x[:K].copy())
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(n, pa.int64()), _lists(values)], names=["node", "n", "sketch"])

    return run


@dataclass
class NearDuplicates:
    rows: DataFrame  # _file_key, _row_index, doc_id, n_shingles, component_id, first_row
    links: DataFrame  # confirmed pairs of class nodes (a, b)
    classes: DataFrame  # node, cls, n, doc_id, _file_key, _row_index


def _classes(rows: DataFrame) -> DataFrame:
    first = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), F.col("_file_key").alias("f"), F.col("_row_index").alias("r"),
                     F.col("n_shingles").alias("n"), "whole", "keys", *SIGN)
    x = rows.filter("cls IS NOT NULL").groupBy("cls").agg(F.min(first).alias("m"))
    x = x.select("cls", F.col("m.n").alias("n"), "m.whole", "m.keys", F.col("m.i").alias("doc_id"), F.col("m.f").alias("_file_key"), F.col("m.r").alias("_row_index"), *[f"m.{c}" for c in SIGN])
    return scratch(x.withColumn("node", F.monotonically_increasing_id()), "near-classes")


def inverted_lists(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``v, node, n`` and signature: the keys of each class; lists of one class are left out."""
    e = classes.select("node", F.size("whole").alias("k"), F.explode("whole").alias("v"))
    counts = e.groupBy("v").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    per = e.join(counts, "v").groupBy("node").agg(F.first("k").alias("k"), F.sort_array(F.collect_list(F.struct("c", "v"))).alias("l"))
    need = F.ceil(F.col("k") * percent / 100).cast("int")
    take = F.greatest(F.lit(0), F.size("l") - need + 1)  # values found nowhere else come first in the order of rarity
    rare = scratch(per.select("node", F.explode(F.slice("l", 1, take)).alias("x")).select("node", F.col("x.v").alias("v")), "near-index")
    index = rare.unionByName(classes.select("node", F.explode("keys").alias("v")))
    full = index.groupBy("v").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("v")
    return scratch(index.join(full, "v").join(classes.select("node", "n", *SIGN), "node").select("v", "node", "n", *SIGN), "near-lists")


def _labelled(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return lists.withColumn("comp", F.col("node"))
    l = labels.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
    return lists.join(l, lists["node"] == l["_n"], "left").select(*lists.columns, F.coalesce("_c", "node").alias("comp"))


def _near(a: str, b: str, percent: int):
    """Size bound and bit signatures of two list rows (columns ``n``, ``s0`` to ``s3`` with prefixes)."""
    small, large = F.least(f"{a}n", f"{b}n"), F.greatest(f"{a}n", f"{b}n")
    bits = sum((F.bit_count(F.col(f"{a}s{i}").bitwiseXOR(F.col(f"{b}s{i}"))) for i in range(1, 4)), F.bit_count(F.col(f"{a}s0").bitwiseXOR(F.col(f"{b}s0"))))
    return (small * 100 >= large * percent) & (bits <= most_bits(percent))


def _as(prefix: str) -> list:
    return [F.col(c).alias(prefix + c) for c in ("node", "comp", "n", "s0", "s1", "s2", "s3")]


def star_pairs(lists: DataFrame, round_no: int, percent: int) -> DataFrame:
    """One pivot per list that spans several components; the first round takes the smallest node, so
    lists of one group agree on it, later rounds a random one."""
    order = F.lit(0).cast("bigint") if round_no == 0 else F.xxhash64(F.lit(round_no), "v", "node")
    pivot = F.min(F.struct(order.alias("o"), "node", "comp", "n", "s0", "s1", "s2", "s3")).alias("p")
    p = lists.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), pivot).filter("lo <> hi")
    p = p.select("v", "p.*").select("v", *_as("p_"))
    x = lists.join(p, "v").filter((F.col("comp") != F.col("p_comp")) & _near("", "p_", percent))
    return x.select(F.col("p_node").alias("a"), F.col("node").alias("b")).distinct()


def families(lists: DataFrame) -> DataFrame:
    """``main, node, comp, n`` and signature: the classes of all lists that span several components, by the
    largest component of the list; each class once per family."""
    sizes = lists.groupBy("v", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("v").agg(F.max(F.struct("c", "comp")).alias("m"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    x = lists.join(main.select("v", F.col("m.comp").alias("main")), "v")
    return scratch(x.select("main", "node", "comp", "n", *SIGN).distinct(), "near-families")


def cells(family: DataFrame) -> DataFrame:
    """Rows of every cell ``(main, i, j)``: side 0 has the classes outside the main component, side 1 the others,
    side 2 stands for both (a family of one cell); each pair of such classes meets in one cell."""
    per = family.groupBy("main").agg(F.count(F.lit(1)).alias("c1"), F.count_if(F.col("comp") != F.col("main")).alias("c0"))
    x = family.join(per, "main")
    cols = ["node", "comp", "n", *SIGN]
    zero, left = F.lit(0), F.col("comp") != F.col("main")
    one = x.filter(F.col("c1") <= CELL).select("main", zero.alias("i"), zero.alias("j"), F.when(left, 2).otherwise(1).alias("side"), *cols)
    x = x.filter(F.col("c1") > CELL)
    blocks = lambda c: F.ceil(F.col(c) / CELL)
    block = lambda side, c: F.pmod(F.xxhash64(F.lit(side), "node"), blocks(c)).cast("int")
    every = lambda c: F.explode(F.sequence(zero, blocks(c).cast("int") - 1))
    rows = x.filter(left).select("main", block(0, "c0").alias("i"), every("c1").alias("j"), zero.alias("side"), *cols)
    return one.unionByName(rows).unionByName(x.select("main", every("c0").alias("i"), block(1, "c1").alias("j"), F.lit(1).alias("side"), *cols))


def _both_sides(t: pa.Table) -> pa.Table:
    """A row of side 2 as one of each side, sorted."""
    side = t.column("side").to_numpy()
    if not (side == 2).any():
        return t
    at = np.concatenate([np.arange(len(side)), np.flatnonzero(side == 2)])
    new = np.concatenate([np.where(side == 2, 0, side), np.ones((side == 2).sum(), side.dtype)])
    order = np.lexsort((new, *[t.column(c).to_numpy()[at] for c in reversed(CELL_KEY)]))
    t = t.take(pa.array(at[order]))
    return t.set_column(t.schema.get_field_index("side"), "side", pa.array(new[order].astype(np.int32)))


def _whole_cells(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of whole cells of a sorted stream, ``least`` rows or more at a time, and where each cell begins."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= least:
            t = pa.Table.from_batches(held).combine_chunks()
            cut = _cut(t)
            if len(cut):  # the last cell may go on
                whole = _both_sides(t.slice(0, cut[-1]))
                yield whole, np.concatenate([[0], _cut(whole)])
                held = t.slice(cut[-1]).to_batches()
                n -= cut[-1]
    if n:
        whole = _both_sides(pa.Table.from_batches(held).combine_chunks())
        yield whole, np.concatenate([[0], _cut(whole)])


def _cut(t: pa.Table) -> np.ndarray:
    """Where a new cell begins, but for the first."""
    new = np.zeros(max(0, t.num_rows - 1), bool)
    for c in CELL_KEY:
        k = t.column(c).to_numpy()
        new |= k[1:] != k[:-1]
    return np.flatnonzero(new) + 1


def _by_cell(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each cell of a sorted stream."""
    for t, begin in _whole_cells(batches, 1):
        keys = [t.column(c).to_numpy() for c in CELL_KEY]
        for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), t.num_rows]):
            yield tuple(int(k[lo]) for k in keys), t.slice(lo, hi - lo)


def _sides(cell: pa.Table) -> list[dict[str, np.ndarray]]:
    cols = {c: cell.column(c).to_numpy() for c in ("side", "node", "comp", "n")}
    return [{c: v[cols["side"] == side] for c, v in cols.items()} for side in (0, 1)]


def _meet(a: dict, b: dict, k: int, main: int, percent: int) -> np.ndarray:
    """Rows of side 1 that row ``k`` of side 0 has to be compared with: of another component, each pair once,
    of a size that allows a link."""
    small, large = np.minimum(a["n"][k], b["n"]), np.maximum(a["n"][k], b["n"])
    return (a["comp"][k] != b["comp"]) & ((b["comp"] == main) | (a["node"][k] < b["node"])) & (small * 100 >= large * percent)


def _units(begin: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[np.ndarray]:
    """Cells as units ``(cell, first row of side 0, rows of side 0)`` of a bounded number of pairs, in groups."""
    per = np.maximum(1, PAIRS // np.maximum(right, 1))
    count = -(-left // per)
    cell = np.repeat(np.arange(len(begin)), count)
    no = np.arange(len(cell)) - np.repeat(np.cumsum(count) - count, count)
    at = no * per[cell]
    rows = np.minimum(per[cell], left[cell] - at)
    group = np.cumsum(rows * right[cell]) // PAIRS
    units = np.stack([cell, begin[cell] + at, rows], axis=1)
    yield from np.split(units, np.flatnonzero(np.diff(group)) + 1)


def _light(percent: int):
    """Pairs of each cell with near signatures; for a cell with too many of them a row without a pair. Small
    cells are compared together."""
    limit = most_bits(percent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, begin in _whole_cells(batches, CELL):
            col = {c: t.column(c).to_numpy() for c in (*CELL_KEY, "side", "node", "comp", "n", *SIGN)}
            size = np.diff(np.append(begin, t.num_rows))
            left = np.add.reduceat((col["side"] == 0).astype(np.int64), begin)
            right = size - left
            for units in _units(begin, left, right):
                cell, first, rows = units.T
                pairs = rows * right[cell]
                unit = np.repeat(np.arange(len(units)), pairs)
                no = np.arange(len(unit)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
                wide = right[cell][unit]
                a, b = first[unit] + no // wide, (begin + left)[cell][unit] + no % wide
                main, ca, cb = col["main"][a], col["comp"][a], col["comp"][b]
                na, nb = col["n"][a], col["n"][b]
                small, large = np.minimum(na, nb), np.maximum(na, nb)
                ok = np.flatnonzero((ca != cb) & ((cb == main) | (col["node"][a] < col["node"][b])) & (small * 100 >= large * percent))
                a, b, unit, large = a[ok], b[ok], unit[ok], large[ok]
                bits = np.zeros(len(ok), np.int32)
                for c in SIGN:
                    bits += np.bitwise_count((col[c][a] ^ col[c][b]).view(np.uint64))
                near = np.flatnonzero(bits <= limit)
                a, b, unit, long = a[near], b[near], unit[near], large[near] > LONG_SET
                dense = np.bincount(unit[~long], minlength=len(units)) > DENSE * (rows + right[cell])
                out = ~dense[unit] | long
                marks = first[dense]
                at = np.concatenate([a[out], marks])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(col[c][at]) for c in CELL_KEY] + [pa.array(col["node"][at], mask=np.arange(len(at)) >= out.sum()), pa.array(np.append(col["node"][b[out]], np.zeros(len(marks), np.int64)))],
                    names=[*CELL_KEY, "a", "b"])

    return run


def _dense(size: int, percent: int):
    """Links of each cell by their sets: one from each class of side 0 to each component."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, cell in _by_cell(batches):
            with np.errstate(over="ignore"):
                sets = [shingle_hashes((v.as_py() or b"").lower(), size) for v in cell.column("_bin")]
            ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
            ends = np.cumsum([len(s) for s in sets])
            side = cell.column("side").to_numpy()
            each = np.split(ids, ends[:-1])
            a, b = _sides(cell)
            mine, other = [each[i] for i in np.flatnonzero(side == 0)], [each[i] for i in np.flatnonzero(side == 1)]
            if not mine or not other:
                continue
            flat, starts = np.concatenate(other), np.cumsum([0] + [len(s) for s in other[:-1]])
            mark, left, right = np.zeros(len(ids) + 1, bool), [], []
            for k, own in enumerate(mine):
                meet = _meet(a, b, k, key[0], percent)
                if meet.any():
                    mark[own] = True
                    common = np.add.reduceat(mark[flat], starts, dtype=np.int64)
                    mark[own] = False
                    hit = np.flatnonzero(meet & (common * 100 >= (a["n"][k] + b["n"] - common) * percent))
                    hit = hit[np.unique(b["comp"][hit], return_index=True)[1]]
                    left.append(np.full(len(hit), a["node"][k]))
                    right.append(b["node"][hit])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    return run


def remaining_pairs(lists: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Candidates among all pairs of classes that share a list and are in different components."""
    every = cells(families(lists))
    # a fixed number of tasks: the rows are small, the work on them is not
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda x: x.repartition(tasks, *CELL_KEY).sortWithinPartitions(*CELL_KEY, "side")
    found = scratch(dealt(every).mapInArrow(_light(percent), "main bigint, i int, j int, a bigint, b bigint"), "near-light")
    pairs = found.filter("a IS NOT NULL").select("a", "b")
    dense = found.filter("a IS NULL").select(*CELL_KEY).distinct()
    if dense.limit(1).count():
        rows = every.filter(F.col("n") <= LONG_SET).join(dense, CELL_KEY, "left_semi").drop(*SIGN).join(texts, "node")
        pairs = pairs.unionByName(dealt(rows).mapInArrow(_dense(size, percent), "a bigint, b bigint"))
    return pairs.distinct()


def by_sketch(pairs: DataFrame, sketches: DataFrame, percent: int = PERCENT, k: int = K) -> DataFrame:
    """Keep pairs whose union sketch allows the similarity; exact where both sets are whole.
    ``sketches``: ``node, n, sketch``."""
    s = lambda c: sketches.select(F.col("node").alias(c), F.col("sketch").alias(f"s{c}"), F.col("n").alias(f"n{c}"))
    x = pairs.join(s("a"), "a").join(s("b"), "b")
    both = F.array_intersect("sa", "sb")
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, k)
    whole = (F.col("na") <= k) & (F.col("nb") <= k)
    common = F.size(both)
    ok = F.when(whole, common * 100 >= (F.col("na") + F.col("nb") - common) * percent).otherwise(
        (F.size(F.array_intersect(union, both)) >= shared_values(percent, k)) | (F.size(union) < k))
    return x.filter(ok).select("a", "b")


def _confirm(size: int, percent: int):
    """Rows sorted by (a, block), the pivot (b null) first; one pivot's set is held at a time."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pivot = None, set()
        for batch in batches:
            out_a, out_b = [], []
            for a, block, b, text in zip(*[batch.column(c).to_pylist() for c in ("a", "block", "b", "_bin")]):
                mine = word_set(text, size)
                if b is None:
                    held, pivot = (a, block), mine
                    continue
                if held != (a, block):
                    raise ValueError("a member without its pivot")
                common = len(mine & pivot)
                if common and common * 100 >= (len(mine) + len(pivot) - common) * percent:
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Pairs whose full sets are similar enough. ``texts``: ``node, _bin``. A pivot with many members
    is dealt over blocks, so no task gets an unbounded group."""
    p = pairs.join(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")), "a")
    p = p.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / BLOCK_PAIRS)).cast("int").alias("block"))
    p = scratch(p, "near-pairs")
    members = p.join(texts.withColumnRenamed("node", "b"), "b").select("a", "block", "b", "_bin")
    pivots = p.select("a", "block").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "block", F.lit(None).cast("bigint").alias("b"), "_bin")
    x = pivots.unionByName(members).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    return x.mapInArrow(_confirm(size, percent), "a bigint, b bigint")


def link(lists: DataFrame, texts: DataFrame, sketches: DataFrame, size: int, percent: int, rounds: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Links that decide the components of ``lists``, and the component of each linked node."""
    labels, links, tested = None, None, None
    for r in range(rounds + 1):
        at = _labelled(lists, labels)
        pairs = star_pairs(at, r, percent) if r < rounds else remaining_pairs(at, texts, size, percent)
        if tested is not None:
            known = tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        pairs = scratch(by_sketch(pairs, sketches, percent), "near-candidates")
        if pairs.limit(1).count() == 0:
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        new = scratch(confirmed(pairs, texts, size, percent), "near-links")
        links = new if links is None else links.unionByName(new)
        labels = components(links)
    return labels, links


def _listed(words):
    """Rows whose key may be among the listed ones (bitmap test)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_has(words.value, b.column("h").to_numpy())))

    return run


def listed_texts(keyed: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, _bin`` of the listed classes. Most other texts are left out before the join moves them."""
    key = ["_file_key", "_row_index"]
    h = F.xxhash64(*key).alias("h")
    n, bits = nodes.count(), FILTER_BITS[0]
    while bits < 16 * n and bits < FILTER_BITS[1]:
        bits *= 2
    words = keyed.sparkSession.sparkContext.broadcast(_bitmap(nodes.select(h), bits))
    may = keyed.select(h, *key, "_bin").mapInArrow(_listed(words), "h bigint, _file_key bigint, _row_index bigint, _bin binary")
    return scratch(may.join(nodes, key).select("node", "_bin"), "near-texts")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = PERCENT,
                    star_rounds: int = STAR_ROUNDS) -> NearDuplicates:
    """Components of documents whose sets of ``size``-word shingles (ASCII lower case) have a Jaccard
    similarity of at least ``percent`` / 100."""
    keyed = with_row_key(docs).select("_file_key", "_row_index", F.col(id_col).cast("bigint").alias("doc_id"),
                                      F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_bin"))
    rows = scratch(keyed.mapInArrow(_summary(size, percent), "_file_key bigint, _row_index bigint, doc_id bigint, n_shingles bigint, cls binary, whole array<bigint>, keys array<bigint>, s0 bigint, s1 bigint, s2 bigint, s3 bigint"), "near-rows")
    fat_rows, fat = rows, _classes(rows)
    rows = scratch(rows.drop("whole", "keys", *SIGN), "near-rows")
    drop_scratch(fat_rows)
    lists = inverted_lists(fat, percent)
    # the texts and sketches that any comparison may need
    classes = scratch(fat.drop("whole", "keys", *SIGN), "near-classes")
    drop_scratch(fat)
    nodes = scratch(classes.join(lists.select("node").distinct(), "node", "left_semi").select("node", "_file_key", "_row_index"), "near-nodes")
    texts = listed_texts(keyed, nodes)
    sketches = scratch(texts.mapInArrow(_sketch(size), "node bigint, n bigint, sketch array<bigint>"), "near-sketches")
    labels, links = link(lists, texts, sketches, size, percent, star_rounds)
    if labels is None:
        labels = classes.limit(0).select("node", F.col("node").alias("comp"))
        links = labels.select(F.col("node").alias("a"), F.col("comp").alias("b"))
    # classes in a component of several take its smallest document, others their own
    order = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), F.col("_file_key").alias("f"), F.col("_row_index").alias("r"))
    inside = classes.join(labels, "node")
    best = inside.groupBy("comp").agg(F.min(order).alias("best"))
    of = inside.join(best, "comp").select(F.col("node").alias("_n"), "best")
    of = classes.join(of, classes["node"] == of["_n"], "left").select(F.col("cls").alias("_cls"), F.coalesce("best", order).alias("best"))
    full = rows.filter("cls IS NOT NULL")
    full = full.join(of, full["cls"] == of["_cls"]).select(
        "_file_key", "_row_index", "doc_id", "n_shingles", F.col("best.i").alias("component_id"),
        ((F.col("best.f") == F.col("_file_key")) & (F.col("best.r") == F.col("_row_index"))).alias("first_row"))
    empty = rows.filter("cls IS NULL").select("_file_key", "_row_index", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("first_row"))
    return NearDuplicates(full.unionByName(empty), links, classes)


def representatives(docs: DataFrame, size: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay: the first of each component, with their columns."""
    docs = stored(docs)
    return without_rows(docs, near_duplicates(docs, size=size).rows.filter(~F.col("first_row")))
