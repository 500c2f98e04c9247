"""Best-fit packing by linear grouping (operator 4).

Texts are tokenised into pieces of at most ``CAPACITY`` tokens. Packing works on the number of pieces
per length (at most ``CAPACITY`` integers, whatever the corpus): large lengths are put into groups of
equal cardinality and rounded up to the largest length of their group; column generation finds the
configurations (multisets of rounded lengths that fit) of a linear program over those few sizes; its
rounded-down solution opens sequences. Actual pieces then take the places of their group; the last
place of a sequence takes the longest remaining piece that fits, so the space reserved by rounding up
is used. What is left over, and all small pieces, go longest first into the fullest sequence that
still has room (best fit), else into new sequences.

The driver handles only run lengths: (length, how many pieces, first sequence). Spark ranks the pieces
within their length (a sorted table with partition offsets, no single-task window) and looks up the
run of each piece, so its work is linear in the pieces.

Defined cases: null text is empty and becomes its end token alone; equal rows are packed one by one;
a null ``doc_id`` is kept; extra columns are ignored; an empty table gives no piece.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import indexed, scratch, with_row_key, worker_cache

CAPACITY = 1024
END_ID = 2
GROUPS = 64  # sizes of the linear program
SMALL = 128  # shorter pieces are not grouped, they fill gaps
TOLERANCE = 1e-4  # of the linear program's optimum
SLICE_BYTES = 1 << 22  # texts tokenised together

# Kinds of UTF-8 bytes. Letters are those of ASCII and Latin-1; marks are ASCII marks.
OTHER, SPACE, BLANK, LETTER, DIGIT, MARK, QUOTE = range(7)
KIND = np.zeros(256, np.uint8)
for _kind, _bytes in ((SPACE, b" "), (BLANK, b"\t\n\x0b\x0c\r"), (LETTER, bytes([*range(65, 91), *range(97, 123)])), (DIGIT, b"0123456789"),
                      (MARK, b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"), (QUOTE, b"'")):
    KIND[list(_bytes)] = _kind
# Neighbours between which the vocabulary's own pattern always cuts, so ids may be looked up chunk by chunk: where the
# kind changes, but a letter behind a quote may belong to it ("'s"), a space belongs to what follows, and nothing is
# known of other characters. Inside blanks see _begins.
CUT = np.zeros((7, 7), bool)
for _a, _b in ((LETTER, (DIGIT, MARK, QUOTE)), (DIGIT, (LETTER, MARK, QUOTE)), (MARK, (LETTER, DIGIT)), (QUOTE, (DIGIT,)), (BLANK, (OTHER, LETTER, DIGIT, MARK, QUOTE))):
    CUT[_a, list(_b)] = True
CUT[np.ix_([OTHER, LETTER, DIGIT, MARK, QUOTE], [SPACE, BLANK])] = True
# A chunk that the pattern leaves whole.
WHOLE = re.compile(" ?(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[!-/:-@\\[-`{-~]+)")
# Texts with other blanks (the pattern cuts at them) or special tokens (they know no borders) are encoded as they are.
ODD = "[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|<\\|"


def _begins(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the chunks of texts begin, given their UTF-8 bytes and where each (not empty) text begins."""
    kind = KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # not the signs of multiplication and division
    kind[lead] = kind[lead + 1] = LETTER
    first = np.zeros(len(data) + 1, bool)
    first[starts] = first[-1] = True
    cut = first[:-1].copy()
    cut[1:] |= CUT.ravel()[kind[:-1] * np.uint8(7) + kind[1:]]
    blank = (kind == SPACE) | (kind == BLANK)
    # of several blanks before something else, the last stands alone or goes with it
    last = blank[1:-1] & blank[:-2] & ~blank[2:] & ~first[2:-1]
    cut[1:-1] |= last
    return np.flatnonzero(cut)


def _take(ids: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the given rows one after the other, and where each row's end. Row k has those up to ``ends[k]``."""
    starts = np.append(0, ends[:-1])[rows]
    size = ends[rows] - starts
    to = np.cumsum(size)
    return ids[np.repeat(starts - (to - size), size) + np.arange(to[-1] if len(to) else 0)], to


class ChunkIds:
    """Little-endian 32-bit ids of texts by way of their chunks. Arrow finds the distinct chunks of a slice, those not
    yet known are encoded, many together, one a line: a line feed is a token of its own before any chunk, and no chunk but
    blanks contains one. A token stands for as many bytes as it has characters, so the lines' ends are found by counting.
    Ids of chunks are remembered up to a bounded number; then only those of the latest slice stay, so frequent ones survive."""

    LIMIT, LINES = 600_000, 512
    KEPT = 100_000  # from task to task
    LONG = 64  # bytes; longer chunks are not remembered

    def __init__(self, tokenizer):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = tokenizer
        # the same vocabulary, for lines of chunks that the pattern leaves whole
        self.whole = Tokenizer.from_str(tokenizer.to_str())
        self.whole.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit("\n"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = tokenizer.get_vocab()
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.size[list(vocabulary.values())] = list(map(len, vocabulary))
        self.at: dict[bytes, int] = {}  # number of each remembered chunk
        self.known, self.ends = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        assert len(self._encode("\n")) == 1

    def _encode(self, text: str, whole: bool = False) -> np.ndarray:
        t = self.whole if whole else self.tokenizer
        return np.array(t.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _lines(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks one after the other, and where each one's end."""
        whole = np.array([WHOLE.fullmatch(c) is not None for c in chunks], bool)
        ids, count = [], []
        rows = np.argsort(~whole, kind="stable")
        n = int(whole.sum())
        for lo, hi, feed in ((0, n, 0), (n, len(chunks), 1)):
            for k in range(lo, hi, self.LINES):
                part = [chunks[i] for i in rows[k:min(hi, k + self.LINES)].tolist()]
                got = self._encode("\n".join(part), not feed)
                to, want = np.cumsum(self.size[got]), np.cumsum([len(c.encode()) + feed for c in part]) - feed
                end = np.searchsorted(to, want) + 1
                if not np.array_equal(to[end - 1], want):
                    raise ValueError("a token that is not made of bytes of its text")
                if feed:
                    keep = np.ones(len(got), bool)
                    keep[end[:-1]] = False
                    got, end = got[keep], end - np.arange(len(end))
                ids.append(got)
                count.append(np.diff(end, prepend=0))
        back = np.empty(len(chunks), np.int64)
        back[rows] = np.arange(len(chunks))
        return _take(np.concatenate(ids), np.cumsum(np.concatenate(count)), back)

    def _learn(self, chunks: list[bytes]) -> None:
        """Number and ids of chunks not yet known; all are remembered until the slice is done."""
        blank = [c for c in chunks if c.isspace()]
        lines = [c for c in chunks if not c.isspace()]
        ids, ends = [self.known], [self.ends]
        if lines:
            got, to = self._lines(b"\n".join(lines).decode().split("\n"))
            ids.append(got)
            ends.append(to + len(self.known))
        for c in blank:
            ids.append(self._encode(c.decode()))
            ends.append(np.array([sum(map(len, ids))]))
        n = len(self.ends)
        self.at.update(zip(lines + blank, range(n, n + len(chunks))))
        self.known, self.ends = np.concatenate(ids), np.concatenate(ends)

    def _forget(self, chunks: list[bytes], rows: np.ndarray) -> None:
        """Of what is remembered only the chunks of this slice stay, but for long ones."""
        short = np.array([len(c) <= self.LONG for c in chunks], bool)
        if len(self.at) > self.LIMIT or not short.all():
            if len(self.at) <= self.LIMIT:
                for c in (chunks[i] for i in np.flatnonzero(~short).tolist()):
                    del self.at[c]
                if len(self.known) <= 16 * self.LIMIT:
                    return
            self.known, self.ends = _take(self.known, self.ends, rows[short])
            self.at = {chunks[i]: k for k, i in enumerate(np.flatnonzero(short).tolist())}

    def rest(self) -> None:
        """A task is done, its process may wait or serve other steps: only the first chunks stay, those of the
        slice that the others were added to, with the frequent ones."""
        first = list(islice(self.at.items(), self.KEPT))
        self.known, self.ends = _take(self.known, self.ends, np.array([k for _, k in first], np.int64))
        self.at = {c: k for k, (c, _) in enumerate(first)}
        pa.default_memory_pool().release_unused()

    def ids(self, texts: pa.Array | list[str]) -> list[bytes]:
        texts = pa.array(texts, pa.string())
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        plain = np.flatnonzero(~odd & (size > 0))
        out = [b""] * len(texts)
        for k in np.flatnonzero(odd).tolist():
            out[k] = self._encode(texts[k].as_py()).tobytes()
        if not len(plain):
            return out
        data = np.frombuffer(b"".join(texts.cast(pa.binary()).take(pa.array(plain)).to_pylist()), np.uint8)
        starts = np.append(0, np.cumsum(size[plain]))
        begins = _begins(data, starts[:-1])
        offsets = np.append(begins, len(data)).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        chunks = found.dictionary.to_pylist()
        self._learn([c for c in chunks if c not in self.at])
        rows = np.fromiter(map(self.at.__getitem__, chunks), np.int64, len(chunks))
        got, ends = _take(self.known, self.ends, rows[found.indices.to_numpy()])
        self._forget(chunks, rows)
        # ids up to the last chunk of each text
        to = np.append(0, ends[np.searchsorted(begins, starts[1:]) - 1]).tolist()
        got = got.astype("<u4")
        for k, lo, hi in zip(plain.tolist(), to, to[1:]):
            out[k] = got[lo:hi].tobytes()
        return out


def chunk_ids(tokenizer_path: str) -> ChunkIds:
    cache = worker_cache("chunk_ids")
    if tokenizer_path not in cache:
        from tokenizers import Tokenizer

        cache[tokenizer_path] = ChunkIds(Tokenizer.from_file(tokenizer_path))
    return cache[tokenizer_path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document of ``n`` tokens: full ones but for the first."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(at, capacity) for at in range(first, n, capacity)]


def _pieces(tokenizer_path: str, capacity: int, end_id: int, keep_ids: bool):
    end = end_id.to_bytes(4, "little")
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["_file_key", "_row_index", "doc_id", "piece", "start", "length", "ids_crc32", "ids"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = chunk_ids(tokenizer_path)
        for b in batches:
            size = pc.binary_length(b.column("_t")).to_numpy(zero_copy_only=False).astype(np.int64)
            no = (np.cumsum(size) - size) // SLICE_BYTES
            begin = [0, *(np.flatnonzero(np.diff(no)) + 1).tolist()] if b.num_rows else []
            for lo, hi in zip(begin, [*begin[1:], b.num_rows]):
                yield table(ids_of, b.slice(lo, hi - lo))
        ids_of.rest()

    def table(ids_of, slice_):
        rows = []
        for fk, ri, doc, ids in zip(*[slice_.column(c).to_pylist() for c in ("_file_key", "_row_index", "doc_id")], ids_of.ids(slice_.column("_t"))):
            ids += end
            for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                part = ids[4 * start:4 * (start + n)]
                rows.append((fk, ri, doc, k, start, n, zlib.crc32(part), part if keep_ids else None))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, ids`` (binary, null unless kept) and the row's key."""
    d = with_row_key(docs).select("_file_key", "_row_index", F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    return d.mapInArrow(_pieces(tokenizer_path, capacity, end_id, keep_ids),
                        "_file_key bigint, _row_index bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary")


# ----------------------------------------------------------------------------------------------
# the plan on counts (at most CAPACITY numbers, whatever the corpus)
# ----------------------------------------------------------------------------------------------
def linear_groups(counts: dict[int, int], groups: int, small: int) -> list[list[int]]:
    """Large lengths, ascending, in about ``groups`` groups of equal cardinality. A length is never
    split: one that alone holds a group's share is a group of its own (nothing is rounded there)."""
    sizes = sorted(s for s in counts if s >= small)
    share = max(1, -(-sum(counts[s] for s in sizes) // groups))
    out, held = [], 0
    for s in sizes:
        if not out or held + counts[s] > share:
            out.append([])
            held = 0
        out[-1].append(s)
        held += counts[s]
    return out


def best_configuration(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the multiset of sizes within the capacity with the largest value. Each round
    adds one more item at every capacity, so there are capacity / smallest size rounds."""
    back = np.arange(capacity + 1)[None, :] - sizes[:, None]
    fits, back = back >= 0, np.maximum(back, 0)
    best, rounds = np.zeros(capacity + 1), []
    while True:
        got = np.where(fits, best[back] + value[:, None], -1.0)
        item = got.argmax(axis=0)
        top = got[item, np.arange(capacity + 1)]
        better = top > best + 1e-12
        if not better.any():
            break
        rounds.append(np.where(better, item, -1))
        best = np.where(better, top, best)
    out, c = np.zeros(len(sizes), np.int64), capacity
    for r in reversed(rounds):
        if r[c] >= 0:
            out[r[c]] += 1
            c -= int(sizes[r[c]])
    return float(best[capacity]), out


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, float]]:
    """Column generation (revised simplex): configurations and how often each is used in a solution of
    the linear program that covers the demand with the fewest sequences."""
    s, d = np.array(sizes, np.int64), np.array(demand, np.float64)
    m = len(s)
    cols = [np.where(np.arange(m) == i, capacity // s[i], 0).astype(np.float64) for i in range(m)]
    inverse = np.diag([1.0 / cols[i][i] for i in range(m)])
    x = inverse @ d
    for step in range(rounds):
        dual = inverse.sum(axis=0)
        value, config = best_configuration(s, dual, capacity)
        if value <= 1 + TOLERANCE:  # the rest of the gain is below this share
            break
        direction = inverse @ config
        rows = np.nonzero(direction > 1e-9)[0]
        r = rows[np.lexsort((rows, x[rows] / direction[rows]))[0]]
        theta = x[r] / direction[r]
        x = x - theta * direction
        x[r] = theta
        pivot = inverse[r] / direction[r]
        inverse = inverse - np.outer(direction, pivot)
        inverse[r] = pivot
        cols[r] = config.astype(np.float64)
        if step % 100 == 99:  # forget rounding errors
            inverse = np.linalg.inv(np.array(cols).T)
            x = np.maximum(inverse @ d, 0)
    return [(c.astype(np.int64), float(v)) for c, v in zip(cols, x) if v > 1e-9]


class Runs:
    """Sequences as runs of equal remaining space, and the log of what was placed."""

    def __init__(self, capacity: int):
        self.capacity, self.next = capacity, 0
        self.free: dict[int, list[tuple[int, int]]] = {}  # space -> [(first sequence, how many)]
        self.spaces: list[int] = []
        self.placed: dict[int, list[tuple[int, int, int]]] = {}  # length -> [(how many, first sequence, offset)]

    def put(self, space: int, first: int, n: int) -> None:
        if n and space:
            if space not in self.free:
                self.free[space] = []
                bisect.insort(self.spaces, space)
            self.free[space].append((first, n))

    def place(self, length: int, n: int, first: int, offset: int) -> None:
        self.placed.setdefault(length, []).append((n, first, offset))

    def open(self, n: int) -> int:
        first, self.next = self.next, self.next + n
        return first

    def best_fit(self, length: int, n: int) -> None:
        """Longest-first caller: into the fullest sequences with room, else into new ones."""
        while n:
            at = bisect.bisect_left(self.spaces, length)
            if at == len(self.spaces):
                per = self.capacity // length
                new = -(-n // per)
                self.put(self.capacity, self.open(new), new)
                continue
            space = self.spaces[at]
            first, k = self.free[space].pop()
            if not self.free[space]:
                del self.free[space], self.spaces[at]
            take = min(n, k)
            if take < k:
                self.put(space, first + take, k - take)
            self.place(length, take, first, self.capacity - space)
            self.put(space - length, first, take)
            n -= take


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """Where the pieces of each length go: runs ``(how many, first sequence, offset)``; number of
    sequences. Piece number i of a run goes to sequence ``first + i``."""
    runs, left = Runs(capacity), dict(counts)
    if n := left.pop(capacity, 0):
        runs.place(capacity, n, runs.open(n), 0)
    grouped = linear_groups(left, groups, small)
    if grouped:
        demand = [sum(left[s] for s in g) for g in grouped]
        solution = configurations([g[-1] for g in grouped], demand, capacity)
        for config, times in sorted(solution, key=lambda c: (-c[1], c[0].tolist())):
            slots = [g for g in reversed(range(len(grouped))) for _ in range(config[g])]
            # no more sequences than the group's remaining pieces fill
            room = min(sum(left[s] for s in grouped[g]) // int(config[g]) for g in set(slots))
            n = min(int(times + 1e-6), room)
            if not n:
                continue
            first = runs.open(n)
            # slices of sequences that hold the same lengths so far: (first, how many, used)
            slices = [(first, n, 0)]
            for place, g in enumerate(slots):
                out, last = [], place == len(slots) - 1
                for f, k, used in slices:
                    while k:
                        # a member of the group; the last place takes the longest remaining piece that
                        # fits, so what rounding up reserved in vain is used
                        options = reversed(range(1, capacity - used + 1)) if last else reversed(grouped[g])
                        s = next((s for s in options if left.get(s)), 0)
                        if not s:
                            out.append((f, k, used))
                            break
                        take = min(k, left[s])
                        left[s] -= take
                        runs.place(s, take, f, used)
                        out.append((f, take, used + s))
                        f, k = f + take, k - take
                slices = out
            for f, k, used in slices:
                runs.put(capacity - used, f, k)
    for s in sorted((s for s in left if left[s]), reverse=True):
        runs.best_fit(s, left[s])
    return runs.placed, runs.next


def pack(parts: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> DataFrame:
    """``parts``: any columns with ``length`` (1 to capacity) and the row's key. Adds ``sequence_id``
    and ``offset``."""
    spark = parts.sparkSession
    # tokenised once: the range partitioning below reads its input twice
    x = indexed(scratch(parts, "pack-parts"), ["length", "_file_key", "_row_index", "piece"], "pack-pieces")
    counts = {int(r["length"]): int(r["n"]) for r in x.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    placed, _ = plan(counts, capacity, groups, small)
    # rank of a piece among all = rank among its length + pieces of shorter lengths; runs get the same origin
    table, base = [], 0
    for s in sorted(counts):
        at = base
        for n, first, offset in placed[s]:
            table.append((at, first, offset))
            at += n
        base += counts[s]
    starts = [t[0] for t in table]
    lookup = spark.sparkContext.broadcast((np.array(starts, np.int64), np.array([t[1] for t in table], np.int64), np.array([t[2] for t in table], np.int64)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, offset = lookup.value
        for b in batches:
            i = np.asarray(b.column("_idx"), np.int64)
            k = np.searchsorted(at, i, "right") - 1
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(first[k] + i - at[k]), pa.array(offset[k])], names=[*keep, "sequence_id", "offset"])

    keep = [c for c in x.columns if c not in ("_idx", "_file_key", "_row_index")]
    schema = ", ".join(f"`{c}` {t}" for c, t in x.select(*keep).dtypes) + ", sequence_id bigint, offset bigint"
    return x.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` (binary, little-endian 32-bit) of packed pieces whose ids were kept."""
    g = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return g.select("sequence_id", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    x = pack(pieces(docs, tokenizer_path, capacity=capacity, end_id=end_id, keep_ids=keep_ids), capacity)
    return x if keep_ids else x.drop("ids")
