"""Removal of repeated passages by a compacted De Bruijn graph of words (operator 5).

A window is ``WINDOW`` consecutive words. Its minimizer is the ``GRAM``-word gram with the smallest
hash in it; consecutive windows with one minimizer form a run, about one row per 13 words, and equal
passages are cut into the same runs except at their ends. Three steps:

1. Grams: per minimizer the smallest and largest document and whether its runs differ. Minimizers of
   one document only are dropped: no window there can be repeated.
2. Graph: the edges are the runs of repeated minimizers (windows of their own where the runs of a
   minimizer differ), identified by 128 bits of hashes; the source of an edge is its first place in the
   smallest document. Neighbouring edges whose link does not branch and whose sources are adjacent are
   compacted into paths by doubling jumps (Spark joins).
3. Spans: the occurrences of a path in a document merge into long spans, each with the coordinates of
   its source. The words at both coordinates are compared by digest before a span is removed.

Everything is linear in the words: groups of copies never form pairs, hot edges are aggregated before
the shuffle, and a source that many spans point to is read once per block of requests.

Defined cases: null text has no words; texts shorter than a window lose nothing; a null ``doc_id`` counts
as larger than all others; rows with an equal ``doc_id`` are not sources of each other; extra columns
are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_scratch, hash_words, mix64, scratch, with_row_key

WINDOW, GRAM = 50, 26  # a window holds WINDOW - GRAM + 1 grams, fewer than GRAM, so runs overlap
FILTER_BITS = (1 << 16, 1 << 28)
BLOCK_REQUESTS = 1024
SLICE_BYTES = 1 << 19  # texts hashed together
LAST_ID = (1 << 63) - 1
ROW = ["_file_key", "_row_index"]
_MULT = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, from the hashes of the words, by doubling."""
    out, covered, power, have = None, 0, h, 1
    while True:
        if size & have:
            out = power if out is None else mix64(out[:len(h) - covered - have + 1] * _MULT + power[covered:covered + len(h) - covered - have + 1])
            covered += have
        if covered == size:
            return out
        power = mix64(power[:len(power) - have] * _MULT + power[have:])
        have *= 2


def runs(texts: list[bytes], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of all texts of a slice, hashed in one buffer: text number, minimizer hash, run key, first
    window in its text, windows; then the hashes of all windows of the buffer and where each run starts
    there. Windows that would cross from one text into the next belong to no run."""
    starts, h = hash_words(b"\n".join(texts))
    begin = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))  # first word of each text
    per = window - gram + 1
    if len(h) < window:
        return (*[np.zeros(0, np.int64)] * 5, np.zeros(0, np.int64), np.zeros(0, np.int64))
    g, w = gram_hashes(h, gram).view(np.int64), gram_hashes(h, window)
    at = np.lib.stride_tricks.sliding_window_view(g, per).argmin(axis=1) + np.arange(len(w))
    counts = np.maximum(np.diff(begin) - window + 1, 0)
    valid = np.repeat(begin[:-1], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    if not len(valid):
        return (*[np.zeros(0, np.int64)] * 5, w.view(np.int64), np.zeros(0, np.int64))
    text = np.repeat(np.arange(len(texts)), counts)
    new = np.concatenate([[True], (at[valid[1:]] != at[valid[:-1]]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate([first, [len(valid)]]))
    a = valid[first]
    key = mix64(mix64(w[a] * _MULT + w[a + n - 1]) + n.astype(np.uint64))
    return text[first], g[at[a]], key.view(np.int64), a - begin[text[first]], n, w.view(np.int64), a


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch in slices of about ``SLICE_BYTES``, with the place of the first."""
    at, texts, size = 0, [], 0
    for v in batch.column("_bin"):
        texts.append(v.as_py() or b"")
        size += len(texts[-1])
        if size > SLICE_BYTES:
            yield at, texts
            at, texts, size = at + len(texts), [], 0
    if texts:
        yield at, texts


def _grams(window: int, gram: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = np.asarray(b.column("doc"), np.int64)
            for at, texts in _slices(b):
                with np.errstate(over="ignore"):
                    text, h, key, *_ = runs(texts, window, gram)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(doc[at + text]), pa.array(key)], names=["h", "doc", "key"])

    return run


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """One bit per hash; Spark builds it in 4 KB buckets."""
    bit = F.pmod("h", F.lit(bits))
    got = (hashes.select(F.floor(bit / 32768).alias("b"), F.pmod(bit, F.lit(32768)).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect())
    out = np.zeros(bits // 8, np.uint8)
    for r in got:
        out[r["b"] * 4096:r["b"] * 4096 + 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    return out


def _has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = h.view(np.uint64) & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _edges(shared, window: int, gram: int):
    """Per document: words, digest of all of them, and its edges (runs, or single windows)."""
    names = [*ROW, "doc_id", "doc", "n_words", "sha", "edges"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, mixed = shared.value
        for b in batches:
            for at, texts in _slices(b):
                with np.errstate(over="ignore"):
                    text, h, key, a, n, w, place = runs(texts, window, gram)
                keep = _has(repeated, h)
                single = keep & _has(mixed, h)
                whole = keep & ~single
                # the windows of a run that is dealt out one by one
                m = n[single]
                off = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                cols = [np.concatenate([x[whole], y]) for x, y in (
                    (text, np.repeat(text[single], m)), (h, np.repeat(h[single], m)), (key, w[np.repeat(place[single], m) + off]),
                    (a, np.repeat(a[single], m) + off), (n, np.ones(len(off), np.int64)))]
                order = np.argsort(cols[0], kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(cols[0], minlength=len(texts)))])
                edges = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays(
                    [pa.array(c[order].astype(np.int64)) for c in cols[1:]], names=["h", "key", "a", "n"]))
                words = [t.split() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c).slice(at, len(texts)) for c in (*ROW, "doc_id", "doc")], pa.array([len(x) for x in words], pa.int64()),
                     pa.array([hashlib.sha256(b" ".join(x)).hexdigest() for x in words]), edges], names=names)

    return run


def compacted(links: DataFrame) -> DataFrame:
    """``links``: ``(x, y)`` with at most one x per y and one y per x, without cycles. The first node
    of each path for every node that has a predecessor: ``(node, head)``."""
    cur = scratch(links.select(F.col("y").alias("node"), F.col("x").alias("jump")), "debruijn-jumps")
    done = []
    while True:
        to = cur.select(F.col("node").alias("_n"), F.col("jump").alias("_j"))
        for d in done:  # a node whose head is known hands it on
            to = to.unionByName(d.select(F.col("node").alias("_n"), F.col("head").alias("_j")))
        step = scratch(cur.join(to, cur["jump"] == to["_n"], "left").select("node", "jump", F.col("_j").alias("next")), "debruijn-step")
        drop_scratch(cur)
        done.append(step.filter("next IS NULL").select("node", F.col("jump").alias("head")))
        rest = step.filter("next IS NOT NULL").select("node", F.col("next").alias("jump"))
        if rest.limit(1).count() == 0:
            out = done[0]
            for d in done[1:]:
                out = out.unionByName(d)
            return out
        cur = scratch(rest, "debruijn-jumps")


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (row, block), the text (start null) first; digests of word ranges."""
    held, words = None, []
    for b in batches:
        out = []
        for fk, ri, block, start, length, text in zip(*[b.column(c).to_pylist() for c in (*ROW, "block", "start", "len", "_bin")]):
            if start is None:
                held, words = (fk, ri, block), text.split()
                continue
            if held != (fk, ri, block):
                raise ValueError("a request without its text")
            out.append((fk, ri, start, length, hashlib.blake2b(b" ".join(words[start:start + length]), digest_size=16).digest()))
        if out:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[*ROW, "start", "len", "digest"])


def word_digests(requests: DataFrame, texts: DataFrame) -> DataFrame:
    """``requests``: distinct ``(row, start, len)``; adds the digest of those words."""
    q = requests.join(requests.groupBy(*ROW).agg(F.count(F.lit(1)).alias("c")), ROW)
    q = q.select(*ROW, F.pmod(F.xxhash64("start", "len"), F.ceil(F.col("c") / BLOCK_REQUESTS)).cast("int").alias("block"), "start", "len")
    heads = q.select(*ROW, "block").distinct().join(texts, ROW).select(*ROW, "block", F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("len"), "_bin")
    x = heads.unionByName(q.withColumn("_bin", F.lit(None).cast("binary")))
    x = x.repartition(*ROW, "block").sortWithinPartitions(*ROW, "block", F.col("start").asc_nulls_first())
    return x.mapInArrow(_digests, "_file_key bigint, _row_index bigint, start bigint, len bigint, digest binary")


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        removed, shas, kept_words = [], [], []
        for text, spans in zip(b.column("_bin").to_pylist(), b.column("spans").to_pylist()):
            words = text.split()
            gone = np.zeros(len(words) + 1, np.int64)
            for s in spans:
                gone[s["start"]] += 1
                gone[s["start"] + s["len"]] -= 1
            keep = np.cumsum(gone)[:-1] == 0
            kept = b" ".join([w for w, k in zip(words, keep.tolist()) if k])
            removed.append(int(len(words) - keep.sum()))
            shas.append(hashlib.sha256(kept).hexdigest())
            kept_words.append(kept.decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([b.column(ROW[0]), b.column(ROW[1]), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(kept_words, pa.string())],
                                         names=[*ROW, "n_removed", "kept_sha256", "kept_text"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with ``doc_id, n_words, sha``; texts of all rows that take part; verified spans: the row,
    ``start, len`` in words, and the coordinates of the source (``source_doc, s_*``)."""
    if not window - gram + 1 < gram <= window:
        raise ValueError("a run of windows must be covered by its first and last window")
    sc = docs.sparkSession.sparkContext
    keyed = with_row_key(docs).select(*ROW, F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST_ID)).alias("doc"),
                                      F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_bin"))
    grams = keyed.select("doc", "_bin").mapInArrow(_grams(window, gram), "h bigint, doc bigint, key bigint").groupBy("h").agg(
        F.min("doc").alias("lo"), F.max("doc").alias("hi"), (F.min("key") != F.max("key")).alias("mixed"))
    grams = scratch(grams.filter("lo < hi").select("h", "mixed"), "debruijn-grams")
    n, bits = grams.count(), FILTER_BITS[0]
    while bits < 16 * n and bits < FILTER_BITS[1]:
        bits *= 2
    shared = sc.broadcast((_bitmap(grams, bits), _bitmap(grams.filter("mixed"), bits)))
    rows = scratch(keyed.mapInArrow(_edges(shared, window, gram), "_file_key bigint, _row_index bigint, doc_id bigint, doc bigint, n_words bigint, sha string, "
                                    "edges array<struct<h:bigint,key:bigint,a:bigint,n:bigint>>"), "debruijn-rows")
    edges = rows.select(*ROW, "doc", F.inline("edges"))
    source = F.min(F.struct("doc", *ROW, "a")).alias("s")
    nodes = edges.groupBy("h", "key").agg(source, F.max("doc").alias("hi")).filter("s.doc < hi")
    nodes = scratch(nodes.select("h", "key", "s").withColumn("node", F.monotonically_increasing_id()), "debruijn-nodes")
    seen = scratch(edges.join(nodes, ["h", "key"]).select(*ROW, "doc", "a", "n", "node", "s"), "debruijn-seen")
    # links between neighbours; a link is compacted if neither end branches and the sources are adjacent
    along = Window.partitionBy(*ROW).orderBy("a")
    step = seen.select("node", "n", "a", "s", F.lead(F.struct("node", "a", "s")).over(along).alias("next")).filter("next.a = a + n")
    adjacent = (F.col("s._file_key") == F.col("next.s._file_key")) & (F.col("s._row_index") == F.col("next.s._row_index")) & (F.col("next.s.a") == F.col("s.a") + F.col("n"))
    links = scratch(step.select(F.col("node").alias("x"), F.col("next.node").alias("y"), adjacent.alias("adjacent")).distinct(), "debruijn-links")
    out = links.groupBy("x").agg(F.count(F.lit(1)).alias("c")).filter("c = 1").select("x")
    into = links.groupBy("y").agg(F.count(F.lit(1)).alias("c")).filter("c = 1").select("y")
    heads = compacted(links.filter("adjacent").join(out, "x").join(into, "y").select("x", "y"))
    heads = heads.select(F.col("node").alias("_n"), "head")
    # occurrences with a smaller source, merged along their path
    mine = seen.filter("s.doc < doc")
    mine = mine.join(heads, mine["node"] == heads["_n"], "left").withColumn("path", F.coalesce("head", "node"))
    fresh = (F.col("path") != F.lag("path").over(along)) | (F.col("a") != F.lag(F.col("a") + F.col("n")).over(along)) | (F.col("a") - F.col("s.a") != F.lag(F.col("a") - F.col("s.a")).over(along))
    mine = mine.withColumn("_new", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("_no", F.sum("_new").over(along))
    spans = mine.groupBy(*ROW, "_no").agg(F.first("doc").alias("doc"), F.min("a").alias("start"), (F.sum("n") + window - 1).alias("len"), F.min("s").alias("s"))
    spans = scratch(spans.select(*ROW, "start", "len", F.col("s.doc").alias("source_doc"), F.col("s._file_key").alias("s_file_key"),
                                 F.col("s._row_index").alias("s_row_index"), F.col("s.a").alias("s_start")), "debruijn-spans")
    there = spans.select(F.col("s_file_key").alias(ROW[0]), F.col("s_row_index").alias(ROW[1]), F.col("s_start").alias("start"), "len")
    requests = scratch(spans.select(*ROW, "start", "len").unionByName(there).distinct(), "debruijn-requests")
    texts = scratch(keyed.select(*ROW, "_bin").join(requests.select(*ROW).distinct(), ROW), "debruijn-texts")
    d = scratch(word_digests(requests, texts), "debruijn-digests")
    s = d.select(F.col(ROW[0]).alias("s_file_key"), F.col(ROW[1]).alias("s_row_index"), F.col("start").alias("s_start"), "len", F.col("digest").alias("_sd"))
    good = spans.join(d, [*ROW, "start", "len"]).join(s, ["s_file_key", "s_row_index", "s_start", "len"]).filter("digest = _sd").drop("digest", "_sd")
    return rows.select(*ROW, "doc_id", "n_words", "sha"), texts, good


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row: ``doc_id, n_words, n_removed, kept_sha256`` and ``kept_text`` (null if nothing was
    removed: then it is the text's words joined by one blank)."""
    rows, texts, spans = repeated_spans(docs, id_col, text_col, window, gram)
    per = spans.groupBy(*ROW).agg(F.collect_list(F.struct("start", "len")).alias("spans"))
    cut = texts.join(per, ROW).mapInArrow(_cut, "_file_key bigint, _row_index bigint, n_removed bigint, kept_sha256 string, kept_text string")
    return rows.join(cut, ROW, "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept_text")
