"""Batching operators: analysis batch plan (B1, B4), size packing (B2), caps (B3), chunker (G1).

Scale notes
-----------
* B1 needs an exact arrival rank only for the first ``head`` posts of a page (16 with the defaults);
  every later post lands in the last batch. The rank is therefore a top-k window (Spark plans a
  partial ``WindowGroupLimit`` before the shuffle), joined back on ``(page_url, seq)``; a page holding
  a third of all posts is never sorted in one task.
* B2 deals the candidates over tasks in sorted ranges. A range is summarised as a step function of the size that
  a batch open at its start may have. These functions compose, so the state at the start of every range comes
  from a tree over the ranges of a page (compose upwards, hand states down), and each range is folded from
  its true entry. The borders are those of one fold over the whole page.
* G1 is a per-row generator (no shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, small_batches

# Batch plan of the scroll loop (initial batch, chunk size, rounds) and chunker sizes.
INITIAL_BATCH = 10
CHUNK_SIZE = 3
MAX_ROUNDS = 3
CHUNK_MAX_CHARS = 12000
CHUNK_OVERLAP = 300
# Request packing limit and item caps.
BATCH_CHAR_LIMIT = 10000
MAX_ITEMS_PER_REQUEST = 50
# [ours] at most 2 ** RANGE_BITS blocks are folded as one range; results do not depend on it.
RANGE_BITS = 17
# [ours] ranges whose summaries meet in one task; results do not depend on it.
FAN = 64


def head_size(initial: int = INITIAL_BATCH, chunk: int = CHUNK_SIZE, rounds: int = MAX_ROUNDS) -> int:
    """Number of leading posts per page whose batch depends on their exact rank."""
    return max(initial + (rounds - 1) * chunk, rounds * chunk)


def batch_of(rn: Column, n: Column, initial: int, chunk: int, rounds: int) -> Column:
    """Closed form of the scroll loop for a static page with ``n`` posts (rank ``rn`` 1-based)."""
    big = F.when(rn <= initial, F.lit(0)).otherwise(
        F.lit(1) + F.least(F.floor((rn - initial - 1) / chunk).cast("int"), F.lit(rounds - 1))
    )
    small = F.least(F.floor((rn - 1) / chunk).cast("int"), F.lit(rounds))
    return F.when(n >= initial, big).otherwise(small).cast("int")


def top_k_by(df: DataFrame, keys, order, k: int, rank_col: str = "rn") -> DataFrame:
    """First ``k`` rows per key by ``order`` (row_number <= k; planned as a group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def _allow_group_limit(df: DataFrame, k: int) -> None:
    """Spark plans the partial group limit of a top-k window up to a threshold; keep it for ``k``."""
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    if int(df.sparkSession.conf.get(key, "1000")) < k:
        df.sparkSession.conf.set(key, str(k))


def plan_batches(
    posts: DataFrame,
    initial: int = INITIAL_BATCH,
    chunk: int = CHUNK_SIZE,
    rounds: int = MAX_ROUNDS,
    offset: int = 0,
    max_batches: int | None = None,
    page_col: str = "page_url",
    seq_col: str = "seq",
) -> DataFrame:
    """B1 + B4: add ``batch_id`` (and ``rn`` for the leading posts) to distinct posts.

    ``posts`` must be distinct per ``(page_col, post)`` (see :func:`distinct_posts`); ``seq`` gives the
    arrival order. ``offset`` skips posts already processed; ``max_batches`` keeps the first batches.
    """
    head_k = offset + head_size(initial, chunk, rounds)
    _allow_group_limit(posts, head_k)
    # count(seq) (not count(*)) keeps every branch reading the same columns of ``posts``, so when
    # ``posts`` is an aggregation (the de-dup) its shuffle is planned once and reused by all three
    counts = posts.groupBy(page_col).agg(F.count(seq_col).alias("n_posts"))
    head = top_k_by(posts.select(page_col, seq_col), [page_col], [F.col(seq_col)], head_k)
    head = head.join(counts, page_col)
    rn_eff = F.col("rn") - offset
    n_eff = F.col("n_posts") - offset
    out = (
        posts.join(head, [page_col, seq_col], "left")
        .filter(F.col("rn").isNull() | (F.col("rn") > offset))
        .withColumn(
            "batch_id",
            F.when(F.col("rn").isNull(), F.lit(rounds)).otherwise(batch_of(rn_eff, n_eff, initial, chunk, rounds)),
        )
        .drop("n_posts")
    )
    if max_batches is not None:
        out = out.filter(F.col("batch_id") < max_batches)
    return out


# ----------------------------------------------------------------------------------------------
# G1 overlapping chunker
# ----------------------------------------------------------------------------------------------
def chunk_starts(n: Column, max_chars: int, overlap: int) -> Column:
    """0-based chunk starts: one chunk when ``n <= max``; else step ``max - overlap`` up to the chunk
    that reaches the end."""
    step = max_chars - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than max_chars")
    last = F.ceil((n - max_chars) / step).cast("int") * step
    return F.when(n <= max_chars, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), last, F.lit(step)))


def chunk_text(
    df: DataFrame,
    col: str = "text",
    max_chars: int = CHUNK_MAX_CHARS,
    overlap: int = CHUNK_OVERLAP,
    keep: list[str] | None = None,
) -> DataFrame:
    """G1: one row per chunk ``(…keep, chunk_no, start, chunk)``; ``start`` is 0-based."""
    keep = keep if keep is not None else [c for c in df.columns if c != col]
    n = F.length(F.coalesce(F.col(col), F.lit("")))
    starts = chunk_starts(n, max_chars, overlap)
    t = F.coalesce(F.col(col), F.lit(""))
    return df.select(*keep, F.posexplode(starts).alias("chunk_no", "start"), t.alias("_t")).select(
        *keep,
        "chunk_no",
        "start",
        F.expr(f"substring(_t, start + 1, {max_chars})").alias("chunk"),
    )


# ----------------------------------------------------------------------------------------------
# B2 greedy size packing
# ----------------------------------------------------------------------------------------------
_OPEN = -(1 << 62)  # lower bound of the last step: every size


def _next_start(lens, limit: int):
    """Start of the batch after the one that starts at each block; a first block always fits."""
    import numpy as np

    sums = np.concatenate([[0], np.cumsum(lens)])
    return np.maximum(np.searchsorted(sums, sums[:-1] + limit, "right") - 1, np.arange(1, len(lens) + 1)), sums


def _summary(limit: int):
    """A range of blocks as a function of the batch open at its start, in steps: a batch of more than ``low``
    (and not more than the step before says) ends in the range, then ``n`` batches start there, and ``size``,
    ``at`` describe the one open at its end. The last step, ``n = 0``, is for a batch that takes the whole range.
    A batch that takes no more blocks is of the first step."""
    cols = ["_page", "_part", "_sub", "_k", "low", "n", "size", "at"]

    def of(key, lens):
        import numpy as np
        import pandas as pd

        lens = np.concatenate(lens)
        total = len(lens)
        after, sums = _next_start(lens, limit)
        # batches from each block on and the last of them, by doubling jumps
        jump = np.append(after, total)
        n, last = np.append(np.ones(total, np.int64), 0), np.append(np.arange(total), total)
        while (jump[:-1] < total).any():
            last = np.where(jump < total, last[jump], last)
            n, jump = n + n[jump], jump[jump]
        first = np.flatnonzero((sums[:-1] <= limit) & ((lens > 0) | (np.arange(total) == 0)))
        end = last[first]
        return pd.DataFrame(dict(zip(cols, (
            *key, np.arange(len(first) + 1), [*(limit - sums[first + 1]), _OPEN], [*n[first], 0],
            [*(sums[total] - sums[end]), sums[total]], [*(total - end), total]))))

    def run(frames):
        key, lens = None, []
        for f in frames:
            for k, g in f.groupby(["_page", "_part", "_sub"], sort=False):
                if k != key and lens:
                    yield of(key, lens)
                    lens = []
                key = k
                lens.append(g["_len"].to_numpy())
        if lens:
            yield of(key, lens)

    return run


def compose(f, g):
    """The function of two neighbouring ranges: rows ``low, n, size, at`` of ``f`` followed by ``g``. It has at
    most as many steps as there are sizes."""
    import numpy as np

    def then(n, size, at):  # what g makes of a state that f leaves
        row = np.searchsorted(-g[0], -size, "right")
        new = g[1][row] > 0
        return n + g[1][row], np.where(new, g[2][row], size + g[2][row]), np.where(new, g[3][row], at + g[3][row])

    inside = f[1] > 0
    low, (n, size, at) = f[0][inside], then(f[1][inside], f[2][inside], f[3][inside])
    if not inside[-1]:  # a batch that takes all of f meets g with what f adds
        shifted = np.where(g[0] == _OPEN, _OPEN, g[0] - f[2][-1])
        reach = (shifted < low[-1]) & (np.concatenate([[True], shifted[:-1] >= 0]))
        go_on = g[1][reach] == 0
        low, n = np.concatenate([low, shifted[reach]]), np.concatenate([n, g[1][reach]])
        size = np.concatenate([size, g[2][reach] + go_on * f[2][-1]])
        at = np.concatenate([at, g[3][reach] + go_on * f[3][-1]])
    low[-1] = _OPEN
    same = (n[1:] == n[:-1]) & (size[1:] == size[:-1]) & (at[1:] == at[:-1]) & (n[1:] > 0)
    keep = np.concatenate([~same, [True]])
    return low[keep], n[keep], size[keep], at[keep]


def _by_child(frames):
    """Functions of a sorted stream of steps: ``(page, group), child, (low, n, size, at), first row``; one
    function is held at a time."""
    import numpy as np
    import pandas as pd

    held, parts = None, []

    def out():
        x = pd.concat(parts) if len(parts) > 1 else parts[0]
        return held[:2], held[2], tuple(x[c].to_numpy(np.int64) for c in ("low", "n", "size", "at")), x.iloc[0]

    for f in frames:
        for k, g in f.groupby(["_page", "_g", "_r"], sort=False):
            if k != held and parts:
                yield out()
                parts = []
            held = k
            parts.append(g)
    if parts:
        yield out()


def _compose(frames):
    """The function of each group of neighbours."""
    import numpy as np
    import pandas as pd

    def out(group, f):
        return pd.DataFrame({"_page": group[0], "_r": group[1], "_k": np.arange(len(f[0])), "low": f[0], "n": f[1], "size": f[2], "at": f[3]})

    at, whole = None, None
    for group, _, f, _ in _by_child(frames):
        if group != at and whole is not None:
            yield out(at, whole)
            whole = None
        at, whole = group, f if whole is None else compose(whole, f)
    if whole is not None:
        yield out(at, whole)


def _walk(frames):
    """The state at the start of each child of a group, from the group's: number of the last batch so far, its
    size (-1: it takes no more blocks) and its blocks."""
    import numpy as np
    import pandas as pd

    at_group, out = None, []
    for group, child, (low, n, more, blocks), first in _by_child(frames):
        if group != at_group:
            at_group, batch, size, at = group, int(first["_batch"]), int(first["_size"]), int(first["_at"])
        out.append((group[0], child, batch, size, at))
        k = int(np.searchsorted(-low, -size, "right")) if size >= 0 else 0
        batch += int(n[k])
        size, at = (int(more[k]), int(blocks[k])) if n[k] else (size + int(more[k]), at + int(blocks[k]))
        if len(out) >= 10_000:
            yield pd.DataFrame(out, columns=["_page", "_r", "_batch", "_size", "_at"])
            out = []
    if out:
        yield pd.DataFrame(out, columns=["_page", "_r", "_batch", "_size", "_at"])


_STEP = "_k bigint, low bigint, n bigint, size bigint, at bigint"


def _entries(per: DataFrame, fan: int) -> DataFrame:
    """The state at the start of every range, ``_page, _part, _sub, _batch, _size, _at``, by a tree over the ranges
    of a page: functions of ``fan`` neighbours are composed upwards, states handed down. No task reads more
    than ``fan`` functions."""
    along = Window.partitionBy("_page").orderBy("_part", "_sub")
    ranges = per.filter("_k = 0").select("_page", "_part", "_sub", (F.row_number().over(along) - 1).cast("bigint").alias("_r"),
                                         (~F.lag("_part").over(along).eqNullSafe(F.col("_part"))).alias("_new"))
    ranges = materialize(ranges)
    # where a part starts, no batch is open: the first step holds for every size
    steps = per.join(ranges, ["_page", "_part", "_sub"]).filter("NOT _new OR _k = 0")
    levels = [materialize(steps.select("_page", "_r", "_k", F.when(F.col("_new"), _OPEN).otherwise(F.col("low")).alias("low"), "n", "size", "at"))]
    group = F.floor(F.col("_r") / fan).cast("bigint").alias("_g")
    widest = ranges.groupBy("_page").count().agg(F.max("count")).first()[0] or 0
    while widest > fan:
        x = levels[-1].select("*", group).repartition("_page", "_g").sortWithinPartitions("_page", "_g", "_r", "_k")
        levels.append(materialize(x.mapInPandas(_compose, f"_page string, _r bigint, {_STEP}")))
        widest = -(-widest // fan)
    state = None
    for level in reversed(levels):
        x = level.select("*", group)
        if state is None:
            x = x.select("*", F.lit(-1).cast("bigint").alias("_batch"), F.lit(-1).cast("bigint").alias("_size"), F.lit(0).cast("bigint").alias("_at"))
        else:
            x = x.join(state.withColumnRenamed("_r", "_g"), ["_page", "_g"])
        x = x.repartition("_page", "_g").sortWithinPartitions("_page", "_g", "_r", "_k")
        state = x.mapInPandas(_walk, "_page string, _r bigint, _batch bigint, _size bigint, _at bigint")
    x = ranges.join(state, ["_page", "_r"])
    closed = lambda c, v: F.when(F.col("_new"), F.lit(v)).otherwise(F.col(c)).cast("bigint").alias(c)
    return x.select("_page", "_part", "_sub", "_batch", closed("_size", -1), closed("_at", 0))


def place(lens, limit: int, batch: int, size: int, at: int):
    """Batch and place of consecutive blocks from a state, and the state after them."""
    import numpy as np

    total = len(lens)
    after, sums = _next_start(lens, limit)
    start = 0 if size < 0 else int(np.searchsorted(sums[1:], limit - size, "right"))
    starts, after = [], after.tolist()
    while start < total:  # one step a batch
        starts.append(start)
        start = after[start]
    new = np.zeros(total, np.int64)
    new[starts] = 1
    no = np.cumsum(new)
    begin = np.concatenate([[-at], starts]).astype(np.int64)  # the open batch began before these blocks
    places = np.arange(total) - begin[no] + 1
    if starts:
        size, at = int(sums[total] - sums[starts[-1]]), total - starts[-1]
    else:
        size, at = size + int(sums[total]), at + total
    return batch + no, places, (batch + len(starts), size, at)


def _fold(limit: int):
    """Adds batch and place to sorted rows, each range from its entry; holds one running size."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        key, state = None, None
        for b in batches:
            cols = {c: b.column(c).to_pylist() if c == "_page" else b.column(c).to_numpy() for c in ("_page", "_part", "_sub", "_len", "_batch", "_size", "_at")}
            change = [i for i in range(1, b.num_rows) if cols["_sub"][i] != cols["_sub"][i - 1] or cols["_part"][i] != cols["_part"][i - 1] or cols["_page"][i] != cols["_page"][i - 1]]
            batch_no, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lo, hi in zip([0, *change], [*change, b.num_rows]):
                if lo == hi:
                    continue
                k = (cols["_page"][lo], cols["_part"][lo], cols["_sub"][lo])
                if k != key:
                    key, state = k, tuple(int(cols[c][lo]) for c in ("_batch", "_size", "_at"))
                x, y, state = place(cols["_len"][lo:hi], limit, *state)
                batch_no.append(x)
                places.append(y)
            kept = [c for c in b.schema.names if not c.startswith("_b2_") and c not in cols]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(np.concatenate(batch_no)), pa.array(np.concatenate(places))], names=[*kept, "cand_batch", "batch_pos"])

    return run


def pack_batches(
    cands: DataFrame,
    limit: int = BATCH_CHAR_LIMIT,
    page_col: str = "page_url",
    pos_col: str = "pos",
    text_col: str = "block",
    subpage: int | None = None,
    fan: int = FAN,
) -> DataFrame:
    """B2: order-preserving packing of every candidate; a new batch starts when ``size + len > limit``
    and the current batch is non-empty. Returns the candidates with ``cand_batch`` and ``batch_pos``, row by
    row: equal positions are ordered by their text, rows without a position come first, a null page is ``''``.

    A huge page is dealt over many tasks in ranges of at most ``2 ** RANGE_BITS`` blocks; the batch that is
    open at the end of a range goes on in the next. Only where ``subpage`` is given does a batch also end
    after each ``subpage`` consecutive positions; batch numbers continue."""
    spark = cands.sparkSession
    cands = cands.withColumn(page_col, F.coalesce(F.col(page_col), F.lit(""))).withColumn(pos_col, F.col(pos_col).cast("bigint"))
    names = {c: f"c{i}" for i, c in enumerate(cands.columns) if c not in ("cand_batch", "batch_pos")}  # free of clashes meanwhile
    pos = F.col(pos_col)
    part = F.coalesce(F.floor(pos / subpage), F.lit(-1)).cast("bigint") if subpage else F.lit(0).cast("bigint")
    x = cands.select(
        *[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col(page_col).alias("_page"), part.alias("_part"),
        F.coalesce(F.length(text_col), F.lit(0)).cast("bigint").alias("_len"), pos.alias("_b2_pos"), F.xxhash64(text_col).alias("_b2_tie"))
    key = ["_page", "_part", "_sub"]
    order = [F.col("_b2_pos").asc_nulls_first(), F.col("_b2_tie")]
    # ranges follow (page, position); the id counts the sorted rows of a task, so no range spans two tasks
    x = x.repartitionByRange("_page", *order).sortWithinPartitions("_page", *order).withColumn("_b2_row", F.monotonically_increasing_id())
    x = materialize(x.withColumn("_sub", F.shiftright("_b2_row", RANGE_BITS)))
    sizes = x.select(*key, "_len", "_b2_row").repartition(*key).sortWithinPartitions(*key, "_b2_row")
    per = materialize(sizes.mapInPandas(_summary(limit), f"_page string, _part bigint, _sub bigint, {_STEP}"))
    small_batches(spark)
    rows = x.join(_entries(per, fan), key).repartition(*key).sortWithinPartitions(*key, "_b2_row")
    types = dict(zip(cands.columns, cands.schema.fields))
    schema = ", ".join(f"{n} {types[c].dataType.simpleString()}" for c, n in names.items())
    placed = rows.mapInArrow(_fold(limit), f"{schema}, cand_batch bigint, batch_pos bigint")
    return placed.select(*[F.col(n).alias(c) for c, n in names.items()], "cand_batch", "batch_pos")


def batch_requests_items(packed: DataFrame, page_col: str = "page_url", max_items: int = MAX_ITEMS_PER_REQUEST) -> DataFrame:
    """One row per (page, cand_batch, request_no): its blocks as a JSON array. A request carries at most
    ``max_items`` blocks (B3); the rest of the batch goes into further requests."""
    x = packed.withColumn("request_no", F.floor((F.col("batch_pos") - 1) / max_items).cast("bigint"))
    return x.groupBy(page_col, "cand_batch", "request_no").agg(
        F.to_json(
            F.transform(F.array_sort(F.collect_list(F.struct("batch_pos", "block"))), lambda s: s["block"])
        ).alias("items_json"),
        F.count(F.lit(1)).alias("n_items"),
    )
