"""Chat formatting of reply trees (operator 1).

A message points to its parent. Iterative self-joins with doubling jumps give every message its
depth and the score of the path from its root (``log2(depth)`` joins, no per-tree task); leaves are
ranked within their tree by path score; the messages of the chosen paths are enumerated by the stored
jump tables, one self-join per table; each path is then formatted turn by turn.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. A control string inside a role or text gets
one backslash after its first character, and one that already has backslashes there gets one more, so
reading back removes exactly one. Newlines in a role are written as ``\\\\n`` (backslashes doubled).
The loss mask covers the text of assistant turns, without markers.

Defined cases: null text is empty, null role is the empty role; a message whose parent is missing from
its tree is a root; messages in or below a cycle have no root and belong to no path; repeated rows of
a linear conversation are turns of their own, ties in ``turn`` are ordered by role and text; an empty
table gives no path.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import indexed, scratch

START, END = "<|im_start|>", "<|im_end|>"
# Control strings of common chat templates; each is escaped inside texts.
CONTROLS = (START, END, "<|im_sep|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def _alternatives() -> str:
    tails = sorted({c[1:] for c in CONTROLS if not c.startswith("<<")} | {c[2:] for c in CONTROLS if c.startswith("<<")}, key=len, reverse=True)
    return "|".join(re.escape(t) for t in tails)


# first character, backslashes, rest of a control string
ESCAPE_PATTERN = r"([<\[])(\\*)(" + _alternatives() + ")"
UNESCAPE = re.compile(r"([<\[])\\(\\*)(" + _alternatives() + ")")


def escape(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPE_PATTERN, r"$1\\$2$3")


def escape_role(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape(s: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", s)


def unescape_role(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(s), flags=re.S)


# ----------------------------------------------------------------------------------------------
# reply trees
# ----------------------------------------------------------------------------------------------
def paths(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """``messages``: ``tree_id, node, parent, score`` (node unique). Returns ``tree_id, path_rank,
    leaf, depth, node`` for the ``top`` best paths of each tree (None: all), best first."""
    m = messages.select("tree_id", "node", "parent", F.coalesce(F.col("score"), F.lit(0.0)).cast("double").alias("score"))
    p = m.select(F.col("node").alias("_p"), F.col("tree_id").alias("_t"))
    m = m.join(p, (m["parent"] == p["_p"]) & m["tree_id"].eqNullSafe(p["_t"]) & (m["parent"] != m["node"]), "left")
    m = m.select("tree_id", "node", F.col("_p").alias("jump"), "score", F.lit(0).cast("bigint").alias("depth"))
    # level k: jump = ancestor 2**k steps up; depth and score of the steps already taken
    jumps: list[DataFrame] = []
    done: list[DataFrame] = []
    nodes = None
    cur = scratch(m, "chat-jump0")
    while True:
        done.append(cur.filter("jump IS NULL").drop("jump"))
        open_ = cur.filter("jump IS NOT NULL")
        n = open_.count()
        if nodes is None:
            nodes = n + 1
        if n == 0 or 2 ** len(jumps) > 2 * nodes:  # what is open now lies in or below a cycle
            break
        step = open_.select("node", "jump")
        jumps.append(step)
        k = len(jumps) - 1
        up = cur.select(F.col("node").alias("_n"), F.col("jump").alias("_j"), F.col("score").alias("_s"), F.col("depth").alias("_d"))
        for d in done[:-1]:  # nodes that reached their root on an earlier level
            up = up.unionByName(d.select(F.col("node").alias("_n"), F.lit(None).cast("bigint").alias("_j"), F.col("score").alias("_s"), F.col("depth").alias("_d")))
        nxt = open_.join(up, open_["jump"] == up["_n"]).select(
            "tree_id", "node", F.col("_j").alias("jump"), (F.col("score") + F.col("_s")).alias("score"),
            # only a jump target that has reached its root knows its depth
            F.when(F.col("_j").isNull(), F.col("_d") + 2**k).otherwise(F.lit(0)).cast("bigint").alias("depth"))
        cur = scratch(nxt, f"chat-jump{k + 1}")
    rooted = done[0]
    for d in done[1:]:
        rooted = rooted.unionByName(d)
    parents = jumps[0].select(F.col("jump").alias("node")) if jumps else None
    leaves = rooted.join(parents, "node", "left_anti") if parents is not None else rooted
    best_first = Window.partitionBy("tree_id").orderBy(F.col("score").desc(), F.col("node"))
    leaves = leaves.withColumn("path_rank", F.row_number().over(best_first))
    if top is not None:
        leaves = leaves.filter(F.col("path_rank") <= top)
    # ancestors of the chosen leaves: the members so far jump by 2**k, from the largest k down; the
    # new members of each level are a table of their own, so the plan grows by one branch a level
    members = [scratch(leaves.select("tree_id", "path_rank", F.col("node").alias("leaf"), "depth", "node"), "chat-leaves")]
    for k in reversed(range(len(jumps))):
        j = jumps[k].withColumnsRenamed({"node": "_n", "jump": "_j"})
        far = reduce(DataFrame.unionByName, members).filter(F.col("depth") >= 2**k)
        up = far.join(j, far["node"] == j["_n"]).select("tree_id", "path_rank", "leaf", (F.col("depth") - 2**k).alias("depth"), F.col("_j").alias("node"))
        members.append(scratch(up, "chat-members"))
    return reduce(DataFrame.unionByName, members)


def format_turns(turns: DataFrame) -> DataFrame:
    """``turns``: any columns plus ``role, text``. Adds ``piece`` (the formatted turn) and
    ``loss_start, loss_end`` (code points of the loss mask inside the piece; equal: none)."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    x = turns.withColumn("_head", head).withColumn("_body", escape(text))
    start = F.length("_head").cast("bigint")
    return x.select(
        *[c for c in turns.columns if c not in ("role", "text")], F.concat("_head", "_body", F.lit(END + "\n")).alias("piece"),
        start.alias("loss_start"), F.when(role == "assistant", start + F.length("_body")).otherwise(start).cast("bigint").alias("loss_end"))


def format_trees(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """``messages``: ``tree_id, node, parent, score, role, text``. One row per turn of each chosen path:
    ``tree_id, path_rank, leaf, depth, piece, loss_start, loss_end``; a conversation is the
    concatenation of its pieces by ``depth``."""
    chosen = paths(messages, top)
    body = messages.select(F.col("node").alias("_n"), "role", "text")
    x = chosen.join(body, chosen["node"] == body["_n"]).drop("_n", "node")
    return format_turns(x)


def assemble(pieces: DataFrame) -> DataFrame:
    """One row per conversation: ``tree_id, path_rank, formatted, loss`` (array of ``start, end`` in
    code points of ``formatted``). For trees whose paths fit in a row."""
    g = pieces.groupBy("tree_id", "path_rank").agg(F.sort_array(F.collect_list(F.struct("depth", "piece", "loss_start", "loss_end"))).alias("t"))
    ends = F.aggregate("t", F.array(F.lit(0).cast("bigint")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x["piece"]))))
    g = g.withColumn("_at", ends)
    loss = F.filter(F.transform("t", lambda x, i: F.struct((F.col("_at")[i] + x["loss_start"]).alias("start"), (F.col("_at")[i] + x["loss_end"]).alias("end"))),
                    lambda s: s["end"] > s["start"])
    return g.select("tree_id", "path_rank", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), loss.alias("loss"))


def parse_piece(piece: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    if not piece.startswith(START) or not piece.endswith(END + "\n"):
        raise ValueError("not a formatted turn")
    role, _, text = piece[len(START):-len(END) - 1].partition("\n")
    return unescape_role(role), unescape(text)


class Reader:
    """Reads one formatted conversation from its text, in whatever pieces that arrives: turns end at the end
    marker (inside texts it is escaped), the loss mask is given by places in the whole text. Holds the
    unfinished turn and two hash states."""

    def __init__(self):
        self.open, self.at = "", 0  # what has no end marker yet, and its place
        self.spans: deque[tuple[int, int]] = deque()
        self.turns = self.loss_chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, text: str, spans: Iterable[tuple[int, int]] = ()) -> None:
        self.spans.extend(spans)
        start = max(0, len(self.open) - len(END))
        self.open += text
        while (i := self.open.find(END + "\n", start)) >= 0:
            turn, self.open = self.open[:i + len(END) + 1], self.open[i + len(END) + 1:]
            role, body = parse_piece(turn)
            self.turns += 1
            self.all.update(f"{role}\n{body}\n".encode())
            while self.spans and self.spans[0][1] <= self.at + len(turn):
                a, e = self.spans.popleft()
                lost = unescape(turn[a - self.at:e - self.at])
                self.loss_chars += len(lost)
                self.loss.update(lost.encode())
            self.at += len(turn)
            start = 0

    def result(self) -> tuple:
        if self.open or self.spans:
            raise ValueError("a conversation that does not end with a turn")
        return self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.at


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads sorted conversations as streams of text."""
    names = ["tree_id", "path_rank", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    cur, reader, place, rows = None, None, 0, []

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for b in batches:
        for tree, rank, piece, a, e in zip(*[b.column(c).to_pylist() for c in ("tree_id", "path_rank", "piece", "loss_start", "loss_end")]):
            if (tree, rank) != cur:
                if cur is not None:
                    rows.append((*cur, *reader.result()))
                cur, reader, place = (tree, rank), Reader(), 0
            reader.feed(piece, [(place + a, place + e)] if e > a else ())
            place += len(piece)
        if len(rows) > 5000:
            yield batch(rows)
            rows = []
    if cur is not None:
        rows.append((*cur, *reader.result()))
    if rows:
        yield batch(rows)


def read_back(pieces: DataFrame) -> DataFrame:
    """Per conversation, read from its formatted text and loss mask: number of turns, SHA-256 of
    ``role\\ntext\\n`` of all turns, length and SHA-256 of the unescaped text under the loss mask,
    length of the formatted text."""
    x = pieces.select("tree_id", F.col("path_rank").cast("bigint").alias("path_rank"), "depth", "piece", "loss_start", "loss_end")
    x = x.repartition("tree_id", "path_rank").sortWithinPartitions("tree_id", "path_rank", "depth").drop("depth")
    return x.mapInArrow(_digest, "tree_id bigint, path_rank bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def linear_trees(conversations: DataFrame) -> DataFrame:
    """Turn-by-turn conversations as trees: each turn answers the one before it. Order by ``turn``,
    then role and text."""
    c = conversations.select(F.col("conv_id").cast("bigint").alias("tree_id"), "turn", "role", "text")
    x = indexed(c, ["tree_id", "turn"], "chat-turns", then=("role", "text"))
    x = x.withColumnRenamed("_idx", "node")
    before = x.select((F.col("node") + 1).alias("_n"), F.col("tree_id").alias("_t"), F.col("node").alias("parent"))
    x = x.join(before, (x["node"] == before["_n"]) & x["tree_id"].eqNullSafe(before["_t"]), "left")
    return x.select("tree_id", "node", "parent", F.lit(0.0).alias("score"), "role", "text")
