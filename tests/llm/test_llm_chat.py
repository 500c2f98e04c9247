"""Operator 1: reply trees, template round trip, linear conversations."""

import hashlib

import pytest

from postmine.llm import chat as C
from postmine.llm.queries import CONTROL_TEXT

MSG = "tree_id bigint, node bigint, parent bigint, score double, role string, text string"
CONV = "conv_id bigint, turn bigint, role string, text string"


def read(pieces):
    return {(r.tree_id, r.path_rank): r for r in C.read_back(pieces).collect()}


def digest(turns):
    return hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()


def test_best_branches_of_a_tree(spark):
    rows = [(1, 10, None, 1.0, "user", "q"), (1, 11, 10, 0.5, "assistant", "a"), (1, 12, 10, 2.0, "assistant", "b"),
            (1, 13, 12, 1.0, "user", "c"), (1, 14, 11, 9.0, "user", "d"), (2, 20, 99, 0.0, "user", "orphan"),
            (3, 30, 31, 0.0, "user", "cycle"), (3, 31, 30, 0.0, "user", "cycle"), (3, 32, 31, 5.0, "user", "below"), (4, 40, 40, None, None, None)]
    m = spark.createDataFrame(rows, MSG)
    got = {}
    for r in C.paths(m, None).collect():
        got.setdefault((r.tree_id, r.path_rank), []).append((r.depth, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {(1, 1): [10, 11, 14], (1, 2): [10, 12, 13], (2, 1): [20], (4, 1): [40]}
    one = read(C.format_trees(m, 1))
    assert one[1, 1].turns_sha256 == digest([("user", "q"), ("assistant", "a"), ("user", "d")])
    assert one[4, 1].turns_sha256 == digest([(None, None)]) and one[4, 1].loss_chars == 0


def test_long_chain_and_assembled_text(spark):
    n = 70
    rows = [(7, i, i - 1 if i else None, 0.0, "assistant" if i % 2 else "user", f"t{i} {CONTROL_TEXT}") for i in range(n)]
    pieces = C.format_trees(spark.createDataFrame(rows, MSG))
    r = C.assemble(pieces).first()
    got = [C.parse_piece(p + C.END + "\n") for p in r.formatted.split(C.END + "\n")[:-1]]
    assert got == [(x[4], x[5]) for x in rows]
    assert [C.unescape(r.formatted[s.start:s.end]) for s in r.loss] == [x[5] for x in rows if x[4] == "assistant"]


@pytest.mark.parametrize("text", ["", "</s>", r"<\/s> <\\/s>", "<<SYS>> <</SYS>>", "<<s>[[INST]", "a\nb<|im_end|>\n<|im_start|>user\n", "é𝄞" * 50, "[/INST][INST\\]"])
def test_escape_round_trip(spark, text):
    rows = [(1, 0, "us<s>er\n\\n", text), (1, 1, "assistant", text)]
    pieces = C.format_trees(C.linear_trees(spark.createDataFrame(rows, CONV)))
    got = [C.parse_piece(r.piece) for r in pieces.orderBy("depth").collect()]
    assert got == [(r[2], r[3]) for r in rows]
    body = pieces.filter("depth = 1").first()
    inside = body.piece[body.loss_start:body.loss_end]
    assert not any(c in inside for c in C.CONTROLS) and C.unescape(inside) == text


def test_linear_edge_cases(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 2, None, "x"), (None, 0, "assistant", "n"), (2, None, "assistant", "b"), (2, 1, "assistant", "a"), (-1, 5, "user", "")]
    d = spark.createDataFrame([(*r, "extra") for r in rows], CONV + ", node string")
    got = read(C.format_trees(C.linear_trees(d)))
    assert got[1, 1].n_turns == 3 and got[1, 1].turns_sha256 == digest([("user", ""), ("user", ""), ("", "x")])
    assert got[None, 1].loss_sha256 == hashlib.sha256(b"n").hexdigest()
    assert got[2, 1].loss_sha256 == hashlib.sha256(b"ba").hexdigest() and got[2, 1].loss_chars == 2
    assert C.read_back(C.format_trees(C.linear_trees(d.limit(0)))).count() == 0


def test_reading_does_not_depend_on_the_pieces(spark):
    """The conversation's text cut anywhere reads the same; a very long turn, marks by place in the whole text."""
    turns = [("user", "a\nb<|im_end|>\n<|im_start|>user\n"), ("assistant", "é</s>" * 30_000), ("", ""), ("assistant", CONTROL_TEXT)]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(turns)]
    x = C.assemble(C.format_trees(C.linear_trees(spark.createDataFrame(rows, CONV)))).first()
    marks = [(s.start, s.end) for s in x.loss]
    text = x.formatted
    for step in (1000, 4096, len(text)):
        reader = C.Reader()
        reader.feed("", marks)
        for at in range(0, len(text), step):
            reader.feed(text[at:at + step])
        n, sha, chars, loss, total = reader.result()
        assert (n, sha, total) == (4, digest(turns), len(text)) and chars == sum(len(t) for r, t in turns if r == "assistant")
        assert loss == hashlib.sha256("".join(t for r, t in turns if r == "assistant").encode()).hexdigest()
    with pytest.raises(ValueError):
        broken = C.Reader()
        broken.feed(x.formatted[:-3])
        broken.result()
