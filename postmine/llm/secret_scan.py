"""Secret scans (operator 11): fixed patterns, and Shannon entropy of sliding windows.

Three patterns find assignments, access ids and hexadecimal strings. Beside them every maximal run of
the characters of a class (``CLASSES``) that is as long as the class's window is a candidate string. A
window slides over it one character at a time; the sum of ``c * log2(c)`` over its character counts is
carried along by the count of the character that leaves and of the one that enters, in fixed-point
integers, so it is exact however long the string is. Windows of high entropy that overlap become one
span. Candidates on the allow list (``ALLOW_WORDS``, ``ALLOW_PATTERNS``) give no such span; they never
suppress a pattern's span.

A text is scanned once for long runs of the widest class; the narrower classes and the hexadecimal pattern
look inside these runs only. Windows are computed for the candidates of many texts together, in slices of
bounded size. No shuffle: each row is judged by itself.

Defined cases: null text is empty and has no span; a row is a result of its own, however often it repeats
and whatever its id (null ids are returned as null); spans of one place and kind are listed once; offsets
are code points; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# The patterns of the base (matched on ASCII lower case where letters count in either case).
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
BASE_KINDS = ("assign", "access", "hex")
UNIT = 1 << 20  # fixed point of c * log2(c)
SLICE = 1 << 20  # candidate characters whose windows are computed together


@dataclass(frozen=True)
class CharClass:
    """Windows of ``window`` characters of ``[chars]`` with at least ``bits`` of entropy are reported."""

    kind: str
    chars: str
    window: int
    bits: float

    @property
    def limit(self) -> int:
        """Largest sum of c * log2(c), in fixed point, of a window that is reported."""
        return int(np.floor(self.window * (np.log2(self.window) - self.bits) * UNIT))


CLASSES = (
    CharClass("entropy_hex", "0-9A-Fa-f", 24, 3.0),
    CharClass("entropy_alnum", "0-9A-Za-z", 20, 3.7),
    CharClass("entropy_base64", "0-9A-Za-z+/=_-", 32, 4.3),
)
# Candidates (in ASCII lower case) with one of these parts are no secrets.
ALLOW_WORDS = ("example", "placeholder", "changeme", "dummy", "0123456789", "abcdefghij", "qwertyuiop")
# Candidates that match one of these as a whole: no digit, no letter, a UUID.
ALLOW_PATTERNS = (r"[^0-9]+", r"[^A-Za-z]+", r"[0-9A-Fa-f]{8}-([0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")


def steps(window: int) -> np.ndarray:
    """``c * log2(c)`` in fixed point for the counts a window can have."""
    c = np.arange(window + 1, dtype=np.float64)
    return np.rint(c * np.log2(np.maximum(c, 1)) * UNIT).astype(np.int64)


def window_sums(x: np.ndarray, window: int) -> np.ndarray:
    """Sum of c * log2(c) over the character counts of each window of ``x``, by incremental counts: the
    change from one window to the next depends on how often the leaving and the entering character occur."""
    n = len(x)
    if n < window:
        return np.zeros(0, np.int64)
    i, g = np.arange(n, dtype=np.int64), steps(window)
    key = x.astype(np.int64) * n
    order = np.argsort(x, kind="stable")  # by character, then place
    places = (key + i)[order]
    rank = np.empty(n, np.int64)
    rank[order] = i
    enter = rank - np.searchsorted(places, key + np.maximum(0, i - window + 1))
    change = g[enter + 1] - g[enter]
    leave = np.searchsorted(places, key[:n - window] + i[window:]) - rank[:n - window]
    change[window:] += g[leave - 1] - g[leave]
    return np.cumsum(change)[window - 1:]


def dense_windows(runs: list[bytes], cls: CharClass) -> list[tuple[int, int, int]]:
    """``(run, start, end)`` of the merged windows of ``runs`` that reach the class's entropy."""
    if not runs:
        return []
    x = np.frombuffer(b"".join(runs), np.uint8)
    begin = np.cumsum([0] + [len(r) for r in runs])
    found = []
    for lo in range(0, len(x), SLICE):
        sums = window_sums(x[lo:lo + SLICE + cls.window - 1], cls.window)
        found.append(np.flatnonzero(sums <= cls.limit) + lo)
    at = np.concatenate(found)
    run = np.searchsorted(begin, at, "right") - 1
    inside = at + cls.window <= begin[run + 1]  # a window never spans two candidates
    at, run = at[inside], run[inside]
    if not len(at):
        return []
    new = np.concatenate([[True], (run[1:] != run[:-1]) | (at[1:] - at[:-1] >= cls.window)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(at)]]) - 1
    own = begin[run[first]]
    return list(zip(run[first].tolist(), (at[first] - own).tolist(), (at[last] + cls.window - own).tolist()))


class Scanner:
    """Spans of texts, in byte offsets: ``(kind number, start, end)``."""

    def __init__(self, classes: tuple[CharClass, ...] = CLASSES, allow_words=ALLOW_WORDS, allow_patterns=ALLOW_PATTERNS):
        self.classes, self.words = classes, [w.lower().encode() for w in allow_words]
        self.allow = [re.compile(p.encode()) for p in allow_patterns]
        self.assign, self.access = re.compile(ASSIGN.encode()), re.compile(ACCESS.encode())
        self.hex = re.compile(f"[0-9a-f]{{{MIN_HEX},}}".encode())
        self.kinds = [*BASE_KINDS, *(c.kind for c in classes)]
        least = min([c.window for c in classes] + [MIN_HEX])
        # every class and the hexadecimal pattern lie inside runs of these characters
        self.runs = re.compile(f"[0-9A-Za-z+/=_-]{{{least},}}".encode())
        self.inner = [re.compile(f"[{c.chars}]{{{c.window},}}".encode()) for c in classes]

    def allowed(self, run: bytes) -> bool:
        low = run.lower()
        return any(w in low for w in self.words) or any(p.fullmatch(run) for p in self.allow)

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        runs: list[list[bytes]] = [[] for _ in self.classes]
        where: list[list[tuple[int, int]]] = [[] for _ in self.classes]
        for i, text in enumerate(texts):
            out, low = spans[i], text.lower()
            if any(w.encode() in low for w in ASSIGN_WORDS):
                out += [(0, m.start(), m.end()) for m in self.assign.finditer(low) if m.end(2) - m.start(2) >= MIN_ASSIGN]
            out += [(1, m.start(), m.end()) for m in self.access.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
            for wide in self.runs.finditer(text):
                a, b = wide.span()
                out += [(2, m.start(), m.end()) for m in self.hex.finditer(text, a, b)]
                for k, p in enumerate(self.inner):
                    for m in p.finditer(text, a, b):
                        if not self.allowed(m[0]):
                            runs[k].append(m[0])
                            where[k].append((i, m.start()))
        for k, cls in enumerate(self.classes):
            for r, start, end in dense_windows(runs[k], cls):
                i, at = where[k][r]
                spans[i].append((len(BASE_KINDS) + k, at + start, at + end))
        return [sorted(s, key=lambda x: (x[1], x[0])) for s in spans]


def code_points(data: bytes, offsets: list[int]) -> dict[int, int]:
    """Code point position of byte offsets."""
    out, at, n = {}, 0, 0
    x = np.frombuffer(data, np.uint8)
    for o in sorted(set(offsets)):
        n += int(np.count_nonzero((x[at:o] & 0xC0) != 0x80))
        at = o
        out[o] = n
    return out


def _scan(scanner: Scanner):
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def slices(b: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
        at, texts, size = 0, [], 0
        for v in b.column("_bin"):
            texts.append(v.as_py() or b"")
            size += len(texts[-1])
            if size >= SLICE:
                yield at, texts
                at, texts, size = at + len(texts), [], 0
        if texts:
            yield at, texts

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in slices(b):
                lists = []
                for text, found in zip(texts, scanner.scan(texts)):
                    to = code_points(text, [x for s in found for x in s[1:]])
                    lists.append([{"kind": scanner.kinds[k], "start": to[s], "end": to[e]} for k, s, e in found])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, len(texts)), pa.array(lists, pa.list_(span))], names=["doc_id", "spans"])

    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: tuple[CharClass, ...] = CLASSES,
                 allow_words=ALLOW_WORDS, allow_patterns=ALLOW_PATTERNS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, spans array<struct<kind, start, end>>``, in order of start, then
    kind (base kinds first)."""
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_bin"))
    return d.mapInArrow(_scan(Scanner(classes, allow_words, allow_patterns)), "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redacted(text, spans, mark: str = "<secret>"):
    """Column: ``text`` with every maximal stretch covered by ``spans`` replaced by ``mark``."""
    fold = F.aggregate(
        spans, F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark)))
            .otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))
    return F.concat(fold["out"], F.substring(text, (fold["at"] + 1).cast("int"), F.length(text)))


def _is(*kinds: str):
    return lambda s: s["kind"].isin(*kinds)


def listed(spans, kinds: tuple[str, ...] | None = None):
    """Column: ``kind:start:end`` of the spans (of some kinds), joined by commas."""
    x = spans if kinds is None else F.filter(spans, _is(*kinds))
    return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of :func:`scan_secrets`: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``."""
    s = F.col("spans")
    return found.select(
        "doc_id", *[F.size(F.filter(s, _is(k))).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(listed(s, BASE_KINDS), 256).alias("base_sha256"), listed(s).alias("spans"))


def oracle_sql() -> str:
    """DuckDB SQL of the report with the default classes and allow list."""
    kinds = [*BASE_KINDS, *(c.kind for c in CLASSES)]
    pat = lambda p: p.replace("'", "''")
    either = re.sub(r"\b(password|passwd|secret|token|api|key)\b", lambda m: "".join(f"[{c.upper()}{c}]" for c in m[0]),
                    ASSIGN.replace("api_?key", "api~key")).replace("~", "_?").replace("[a-z0-9+/_.=-]+", "[A-Za-z0-9+/_.=-]+")
    finds = [("assign", either), ("access", ACCESS), ("hex", HEX), *[(c.kind, f"[{c.chars}]{{{c.window},}}") for c in CLASSES]]
    split = " UNION ALL ".join(f"SELECT doc_id, r, '{k}' AS kind, regexp_extract_all(t, '{pat(p)}') AS m, string_split_regex(t, '{pat(p)}') AS s FROM d" for k, p in finds)
    group = f"regexp_extract(x, '{pat(either)}', 2)"
    allow = " OR ".join([f"contains(lower(x), '{w}')" for w in ALLOW_WORDS] + [f"regexp_full_match(x, '{p}')" for p in ALLOW_PATTERNS])
    cls = " UNION ALL ".join(f"SELECT '{c.kind}' AS kind, {c.window} AS w, {c.limit} AS most" for c in CLASSES)
    order = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(kinds))
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
f AS ({split}),
u AS (SELECT doc_id, r, kind, m, s, unnest(range(1, len(m) + 1)) AS i FROM f),
x AS (SELECT doc_id, r, kind, m[i] AS x,
             (list_sum(list_transform(s[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0))::BIGINT AS a FROM u),
base AS (SELECT r, kind, a, a + length(x) AS b FROM x WHERE CASE kind WHEN 'assign' THEN length({group}) >= {MIN_ASSIGN}
         WHEN 'access' THEN length(x) >= {MIN_ACCESS} WHEN 'hex' THEN length(x) >= {MIN_HEX} ELSE false END),
c AS ({cls}),
w AS (SELECT r, kind, x, a, w, most, unnest(range(0, length(x) - w + 1)) AS o FROM x JOIN c USING (kind) WHERE NOT ({allow})),
l AS (SELECT r, kind, a, w, most, o, unnest(string_split(substr(x, o + 1, w), '')) AS ch FROM w),
n AS (SELECT r, kind, a, w, most, o, ch, count(*) AS k FROM l GROUP BY ALL),
h AS (SELECT r, kind, a, w, o FROM n GROUP BY r, kind, a, w, most, o HAVING sum(round(k * log2(k) * {UNIT})) <= most),
g AS (SELECT *, CASE WHEN o - lag(o) OVER (PARTITION BY r, kind, a ORDER BY o) < w THEN 0 ELSE 1 END AS new FROM h),
j AS (SELECT *, sum(new) OVER (PARTITION BY r, kind, a ORDER BY o) AS no FROM g),
spans AS (SELECT r, kind, a, b FROM base UNION ALL SELECT r, kind, a + min(o), a + max(o) + any_value(w) FROM j GROUP BY r, kind, a, no),
t AS (SELECT *, kind || ':' || a || ':' || b AS e, CASE kind {order} END AS k FROM spans),
p AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
             string_agg(e, ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(e, ',' ORDER BY a, k) AS spans FROM t GROUP BY r)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN p USING (r)
"""
