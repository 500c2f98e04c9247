"""Quality rules (operator 2): base statistics and a learned decision list, DataFrame functions only.

Sequential covering: a rule is a conjunction of thresholds on document statistics. It grows on two
thirds of the labelled rows by information gain, is pruned on the other third, and is accepted if it
is precise there; the rows it covers leave, and the next rule is learned from the rest. Spark counts
labels per (statistic, quantile bin) in one small grouped job per step; the driver sees only those
histograms (statistics x bins x 2). The list is emitted as ordered conditional expressions.

Repeated 3-word windows are found inside the row: window hashes packed with their position are sorted,
neighbours with equal hashes are candidates, and candidates are compared as word sequences, so the
count is exact and costs n log n without a shuffle.

Defined cases: null text has no words (fails the base rule); rows without label or with a null label
teach nothing; without labels the list is empty and the base rule decides alone; a null ``doc_id`` is
an ordinary row; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, scratch

WS_CLASS = r"[\x20\x09-\x0D]"
# The symbols of the contract and the limits of its base rule.
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
BINS, MAX_RULES, MAX_TERMS = 64, 16, 4
MIN_PRECISION, MIN_COVERED = 0.95, 10

FEATURES = {
    "symbol_ratio": "n_symbols / greatest(word_chars, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "distinct_ratio": "n_distinct_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "digit_ratio": "n_digits / greatest(word_chars, 1)",
    "upper_ratio": "n_upper / greatest(word_chars, 1)",
    "words": "double(n_words)",
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _barrier(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns behind a generator, so that an array is computed once and not inlined into the
    lambda functions that look into it."""
    kept = list(df.columns)
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_row: bool = False) -> DataFrame:
    """``doc_id`` and the counts of every whole text; ``with_row``: also the input row as ``_row``."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if with_row else []
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"), *row)
    trimmed = F.btrim("_t", F.lit(WS_CHARS))
    d = _barrier(d, _w=F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_CLASS + "+")),
                 _l=F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("_w")
    key = lambda i: F.hash(F.col("_w")[i], F.col("_w")[i + 1], F.col("_w")[i + 2])
    packed = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.shiftleft(key(i).cast("bigint"), 32).bitwiseOR(i.cast("bigint"))))
    d = d.select(
        "doc_id", *(["_row"] if with_row else []), "_w", n.cast("bigint").alias("n_words"), F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"), F.size("_l").cast("bigint").alias("n_lines"),
        F.size(F.array_distinct("_w")).cast("bigint").alias("n_distinct_words"),
        F.regexp_count("_t", F.lit("[0-9]")).cast("bigint").alias("n_digits"), F.regexp_count("_t", F.lit(r"\p{Lu}")).cast("bigint").alias("n_upper"),
        packed.alias("_k"))
    keep = [c for c in d.columns if c not in ("_w", "_k")]
    d = _barrier(d.select(*keep, "_w", F.sort_array("_k").alias("_k")), _s=F.col("_k")).drop("_k")
    same = lambda a, b: F.shiftright(a, 32) == F.shiftright(b, 32)
    near = F.filter("_s", lambda x, i: F.coalesce(((i > 0) & same(x, F.get("_s", i - 1))) | same(x, F.get("_s", i + 1)), F.lit(False)))
    d = _barrier(d, _c=F.transform(near, lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))).drop("_s")
    text = lambda p: F.concat_ws(" ", F.col("_w")[p], F.col("_w")[p + 1], F.col("_w")[p + 2])
    d = _barrier(d, _v=F.when(F.size("_c") > 0, F.sort_array(F.transform("_c", lambda p: F.struct(text(p).alias("k"), p.alias("p")))))).drop("_c", "_w")
    hit = F.filter("_v", lambda x, i: F.coalesce(((i > 0) & (x["k"] == F.get("_v", i - 1)["k"])) | (x["k"] == F.get("_v", i + 1)["k"]), F.lit(False)))
    d = _barrier(d, _p=F.sort_array(F.transform(hit, lambda x: x["p"]))).drop("_v")
    cover = F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - p, F.lit(3))))
    covered = F.aggregate(cover, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return d.select(*keep, F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


# ----------------------------------------------------------------------------------------------
# the decision list
# ----------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Term:
    """``feature >= threshold`` or ``feature < threshold``; ``bin`` is the threshold's number."""

    feature: str
    above: bool
    threshold: float
    bin: int

    def column(self) -> Column:
        c = F.expr(FEATURES[self.feature])
        return c >= self.threshold if self.above else c < self.threshold

    def binned(self) -> Column:
        c = F.col(f"b_{self.feature}")
        return c >= self.bin if self.above else c < self.bin

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Ordered rules; a row is rejected by the first rule whose terms all hold, else kept."""

    rules: list[list[Term]] = field(default_factory=list)
    precision: list[float] = field(default_factory=list)

    def rule_number(self) -> Column:
        """1-based number of the first rule that holds, 0 if none."""
        c = F.lit(0)
        for i in reversed(range(len(self.rules))):
            c = F.when(reduce(lambda a, b: a & b, [t.column() for t in self.rules[i]]), F.lit(i + 1)).otherwise(c)
        return c

    def __str__(self) -> str:
        return "\n".join(f"{i}. reject if {' and '.join(map(str, r))}  (precision {p:.3f})" for i, (r, p) in enumerate(zip(self.rules, self.precision), 1)) or "keep all"


def _tightest(terms: list[Term]) -> list[Term]:
    """Of several bounds on one side of a statistic only the narrowest says something."""
    best: dict[tuple[str, bool], Term] = {}
    for t in terms:
        b = best.get((t.feature, t.above))
        if b is None or (t.threshold > b.threshold) == t.above:
            best[t.feature, t.above] = t
    return list(best.values())


def _binned(labelled: DataFrame) -> tuple[DataFrame, dict[str, list[float]]]:
    qs = [i / BINS for i in range(1, BINS)]
    row = labelled.agg(*[F.percentile_approx(F.expr(e), qs, 10_000).alias(f) for f, e in FEATURES.items()]).first()
    cuts = {f: sorted(set(row[f] or [])) for f in FEATURES}
    # a row is in bin b if b thresholds are at most its value
    def bin_of(f: str) -> Column:
        value = F.expr(FEATURES[f])
        return F.size(F.filter(F.array(*map(F.lit, map(float, cuts[f]))).cast("array<double>"), lambda t: t <= value)).alias(f"b_{f}")

    return labelled.select("y", "prune", *[bin_of(f) for f in FEATURES]), cuts


def _histograms(rows: DataFrame) -> dict[str, list[list[int]]]:
    """Per statistic and bin: number of rows with label 0 (junk) and 1."""
    pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"b_{f}").alias("b")) for f in FEATURES])
    got = rows.select("y", F.inline(pairs)).groupBy("f", "b").agg(F.count_if(F.col("y") == 0).alias("p"), F.count_if(F.col("y") == 1).alias("n")).collect()
    out = {f: [[0, 0] for _ in range(BINS)] for f in FEATURES}
    for r in got:
        out[r["f"]][r["b"]] = [r["p"], r["n"]]
    return out


def _best_term(hist: dict, cuts: dict, p0: int, n0: int) -> Term | None:
    """The threshold with the largest information gain; ties go to the first by name."""
    best, gain = None, 1e-9
    base = math.log2(p0 / (p0 + n0))
    for f in FEATURES:
        low_p = low_n = 0
        for b in range(1, len(cuts[f]) + 1):
            low_p, low_n = low_p + hist[f][b - 1][0], low_n + hist[f][b - 1][1]
            for above, p, n in ((True, p0 - low_p, n0 - low_n), (False, low_p, low_n)):
                if p and (g := p * (math.log2(p / (p + n)) - base)) > gain:
                    best, gain = Term(f, above, float(cuts[f][b - 1]), b), g
    return best


def learn(labelled: DataFrame, max_rules: int = MAX_RULES, min_precision: float = MIN_PRECISION, min_covered: int = MIN_COVERED) -> DecisionList:
    """``labelled``: the statistics plus ``doc_id`` and ``y`` (0: junk, 1: good)."""
    out = DecisionList()
    x = labelled.filter(F.col("y").isin(0, 1)).withColumn("prune", F.pmod(F.crc32(F.concat(F.lit("prune:"), F.col("doc_id").cast("string"))), F.lit(3)) == 0)
    binned, cuts = _binned(x)
    rest = scratch(binned, "rules-labelled")
    while len(out.rules) < max_rules:
        grow, terms = rest.filter(~F.col("prune")), []
        while len(terms) < MAX_TERMS:
            cond = reduce(lambda a, b: a & b, [t.binned() for t in terms], F.lit(True))
            hist = _histograms(grow.filter(cond))
            p0, n0 = (sum(h[i] for h in hist["words"]) for i in (0, 1))
            if p0 == 0 or n0 == 0:
                break
            t = _best_term(hist, cuts, p0, n0)
            if t is None:
                break
            terms.append(t)
        if not terms:
            break
        prefixes = [reduce(lambda a, b: a & b, [t.binned() for t in terms[:k]]) for k in range(1, len(terms) + 1)]
        counts = rest.filter("prune").agg(*[F.count_if(c & (F.col("y") == y)).alias(f"c{k}_{y}") for k, c in enumerate(prefixes) for y in (0, 1)]).first()
        scored = [((p - n) / (p + n), p / (p + n), p + n, k + 1) for k in range(len(terms)) if (p := counts[f"c{k}_0"]) + (n := counts[f"c{k}_1"])]
        if not scored:
            break
        _, precision, covered, k = max(scored, key=lambda s: (s[0], -s[3]))
        if precision < min_precision or covered < min_covered:
            break
        out.rules.append(_tightest(terms[:k]))
        out.precision.append(precision)
        rest = rest.filter(~prefixes[k - 1])
    return out


def learned(stats: DataFrame, labels: DataFrame) -> DecisionList:
    y = labels.select(F.col("doc_id").cast("bigint").alias("_l"), F.col("quality").cast("int").alias("y"))
    return learn(stats.join(y, stats["doc_id"] == y["_l"]).drop("_l"))


def _verdict(stats: DataFrame, rules: DecisionList) -> DataFrame:
    x = stats.select("*", base_failed().alias("base_failed"), rules.rule_number().alias("rule"))
    return x.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def judged(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DecisionList]:
    """Statistics, ``base_failed``, number of the rejecting ``rule`` (0: none) and ``kept`` per row."""
    stats = scratch(statistics(docs), "rules-stats")
    rules = learned(stats, labels)
    return _verdict(stats, rules), rules


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns. The statistics are computed again beside
    each row, which is cheaper than shuffling the texts to join a verdict."""
    rules = learned(scratch(statistics(docs), "rules-stats"), labels)
    x = _verdict(statistics(docs, with_row=True), rules)
    return x.filter("kept").select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
