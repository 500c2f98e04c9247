"""The pipeline's stages against brute force, each on its own input."""

import hashlib
import math
from collections import Counter

import corpus_pipeline
from conftest import SF0001
from postmine.llm import packing as P
from postmine.llm import quality_rules as Q
from test_llm_dedup import exact_brute, near_brute
from test_llm_rules_and_classifier import brute


def test_stages(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    columns, out = docs.columns, {}
    from postmine.llm.common import scratch

    for name, stage in corpus_pipeline.STAGES:
        before = out.get("last", docs)
        after = scratch(stage(spark, before, SF0001), "test-stage")
        out["last"] = after
        a, b = [r.asDict() for r in before.collect()], [r.asDict() for r in after.collect()]
        if name != "best_fit_packing":
            assert after.columns == columns
        if name == "quality_rules":
            kept = {r.doc_id for r in Q.judged(before, spark.read.parquet(f"{SF0001}/labels.parquet"))[0].filter("kept").collect()}
            assert {r["doc_id"] for r in b} == kept
            for r in b:
                n, _, _, _, rep = brute(r["text"])
                assert n >= 50 and 100 * rep <= 50 * n
        elif name == "exact_dedup":
            best = exact_brute([(r["doc_id"], r["text"]) for r in a])
            assert sorted(r["doc_id"] for r in b) == sorted({v[0] for v in best.values()})
        elif name == "near_dedup":
            best = near_brute([(r["doc_id"], r["text"]) for r in a], 5)
            assert sorted(r["doc_id"] for r in b) == sorted({v[0] for v in best.values()})
        elif name == "poisson_mix":
            mass, want = Counter(), Counter()
            for r in a:
                mass[r["source"]] += len(r["text"] or "")
            for r in a:
                lam = sum(mass.values()) / len(mass) / mass[r["source"]]
                ident = hashlib.md5(f"mix-1|{r['doc_id']}|{hashlib.md5((r['text'] or '').encode()).hexdigest()}".encode()).hexdigest()
                u = int(hashlib.md5(("u" + ident).encode()).hexdigest()[:13], 16) / 16**13
                k, p, c = 0, math.exp(-lam), math.exp(-lam)
                while c <= u:
                    k += 1
                    p *= lam / k
                    c += p
                want[r["doc_id"]] = k
            assert Counter(r["doc_id"] for r in b) == +want
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(corpus_pipeline.tokenizer_path())
            n = Counter()
            for r in a:
                n.update((r["doc_id"], *x) for x in P.cut(len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1, 1024))
            assert Counter((r["doc_id"], r["start"], r["length"]) for r in b) == n
            fill = Counter()
            for r in b:
                fill[r["sequence_id"]] += r["length"]
            assert max(fill.values()) <= 1024 and len(fill) <= 1.02 * sum(fill.values()) / 1024 + 3


def test_run(spark):
    x = corpus_pipeline.run(spark, SF0001)
    assert x.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(x.columns)


def test_stages_on_edge_cases(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing columns; then an empty table."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _mix string, _metadata string, node string"
    words = " ".join(f"w{i % 977}x{i}" for i in range(15_000))
    rows = [(1, words, "en", "a", 5, "m", "d", "n"), (1, words, "en", "a", 5, "m", "d", "n"), (2, words + " tail", None, None, None, None, None, None),
            (None, words.replace(" ", "\t"), "en", "a", 1, "m", "d", "n"), (3, None, "en", "a", 1, "m", "d", "n"), (4, "", None, "b", 0, None, "d", "n"),
            (None, None, None, None, None, None, None, None), (5, " ".join(f"v{i}" for i in range(80)), "en", "b", 2, "m", "d", "n")]
    kept = {"quality_rules": 5, "exact_dedup": 4, "near_dedup": 5}
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF0001)
            got = out.collect()
            if name != "best_fit_packing":
                assert out.columns == docs.columns, name
            if not data:
                assert got == [], name
            elif name in kept:
                assert len(got) == kept[name], (name, [(r.doc_id, r._metadata) for r in got])
            elif name == "poisson_mix":
                assert {r.source for r in got} <= {"a", "b", None} and len(got) > 0
            else:
                assert {r.doc_id for r in got} == {1, 2, 3, 4, 5, None} and sum(r.doc_id == 4 for r in got) == 1
