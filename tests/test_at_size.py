"""What has to hold for queries to get through larger tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallium.operators import entity, models, setjoin, vector
from recallium.plans import registry
from recallium.sources.tables import Tables

SF = "/root/testdata/sf0.001"


def test_hashed_words_are_hashed_together_as_one_by_one():
    words = ["a", "é" * 40, "x" * 64, "x" * 65, "\x00", "漢字", "y" * 1000, "a"]
    assert models.hashes(words).tolist() == [models.fnv1a(w) for w in words]
    v = models.HashedWords()(["", " A  b b\n", *words])
    assert not v[0].any() and np.allclose(v[1] @ v[1], 1) and np.allclose(v[1][models.fnv1a("b") % 64] / v[1][models.fnv1a("a") % 64], 2)


def test_similar_documents_embed_each_text_once_and_share_out_chunks(spark, monkeypatch):
    told = spark.sparkContext.accumulator(0)

    class Counted(models.HashedWords):
        def __call__(self, texts):
            told.add(len(texts))
            return super().__call__(texts)

    monkeypatch.setattr(models, "HashedWords", Counted)
    n = Tables(spark, SF).documents.where("active").count()
    assert registry.QUERIES["similar_documents"](spark, SF).count() > 0
    assert told.value == n
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.array(F.col("id") * 1.0, F.lit(1.0)).alias("v"))
    plan = vector._chunks(rows, None)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(block" in plan and "SortMergeJoin" not in plan


def test_sketches_leave_no_similar_sets_out_and_most_others(spark):
    rng = np.random.default_rng(5)
    pool = rng.integers(-(2**63), 2**63, 30_000)
    common = pool[:40]

    def like(words, p):
        return np.unique(np.where(rng.random(len(words)) < p, rng.choice(pool, len(words)), words))

    sets = [np.unique(np.concatenate((common[rng.random(40) < 0.5], rng.choice(pool, n)))) for n in rng.integers(1, 400, 300)]
    other = [like(s, p) for s, p in zip(sets, rng.choice([0.0, 0.2, 0.3, 0.35, 0.5, 1.0], 300), strict=True)]

    def chunk(sets):
        sizes = np.array([len(s) for s in sets], dtype=np.int32)
        flat, rows = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
        order = np.argsort(flat, kind="stable")
        words, starts = np.unique(flat[order], return_index=True)
        return [np.arange(len(sets)), sizes, words, np.append(starts, len(flat)).astype(np.int32), rows[order]]

    a, b = chunk(sets), chunk(other)
    both = np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in other] for x in sets])
    jaccard = both / (a[1][:, None] + b[1][None, :] - both)
    for above in (0.3, 0.5, 0.8):
        want = set(zip(*(x.tolist() for x in np.nonzero(jaccard > above)), strict=True))
        maybe = set(zip(*(x.tolist() for x in setjoin._maybe(a, b, above)), strict=True))
        assert want <= maybe
        row, col, j = setjoin._similar(a, b, above)
        assert set(zip(row.tolist(), col.tolist(), strict=True)) == want and np.allclose(j, jaccard[row, col])
        if above >= 0.5:  # before, the words of all pairs were counted
            assert len(maybe) < len(want) + 0.01 * jaccard.size


@pytest.mark.parametrize("bits", [1024, 70, 3, 0])
def test_entity_edges_carry_no_names_and_shuffle_documents_once(spark, monkeypatch, bits):
    monkeypatch.setattr(entity, "BITS", bits)
    rng = random.Random(8)
    rows = sorted({(d, f"e{min(rng.randint(0, 90), rng.randint(0, 200))}") for d in range(120) for _ in range(9)} | {(d, f"c{k}") for d in range(0, 120, 2) for k in range(80) if (d + k) % 3})
    own, df = {}, {}
    for d, e in rows:
        own.setdefault(d, set()).add(e)
        df[e] = df.get(e, 0) + 1
    idf = {e: math.log((len(own) + 1) / (n + 1)) for e, n in df.items()}
    want = {(a, b): (len(own[a] & own[b]), max(idf[e] for e in own[a] & own[b])) for a in own for b in own if a < b and any(idf[e] >= 3 for e in own[a] & own[b])}
    found = entity.entity_edges(spark.createDataFrame([*rows, (7, None), (None, "e1")][:-1], "doc_id long, entity string"))
    got = found.collect()
    assert len(want) > 20 and len(got) == len(want) and {(r["a"], r["b"]): r["shared"] for r in got} == {k: n for k, (n, _) in want.items()}
    assert all(abs(r["weight"] - min(1.0, 0.3 + 0.12 * want[r["a"], r["b"]][1] + min(0.15, 0.05 * (r["shared"] - 1)))) < 1e-12 for r in got)
    plan = found._jdf.queryExecution()
    assert plan.executedPlan().toString().count("ReusedExchange") == 1  # before, each side was shuffled
    scan = [line for line in plan.optimizedPlan().toString().splitlines() if "Relation" in line]
    assert scan and "entity" not in "".join(scan) and "all#" not in "".join(scan)
