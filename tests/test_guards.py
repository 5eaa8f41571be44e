"""Names in texts, similar sets, chains and sets of documents against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallium.operators import automaton, chains, graph, setjoin


def test_names_at_boundaries(spark):
    names = ["c++", ".net", "auth-service", "oauth2.0", "ab", "abc", "b", "é", "a b", "", None]
    texts = [(1, "We use C++ and .NET; auth-service."), (2, "abc xab ab"), (3, "OAuth2.0x b é"), (4, None), (5, ""), (6, "a b a b éab"), (7, "x" * 50_000 + " abc")]
    want = set()
    for i, text in texts:
        for n in names:
            if n and text and re.search(rf"(?:(?<=[^a-z0-9])|^){re.escape(n)}(?=$|[^a-z0-9])", text.lower()):
                want.add((i, n))
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "id long, text string, name string").drop("name")
    for part in (2, 100):
        found = automaton.scan(df, spark.createDataFrame([(n,) for n in names], "name string"), ["id"], part=part)
        assert sorted((r["id"], r["name"]) for r in found.collect()) == sorted(want)
    assert automaton.scan(df, spark.createDataFrame([], "name string"), ["id"]).count() == 0


@pytest.mark.parametrize("seed, above", [(1, 0.5), (2, 0.5), (3, 0.75), (4, 0.3)])
def test_similar_sets_against_brute_force(spark, seed, above):
    rng = random.Random(seed)
    rows = [(i, rng.choice("xy"), sorted(set(rng.choices("abcdefghijkl", weights=range(1, 13), k=rng.randint(0, 9))))) for i in range(120)]
    rows += [(200 + i, *rows[5][1:]) for i in range(4)]
    new, held = rows[:80] + rows[121:], rows[40:]
    best = {}
    for i, b, x in new:
        for j, c, y in held:
            if i != j and b == c and x and y and len(set(x) & set(y)) / len(set(x) | set(y)) > above:
                key = (i, tuple(y))
                best[key] = min(best.get(key, (j, 0)), (j, 0))[0], len(set(x) & set(y)) / len(set(x) | set(y))
    make = lambda r: spark.createDataFrame(r, "id long, block string, words array<string>")
    got = setjoin.similar(make(new), make(held), above).collect()
    assert sorted((r["new_id"], r["held_id"], round(r["jaccard"], 9)) for r in got) == sorted((i, j, round(s, 9)) for (i, _), (j, s) in best.items())
    assert setjoin.similar(make([]), make(held), above).count() == 0


def test_chains_end_or_run_in_circles(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(50, 51), (51, 52), (52, 50), (53, 50), (60, 60), (70, 40), (71, None), (None, 3), (80, 81), (80, 79)]
    step = {80: 81} | {a: b for a, b in links if a is not None and b is not None and a != 80}
    want = {}
    for start in set(step) | set(step.values()):
        at, n = start, 0
        while at in step and n <= len(step):
            at, n = step[at], n + 1
        want[start] = (None, None, True) if at in step else (at, n, False)
    found = chains.last_members(spark.createDataFrame(links, "id long, next long"))
    assert {r["id"]: (r["last"], r["steps"], r["cyclic"]) for r in found.collect()} == want
    assert chains.last_members(spark.createDataFrame([], "id long, next long")).count() == 0


def test_policies_of_contradictions(spark):
    held = spark.createDataFrame([(1, "active", None, None, None, "kept"), (2, "active", None, None, None, "kept"), (3, "active", 9, None, None, "kept")], "id long, status string, invalidated_by long, superseded_by long, invalidated_at timestamp, extra string")
    found = spark.createDataFrame([(1, 10, "link"), (1, 8, "supersede"), (2, 11, "link"), (4, 12, "supersede")], "old_id long, new_id long, policy string")
    got = {r["id"]: r for r in chains.apply_contradictions(held, found, F.lit("2025-01-01").cast("timestamp")).collect()}
    assert (got[1]["status"], got[1]["superseded_by"], got[1]["invalidated_by"]) == ("inactive", 8, 8) and got[1]["invalidated_at"]
    assert (got[2]["status"], got[2]["superseded_by"], got[2]["invalidated_by"]) == ("active", None, 11)
    assert (got[3]["status"], got[3]["invalidated_by"], got[3]["extra"]) == ("active", 9, "kept") and len(got) == 3


def test_edges_within_sets_against_brute_force(spark):
    rng = random.Random(3)
    sets = [(rng.randint(0, 5), rng.randint(0, 20)) for _ in range(80)] + [(None, 3), (2, None)]
    edges = sorted({(rng.randint(0, 20), rng.randint(0, 20), rng.choice("ab")) for _ in range(150)})
    rows = [(s, t, k, float(rng.randint(1, 5))) for s, t, k in edges]
    got = chains.edges_within(spark.createDataFrame(sets, "set_id long, doc_id long"), spark.createDataFrame(rows, "source_id long, target_id long, relation_type string, weight double"), 4)
    want = []
    for g in range(6):
        own = {d for s, d in sets if s == g}
        inside = sorted((r for r in rows if r[0] in own and r[1] in own), key=lambda r: (-r[3], r[0], r[1], r[2]))[:4]
        want += [(g, *r, n) for n, r in enumerate(inside, 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_ambiguous_links_lead_nowhere(spark):
    names = spark.createDataFrame([("c", 1, "one"), ("c", 2, "two"), ("c", 1, "both"), ("c", 2, "both"), ("c", 1, "one"), ("d", 5, "one"), ("c", 3, ""), ("c", 4, None)], "collection string, doc_id long, key string")
    links = spark.createDataFrame([("c", k) for k in ("one", "two", "both", "", None, "none")] + [("d", "one")], "collection string, key string")
    got = {(r["collection"], r["key"]): r["target"] for r in chains.link_targets(links, names).collect()}
    assert got == {("c", "one"): 1, ("c", "two"): 2, ("c", "both"): None, ("c", ""): None, ("c", None): None, ("c", "none"): None, ("d", "one"): 5}


@pytest.mark.parametrize("split", [1, 7, 64])
def test_pairs_of_long_groups(spark, split):
    rows = [(1, i) for i in range(40)] + [(2, i) for i in range(3)] + [(3, 9), (None, 1), (None, 2)]
    want = sorted((g, a, b) for g in (1, 2, 3) for x, a in rows for y, b in rows if x == y == g and a < b)
    got = graph.pairs_within(spark.createDataFrame(rows, "g long, i long"), "g", "i", split)
    assert sorted(map(tuple, got.collect())) == want


def test_similar_sets_meet_by_chunks(spark, monkeypatch):
    """Many sets around few common words: pairs are counted chunk by chunk, whatever the chunks hold, and only short rows are joined."""
    rng = random.Random(7)
    words = [f"word{i}" for i in range(60)]
    rows = [(i, rng.choice("xy"), rng.sample(words, rng.randint(1, 40))) for i in range(300)]
    rows += [(300 + i, *rows[i][1:]) for i in range(20)]
    d = spark.createDataFrame(rows, "id long, block string, words array<string>")
    new, held = d.where("id % 2 = 1"), d.where("id % 2 = 0")
    want = {}
    for i, b, x in rows:
        for j, c, y in rows:
            n = len(set(x) & set(y))
            if i % 2 == 1 and j % 2 == 0 and b == c and n / (len(x) + len(y) - n) > 0.5:
                key = (i, tuple(sorted(y)))
                want[key] = min(want.get(key, (j, 1)), (j, n / (len(x) + len(y) - n)))
    for chunk_sets, frequent, pairs in ((16, 30, 100), (50, 1 << 30, 7)):
        monkeypatch.setattr(setjoin, "CHUNK_SETS", chunk_sets)
        monkeypatch.setattr(setjoin, "FREQUENT", frequent)
        monkeypatch.setattr(setjoin, "_PAIRS", pairs)
        chunks = [setjoin._chunks(s.select("block", F.xxhash64(F.array_sort("words")).alias("set"), F.transform("words", lambda w: F.xxhash64(w)).alias("words")).dropDuplicates(["block", "set"])) for s in (new, held)]
        met = setjoin._crossed(*chunks, 0.5).select("a_sets", "a_sizes", "a_words", "a_starts", "a_rows", "b_sets", "b_sizes", "b_words", "b_starts", "b_rows").collect()
        pairs_found = 0
        for r in met:
            a, b = ([np.frombuffer(r[f"{side}_{p}"], dtype=k) for p, k in zip(setjoin._PARTS, setjoin._KINDS, strict=True)] for side in "ab")
            pairs_found += len(setjoin._similar(a, b, 0.5)[0])
        assert pairs_found == len({(b, tuple(sorted(x)), y) for i, b, x in rows for j, y in want if j == i})
    got = setjoin.similar(new, held, 0.5)
    assert sorted((r["new_id"], r["held_id"], round(r["jaccard"], 9)) for r in got.collect()) == sorted((i, j, round(s, 9)) for (i, _), (j, s) in want.items())
    plan = got._jdf.queryExecution().toString()
    assert "words" not in plan.split("== Physical Plan ==")[1]  # before, sets were joined word by word and carried with their pairs
