"""Queries that SQL can't express, against brute force on the smallest tables."""

import numpy as np
import pytest

from recallium.functions import text as T
from recallium.operators import chunk, diversity, models
from recallium.plans import registry, search
from recallium.sources.tables import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


def texts(t):
    return {r["id"]: (r["title"], r["body"]) for r in t.documents.where("active").select("id", "title", "body").collect()}


def best(scores, k):
    return sorted(((round(s, 9), -i) for i, s in scores.items()), reverse=True)[:k]


def test_similar_documents_read_whole_texts(spark, t):
    docs = texts(t)
    v = {i: models.HashedWords()([f"{a}\n{b}"])[0] for i, (a, b) in docs.items()}
    found = registry.QUERIES["similar_documents"](spark, SF).collect()
    asked = {i for i in docs if i % 100 == 0}
    assert {r["query_id"] for r in found} == asked
    for q in asked:
        got = [(r["similarity"], -r["doc_id"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert np.allclose(got, best({i: v[q] @ v[i] for i in docs if i != q}, 10), atol=1e-9)


def test_fragment_search_keeps_documents_apart(spark, t):
    pieces = [(i, c) for i, (_, b) in texts(t).items() for _, c in chunk.chunk(b)]
    v = models.HashedWords()([c for _, c in pieces])
    found = registry.QUERIES["fragment_search"](spark, SF).collect()
    questions = {r["query_id"]: r["query"] for r in search.questions(t).collect()}
    assert {r["query_id"] for r in found} == set(questions)
    for q, text in questions.items():
        score = {}
        for (i, _), s in zip(pieces, v @ models.HashedWords()([text])[0], strict=True):
            score[i] = max(score.get(i, -2.0), float(s))
        got = [(r["score"], -r["doc_id"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert np.allclose(got, best(score, 10), atol=1e-9)


def test_diverse_results_against_the_order_of_each_list(spark, t):
    ranked = search.any_ranked(t).select("query_id", "doc_id", "rank").collect()
    sets = {r["id"]: frozenset(r["s"]) for r in t.documents.select("id", T.shingle_set(t.documents["body"]).alias("s")).collect()}
    want = {}
    for q in {r["query_id"] for r in ranked}:
        rows = sorted((r for r in ranked if r["query_id"] == q), key=lambda r: (r["rank"], r["doc_id"]))
        for k, at in enumerate(diversity.mmr_order([sets[r["doc_id"]] for r in rows], 0.6)):
            want[q, rows[at]["doc_id"]] = k
    found = registry.QUERIES["diverse_results"](spark, SF).collect()
    assert {(r["query_id"], r["doc_id"]): r["diverse_rank"] for r in found} == want


@pytest.mark.parametrize("name", ["chunks", "token_chunks"])
def test_chunks_cover_their_documents(spark, t, name):
    rows = sorted(registry.QUERIES[name](spark, SF).collect(), key=lambda r: (r["doc_id"], r["seq"]))
    bodies = {r["id"]: r["body"] for r in t.documents.select("id", "body").collect()}
    covered = dict.fromkeys(bodies, 0)
    for r in rows:
        body = bodies[r["doc_id"]]
        assert body[r["start"] : r["start"] + len(r["chunk"])] == r["chunk"] and r["start"] <= covered[r["doc_id"]]
        covered[r["doc_id"]] = r["start"] + len(r["chunk"])
    assert covered == {i: len(b) for i, b in bodies.items()}


def test_fragments_begin_with_the_whole(spark, t):
    bodies = {r["id"]: r["body"] for r in t.documents.select("id", "body").collect()}
    found = {}
    for r in registry.QUERIES["fragments"](spark, SF).collect():
        found.setdefault(r["doc_id"], {})[r["seq"]] = (r["type"], r["label"], r["text"])
    assert {i: [f[k] for k in sorted(f)] for i, f in found.items()} == {i: chunk.fragments(b) for i, b in bodies.items()}


def test_routed_results_follow_their_lanes(spark, t):
    found = registry.QUERIES["retrieve_router"](spark, SF).collect()
    words = {(r["query_id"], r["doc_id"]): r["search"] for r in search.searched(t).collect()}
    fused = {(r["query_id"], r["doc_id"]): r["score"] for r in search.blended(t).collect()}
    assert found
    for q in {r["query_id"] for r in found}:
        rows = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        lane = words if rows[0]["mode"] in ("keyword", "timeline") else fused
        if rows[0]["mode"] != "timeline":
            assert [r["doc_id"] for r in rows] == [-i for _, i in best({d: s for (x, d), s in lane.items() if x == q}, 10)]
