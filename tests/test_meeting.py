"""Documents that meet queries where they are read."""

import random

import pytest
from pyspark.sql import functions as F

from recallium.operators import fts, meeting
from recallium.operators.postings import Postings

ROWS = "doc_id long, path string, title string, body string, alive boolean"


def moved(spark, action):
    """Rows shuffled while an action runs."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def listed():
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(found.apply, range(found.size()))}

    before = set(listed())
    result = action()
    return result, sum(n for s, n in listed().items() if s not in before)


@pytest.fixture
def library(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, f"{i}.md", "T", " ".join(rng.choices([f"w{k}" for k in range(60)], k=rng.randint(0, 40))), True) for i in range(400)]
    index = Postings(spark, str(tmp_path))
    _, shuffled = moved(spark, lambda: index.apply(spark.createDataFrame(rows, ROWS)))
    assert shuffled == 0  # words are counted where the document is read
    asked = [(q, " ".join(rng.choices([f"w{k}" for k in range(60)], k=rng.randint(1, 4)))) for q in range(50)]
    return index, spark.createDataFrame(asked, "query_id long, query string")


def told(df):
    return {(r["query_id"], r["doc_id"]): (round(r["bm25"], 9), r["hit"], r["n_terms"]) for r in df.collect()}


@pytest.mark.parametrize("match_all", [False, True])
def test_the_best_of_each_query_are_all_that_tasks_keep(spark, library, match_all):
    index, asked = library
    every = told(fts.matches(asked, index.bodies(), index.body_statistics(), match_all=match_all))
    for order, key in (("bm25", lambda v: v[0]), ("score", lambda v: round(v[0] / (1 + v[0]), 9)), ("hit", lambda v: v[1])):
        best, shuffled = moved(spark, lambda o=order: told(fts.matches(asked, index.by_document(), index.body_statistics(), match_all=match_all, best={o: 3})))
        assert shuffled < 2000  # frequencies of prefixes by task; before, each row of the index moved
        for q in range(50):
            want = sorted((-key(v), d) for (query, d), v in every.items() if query == q)[:3]
            got = sorted((-key(v), d) for (query, d), v in best.items() if query == q)[:3]
            assert got == want
        assert all(every[pair] == v for pair, v in best.items())


@pytest.mark.parametrize("match_all", [False, True])
def test_parts_and_blocks_change_nothing(spark, library, match_all):
    index, asked = library
    n_docs, avgdl = index.body_statistics().first()
    prefixes = fts.query_prefixes(asked).withColumns({"part": F.lit(0), "times": F.lit(1)})
    want = told(meeting.meet(index.by_document(), prefixes, n_docs, avgdl, every_group=match_all))
    assert want
    assert told(meeting.meet(index.by_document(), prefixes, n_docs, avgdl, every_group=match_all, part=20, cells=300)) == want


def test_titles_are_counted_where_they_are_read(spark):
    """Queries with a common word, and titles that hold it: what moves are names of titles, not titles by queries."""
    from recallium.operators import cascade

    docs = spark.createDataFrame([(i, f"common w{i} abc", i) for i in range(300)], "doc_id long, title string, modified_at long")
    asked = [(q, f"common w{q} {'ab ab' if q % 2 else 'zzqx'}") for q in range(200)]
    found, shuffled = moved(spark, lambda: cascade.by_title(spark.createDataFrame(asked, "query_id long, query string"), docs).collect())
    assert shuffled < 200 * 300 / 4  # before, each query with each title that holds a word of it
    want = {}
    for q, text in asked:
        words = text.split()
        hits = [(-sum(w in f"common w{i} abc" for w in words), -i, i) for i in range(300)]
        want[q] = [(i, -h / len(words)) for h, _, i in sorted(hits) if -h >= max(2, -(-len(words) // 2))][:5]
    got = {q: [] for q, _ in asked}
    for r in sorted(found, key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    assert got == want
