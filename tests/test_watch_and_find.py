"""The watcher's stream, chunks by tokens, and finding what is meant."""

import os
import re

import numpy as np
import pytest

from recallium.operators import cascade, chunk
from recallium.operators.postings import Postings
from recallium.streaming import watcher


def test_a_folder_is_followed(spark, tmp_path):
    root, notes, checkpoint = (str(tmp_path / n) for n in ("root", "notes", "checkpoint"))
    os.makedirs(f"{root}/sub/node_modules")
    index, seen = Postings(spark, f"{tmp_path}/index"), []
    feed = watcher.feed(index, root, "c")

    def write(name, text):
        with open(f"{root}/{name}", "w") as f:
            f.write(text)

    def told(df, n):
        seen.extend(sorted((r["path"], r["event"]) for r in df.collect()))
        feed(df, n)

    def tick(second):
        watcher.note(spark, root, notes, f"2025-01-01 00:00:{second:02d}")

    def run():
        seen.clear()
        watcher.catch_up(spark, notes, checkpoint, told)
        return list(seen)

    words = lambda: {(r["term"]) for r in index.bodies().collect()}
    tick(0)
    write("a.md", "# A\nfirst words")
    write("sub/b.md", "other")
    write("sub/node_modules/x.md", "hidden")
    write("c.txt", "no note")
    tick(1)
    assert run() == []  # nothing has come to rest
    write("a.md", "# A\nfinal words")  # still being written
    tick(3)
    assert run() == [("sub/b.md", "changed")]
    tick(5)
    assert run() == [("a.md", "changed")] and words() == {"a", "final", "words", "other"}
    os.unlink(f"{root}/sub/b.md")
    tick(6)
    tick(9)
    tick(12)
    assert run() == [("sub/b.md", "removed")] and words() == {"a", "final", "words"}
    write("sub/b.md", "back again")
    for second in (13, 15, 18):
        tick(second)
    assert run() == [("sub/b.md", "changed")] and words() == {"a", "final", "words", "back", "again"}
    tick(20)
    assert run() == []


@pytest.mark.parametrize("text", ["", "word", "a b " * 3000, "One sentence. Another one! " * 900, "para\n\n" * 2000, "x" * 20_000, " \n\t" * 3000, "é_ß-1234567890 " * 800, "line of words here\n" * 1500])
@pytest.mark.parametrize("size, shared", [(800, 120), (10, 3), (1, 0)])
def test_chunks_by_tokens(text, size, shared):
    ends = chunk.token_ends(text)
    assert (np.diff(ends) > 0).all() and (not text or ends[-1] == len(text))
    found = chunk.chunk_by_tokens(text, ends, size, shared)
    covered = 0
    for start, tokens, piece in found:
        assert start <= covered and text[start : start + len(piece)] == piece  # no gap
        inside = int(np.searchsorted(ends, start + len(piece), side="left")) - int(np.searchsorted(ends, start, side="right")) + bool(piece)
        assert tokens == inside <= size
        assert start + len(piece) > covered or not text
        covered = start + len(piece)
    assert covered == len(text)


def test_chunks_end_softly_and_share_tokens(spark):
    text = "Some words that go on. " * 400
    found = chunk.chunk_by_tokens(text, chunk.token_ends(text))
    assert all(re.search(r"\. $", piece) for _, _, piece in found)
    for (a, _, one), (b, _, _) in zip(found, found[1:]):
        shared = text[b : a + len(one)]
        assert abs(len(chunk.token_ends(shared)) - 120) <= 1
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, body string")
    rows = chunk.explode_token_chunks(df).collect()
    assert [(r["start"], r["tokens"], r["chunk"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["seq"])) if r["doc_id"] == 1] == found
    assert {r["doc_id"]: r["chunk"] for r in rows if r["doc_id"] > 1} == {2: "", 3: ""}


def test_a_query_leaves_at_the_first_way_that_answers(spark):
    docs = spark.createDataFrame([(1, "notes/Plan.md", "Plan of the big garden", "2025-01-01"), (2, "notes/river.md", "River and garden", "2025-01-02"), (3, "x/other.md", "Third", "2025-01-03")], "doc_id long, place string, title string, modified_at string")
    queries = spark.createDataFrame([(1, "/notes/plan.md"), (2, "river"), (3, "the Garden, plan zzz"), (4, "nothing at all"), (5, "missing/path.md"), (6, None)], "query_id long, query string")
    words = spark.createDataFrame([(2, 2, 0.5), (2, 1, 0.45), (1, 3, 0.9)], "query_id long, doc_id long, score double")
    vectors = spark.createDataFrame([(q, 3, 0.6) for q in range(1, 6)], "query_id long, doc_id long, score double")
    seen = []

    def way(rows):
        def find(asked):
            seen.append({r["query_id"] for r in asked.collect()})
            return rows.join(asked.select("query_id"), "query_id", "left_semi")

        return find

    found = cascade.candidates(queries, docs, way(words), way(vectors))
    got = sorted((r["query_id"], r["doc_id"], r["source"], round(r["score"], 6)) for r in found.collect())
    assert got == [(1, 1, "path", 1.0), (2, 1, "fts", 0.45), (2, 2, "fts", 0.5), (3, 1, "title", 0.666667), (4, 3, "vec", 0.6), (5, 3, "vec", 0.6)]
    assert seen == [{2, 3, 4, 5, 6}, {4, 5, 6}]
    outcome = {r["query_id"]: (r["doc_id"], r["confident"], r["outcome"], r["outcome_if_destructive"]) for r in cascade.targets(queries, found).collect()}
    assert outcome[1] == (1, True, "target", "target") and outcome[2] == (2, False, "target", "ambiguous")
    assert outcome[4] == (3, False, "target", "ambiguous") and outcome[6] == (None, False, "not found", "not found")
