"""Operators 1, 2, 6, 9 and 10 against the library, brute force or held-out rows."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from recallium.llm import bpe, langid, licenses, queries, tokencount, toxicity

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, ids string, score double"
TEXTS = [None, "", "   ", "Hello  World's 123 <|endoftext|>x <|startoftext|>", "aaaaaa aaa aa a", "Éa ß İ ΣΣΣ ǅ", "你好世界 \x1c a\x85b ½x² \u0300", "!!!??? 'll 'LL it'S", "x" * 30_000, "same", "same"]


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "en", "clash", 1.0) for i, t in enumerate(texts)], SCHEMA)


def test_bpe_equals_the_library(spark):
    path = public_tokenizers.path(queries.WORD_BPE)
    library = tokenizers.Tokenizer.from_file(path)
    found = {r["doc_id"]: r for r in bpe.encode(rows(spark, TEXTS), path).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert found[i]["ids"] == ids
        assert found[i]["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_bpe_query_on_a_whole_table(spark):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path(queries.WORD_BPE))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    found = {r["doc_id"]: r for r in queries.op1_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert len(found) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        r = found[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_empty_table_and_cache(spark, monkeypatch):
    path = public_tokenizers.path(queries.WORD_BPE)
    assert bpe.encode(rows(spark, []), path).collect() == []
    voc = bpe.Vocabulary(path)
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 2)
    one = [bpe.encode_texts(voc, [t])[0].tolist() for t in ("a bc def", "ghi jkl", "a bc def")]
    assert one[0] == one[2]


def test_langid_on_held_out_rows(spark):
    lang = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    found = [r for r in queries.op2_langid(spark, SF).collect() if r["held_out"]]
    assert len(found) > 200
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in found]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found)


def test_langid_defined_cases(spark):
    learned = {"en": b"the cat sat on the mat with the hat", "de": "die Katze saß auf der Matte".lower().encode()}
    texts = [None, "", "123 !!", "the mat", "auf der matte", "the mat " * 5000]
    found = {r["doc_id"]: r for r in langid.identify(rows(spark, texts), learned).collect()}
    assert [found[i]["lang_pred"] for i in range(6)] == ["und", "und", "und", "en", "de", "en"]
    assert found[0]["score"] == 0
    assert {r["lang_pred"] for r in langid.identify(rows(spark, texts), {}).collect()} == {"und"}
    assert langid.learn(rows(spark, [])) == {}


def test_langid_learns_from_bounded_rows(spark):
    text = "the cat sat on the mat " * 20
    data = [(None, text, "en"), (2, "katze auf der matte " * 4, "de"), (2, "katze auf der matte " * 4, "de"), (3, None, "fr"), (4, "le chat", None), (5, "123", "it"), (6, "", "pt"), (7, text * 40, "en"), (9, text, "en"), (12, "z" * 500_000, "xx")]
    docs = spark.createDataFrame([(*d, "clash") for d in data], "doc_id long, text string, lang string, label string")
    kept = docs.where(~langid.held_out(F.col("doc_id")))
    learned = langid.learn(docs)
    assert set(learned) == {r["lang"] for r in kept.where("doc_id is not null and text is not null and lang is not null and text rlike '[a-z]'").collect()}
    assert all(len(t) <= langid.BYTES for t in learned.values())
    assert learned.get("de", b"").count(b"katze") in (0, 4)  # equal rows teach once
    hot = spark.range(5000).select("id", F.lit(text).alias("text"), F.lit("en").alias("lang")).selectExpr("id % 3 AS doc_id", "text", "lang")
    assert len(langid.learn(hot)["en"]) <= 3 * (len(text) + 1)


def test_phrases_are_longest_matches():
    learned = {"x": b"abcabdabeabcd"}
    parser = langid.Parser(learned)
    rng = random.Random(3)
    for size in [*range(1, 60), 4 * langid.BLOCK + 5, 3 * langid.BLOCK]:  # phrases run across blocks
        text = bytes(rng.choice(b"abcdez" if size % 2 else b"abcd") for _ in range(size))
        current, phrases = b"", 1
        for c in (text[k : k + 1] for k in range(len(text))):
            if current + c in learned["x"]:
                current += c
            else:
                phrases += 1
                current = c if c in learned["x"] else b""
        assert round(parser.entropies([text])[0, 0] * len(text) / parser.bits[0]) == phrases


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = [r for r in queries.op6_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in label]
    assert np.mean([label[r["doc_id"]] == r["predicted"] for r in found]) > 0.92
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)


def test_toxicity_finds_every_language(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    found = [(lang[r["doc_id"]], r["predicted"]) for r in queries.op6_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in toxic]
    for one in ("en", "de", "fr", "es"):
        assert np.mean([p for language, p in found if language == one]) > 0.6
    assert np.mean([p for _, p in found]) >= 0.8


def test_toxicity_defined_cases(spark):
    docs, none = rows(spark, TEXTS), spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(docs, none)
    assert model is None
    clash = spark.createDataFrame([(k, k % 2, "x", "y") for k in list(range(60)) * 2] + [(None, 1, "x", "y"), (3, None, "x", "y"), (4, 7, "x", "y")], "doc_id long, toxic int, text string, label string")
    texts = spark.createDataFrame([(k, "such a rotten rascal word" if k % 2 else "the quiet river runs on", "h", 1) for k in list(range(60)) * 3] + [(None, "x", "h", 1), (5, None, "h", 1)], "doc_id long, text string, h string, label int")
    model = toxicity.learn(texts, clash)
    odd, even = toxicity.scores(model, ["such a rotten rascal word", "the quiet river runs on"])
    assert odd > even
    model = None
    assert {r["score"] for r in toxicity.score(docs, model).collect()} == {0.0}
    model = toxicity.train([b"\n".join([b"such a rotten rascal word"] * 3)] * 30, [b"\n".join([b"the quiet river runs on"] * 3)] * 30)
    found = toxicity.scores(model, [None, "", "x " * 100_000])
    assert all(0 <= s <= 1 for s in found) and found[0] == found[1]


def naive_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_licenses_against_plain_search(spark):
    texts = [None, "", "All rights reserved. ALL RIGHTS RESERVED", "cc by CC-BY cc  by-nc", "the General Public\nLicense", "Released under the MIT License.", "nothing here", "É all rights reserved é " * 3000]
    found = {r["doc_id"]: r for r in licenses.scan(rows(spark, texts)).collect()}
    for i, t in enumerate(texts):
        words = naive_words(t)
        want = sorted((k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
        assert found[i]["n_words"] == len(words)
        assert [(p["start"], p["label"]) for p in found[i]["places"]] == want
    assert {s["label"] for s in found[5]["spans"]} == {"mit"}
    assert not found[6]["spans"]


def test_matching_statistics_against_brute_force():
    known = licenses.Automaton([("a", "x y z x y w"), ("b", "y z y z x")])
    rng = random.Random(5)
    for _ in range(200):
        words = [rng.choice([b"x", b"y", b"z", b"w", b"q"]) for _ in range(rng.randint(0, 25))]
        best = []
        for end in range(len(words)):
            size = 0
            for n in range(1, end + 2):
                piece = words[end - n + 1 : end + 1]
                if any(t[k : k + n] == piece for t in known.templates for k in range(len(t))):
                    size = n
            best.append(size)
        for end, n, state in known.statistics(words):
            assert n == best[end]
            places = {(t, k + n - 1) for t, own in enumerate(known.templates) for k in range(len(own)) if own[k : k + n] == words[end - n + 1 : end + 1]}
            assert set(known.ends[state]) == places
        assert [e for e, _, _ in known.statistics(words)] == [i for i, n in enumerate(best) if n >= licenses.LEAST_RUN]


def test_chains_against_brute_force():
    rng = random.Random(2)

    def most(runs, total):
        runs, top = sorted(runs, key=lambda r: (r[0] + r[2], r[1] + r[2], r[2])), 0

        def go(j, covered):
            nonlocal top
            top, a = max(top, covered), runs[j]
            for b in runs[j + 1 :]:
                more = b[2] - max(0, a[0] + a[2] - b[0], a[1] + a[2] - b[1])
                if a[0] < b[0] and a[1] < b[1] and a[0] + a[2] + total >= b[0] and more > 0:
                    go(runs.index(b), covered + more)

        for j in range(len(runs)):
            go(j, runs[j][2])
        return top

    for _ in range(100):
        known = licenses.Automaton([("a", " ".join(rng.choice("xyzw") for _ in range(8))), ("b", " ".join(rng.choice("xyzwv") for _ in range(10)))])
        words = [rng.choice([b"x", b"y", b"z", b"w", b"v", b"q"]) for _ in range(25)]
        found = known.runs(words)
        for t, own in enumerate(known.templates):
            whole = {(i, k, n) for i in range(25) for k in range(len(own)) for n in range(3, 11) if i + n <= 25 and k + n <= len(own) and words[i : i + n] == own[k : k + n]}
            longest = {(i, k, n) for i, k, n in whole if (i, k, n + 1) not in whole and (i - 1, k - 1, n + 1) not in whole}
            assert set(found.get(t, [])) == longest
            if longest:
                made = list(licenses.chains(found[t], len(own)))
                assert made[0][1] == most(longest, len(own))
                assert sorted(r for chain, _ in made for r in chain) == sorted(longest)


def test_spans_of_templates():
    known = licenses.automaton(tuple(licenses.TEMPLATES))
    for label, text in licenses.TEMPLATES:
        words = licenses.words_of(f"before it {text} and after".encode())
        assert (label, 2, len(words) - 3, 1.0) in known.spans(words)
    assert {s[0] for s in known.spans(licenses.words_of(dict(licenses.TEMPLATES)["bsd-3-clause"].encode()))} == {"bsd-3-clause"}
    one = licenses.Automaton([("t", "a b c d e f g h i j")])
    assert one.spans(licenses.words_of(b"a b c q h i j q d e f g q")) == [("t", 0, 11, 0.7)]
    twice = one.spans(licenses.words_of(b"a b c d e f g h q a b c d e f g h"))
    assert twice == [("t", 0, 7, 0.8), ("t", 9, 16, 0.8)]


def test_token_counts_against_plain_dynamic_programming(spark):
    path = public_tokenizers.path(queries.PIECES)
    model = tokencount.unigrams(path)
    assert model.scores["▁t"] == -2 and "▁▁" not in model.scores

    def plain(word):
        best = [(0.0, 0)] + [None] * len(word)
        for end in range(1, len(word) + 1):
            s, n = best[end - 1]
            options = [(s + model.unknown, -(n - (-len(word[end - 1].encode()))))]
            for size in range(1, min(end, model.longest) + 1):
                piece = word[end - size : end]
                if piece in model.scores:
                    s, n = best[end - size]
                    options.append((s + model.scores[piece], -(n + 1)))
            top = max(options)
            best[end] = (top[0], -top[1])
        return best[-1][1]

    texts = [*TEXTS, "internationalisation of tokens", "token tokens tokenizer", "zzqx ðŁ"]
    found = {r["doc_id"]: r for r in tokencount.counts(rows(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        assert found[i]["n_tokens"] == sum(plain(tokencount.MARK + w) for w in (t or "").split())


def segmentations(word, pieces):
    if not word:
        yield []
    if word:
        yield from (["?", *rest] for rest in segmentations(word[1:], pieces))  # an unknown character
    for n in range(1, len(word) + 1):
        if word[:n] in pieces:
            yield from ([word[:n], *rest] for rest in segmentations(word[n:], pieces))


def test_expected_counts_against_all_segmentations():
    model = tokencount.Unigrams({p: -k / 3 for k, p in enumerate(["a", "b", "ab", "ba", "aba", "bb", "abab"], 1)})
    words = sorted({"": 2, "a": 3, "ab": 1, "abab": 5, "ababab": 2, "abcab": 4, "bbbab": 1, "c": 1}.items())
    counted, likelihood = tokencount.expected(model, words)
    want, total = {}, 0.0
    for word, times in words:
        ways = [(s, np.exp(sum(model.scores.get(p, model.unknown) for p in s))) for s in segmentations(word, model.scores)]
        whole = sum(w for _, w in ways)
        total += times * np.log(whole)
        for s, w in ways:
            for p in s:
                if p in model.scores:
                    want[p] = want.get(p, 0) + times * w / whole
    assert counted == pytest.approx(want) and likelihood == pytest.approx(total)


def test_rounds_of_the_fit_raise_the_likelihood(spark):
    path = public_tokenizers.path(queries.PIECES)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = sorted({(w[:100], 1) for r in docs.where("doc_id % 5 = 0").collect() for w in tokencount.pre_tokens(r["text"] or "")})
    size = sum(len(w.encode()) for w, _ in held)
    bits = [-tokencount.expected(tokencount.Unigrams(tokencount.fit(docs.where("doc_id % 5 <> 0"), path, rows=80, rounds=n)), held)[1] / np.log(2) / size for n in (0, 1, 3)]
    assert bits[2] < bits[1] < bits[0]
    scores = tokencount.fit(docs, path, rows=80, rounds=1)
    assert sum(map(np.exp, scores.values())) == pytest.approx(1)
    nothing = list(tokencount.fit(docs.limit(0), path).values())
    assert nothing == pytest.approx([-np.log(len(scores))] * len(scores))
    found = tokencount.counts(docs, path, scores).collect()
    assert len(found) == docs.count() and all(r["n_tokens"] >= r["n_pre_tokens"] for r in found)


def test_token_counts_of_long_pre_tokens(spark):
    path = public_tokenizers.path(queries.PIECES)
    model = tokencount.unigrams(path)
    rng = random.Random(3)
    texts = ["x" * 30_000, "".join(rng.choices("abetionrsABC09+/", k=5_000)), "你好世界" * 1500 + "internationalisation" * 200, "a" * 999, "a" * 1000, "token" * 207, "x " + "token" * 400]
    found = {r["doc_id"]: r for r in tokencount.counts(rows(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        want = 0
        for word in (tokencount.MARK + w for w in t.split()):
            best = [(0.0, 0)]
            for end in range(1, len(word) + 1):
                options = [(best[end - 1][0] + model.unknown, best[end - 1][1] - len(word[end - 1].encode()))]
                options += [(best[end - n][0] + model.scores[word[end - n : end]], best[end - n][1] - 1) for n in range(1, min(end, model.longest) + 1) if word[end - n : end] in model.scores]
                best.append(max(options))
            want -= best[-1][1]
        assert (found[i]["n_pre_tokens"], found[i]["n_tokens"]) == (len(t.split()), want)


@pytest.mark.parametrize("op", [lambda d: langid.identify(d, {"en": b"a b"}), licenses.scan, lambda d: tokencount.counts(d, public_tokenizers.path(queries.PIECES)), lambda d: toxicity.score(d, None)])
def test_empty_tables(spark, op):
    assert op(rows(spark, [])).collect() == []
    assert op(rows(spark, TEXTS).withColumn("doc_id", F.lit(None).cast("long"))).count() == len(TEXTS)


def test_pieces_are_fitted_on_every_text(spark):
    """A word that stands in one text of many counts, whatever the text's hash."""
    from pyspark.sql import functions as F

    from recallium.llm import queries

    path = public_tokenizers.path(queries.PIECES)
    common = spark.range(600).select(F.concat(F.lit("common words here "), F.col("id").cast("string")).alias("text"))
    some = tokencount.fit(common, path, rounds=1)
    every = tokencount.fit(common.union(common.limit(1).select(F.lit("garden " * 50).alias("text"))), path, rounds=1)
    piece = tokencount.MARK + "garden"
    assert every[piece] > some[piece] + 1


def test_tries_level_by_level_equal_those_walked_word_by_word(monkeypatch):
    rng = random.Random(11)
    alphabet = "ab\u2581\u00e9\u6f22\U0001f600"
    words = sorted({"".join(rng.choices(alphabet, k=rng.choice([1, 2, 3, 5, 9, 80, 130]))) for _ in range(400)})
    model = tokencount.Unigrams({p: -1.0 - k % 3 for k, p in enumerate(["a", "b", "ab", "ba", "aab", "abab", "\u2581a", "\u2581", "\u00e9a", "b\u6f22"])})

    def plain(word):
        best, count = [0.0], [0]
        model._extend(word, best, count)
        return count[-1]

    monkeypatch.setattr(tokencount, "TRIE_WORDS", 150)
    assert model.count_sorted(words) == [plain(w) for w in words]
    # Paths of pieces are met once a node: what stands under a common prefix isn't scored again.
    trie = tokencount.Trie(words, tokencount._pieces(tuple(model.scores)), model.longest)
    assert len(trie.char) == 1 + len({w[:i] for w in words for i in range(1, len(w) + 1)})
    pieces = list(model.scores)
    held = sum(p == w[i - len(p) : i] for w, i in {(w[:i], i) for w in words for i in range(1, len(w) + 1)} for p in pieces if len(p) <= i)
    assert sum(len(end) for _, end, _ in trie.edges) == held
