"""Operators 11, 12 and 13 against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from recallium.llm import queries, repeats, sortmeans, whiten

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, n long, component string, cluster string"
TEXTS = "doc_id long, text string, anchor string, k1 long, spans string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x", "y") for i, v in rows], VECTORS).repartition(3)


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], TEXTS).repartition(3)


# Operator 13


def brute_clusters(rows, k, rounds):
    kept = [(i, [int(np.floor(64 * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    centroids = [x for _, x in first[:k]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = {}
        for _, x in kept:
            own.setdefault(near(x)[1], []).append(x)
        centroids = [[sum(column) // len(own[j]) for column in zip(*own[j], strict=True)] if j in own else c for j, c in enumerate(centroids)]
    found = [(i, *near(x)) for i, x in kept] if centroids else []
    total = Counter()
    for _, d, j in found:
        total[j] += d
    return sorted(((i if i is not None else -1, j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in found))


@pytest.mark.parametrize("rounds", [0, 3, 6])
def test_sort_means_against_brute_force(spark, rounds):
    rng = np.random.default_rng(rounds)
    rows = [(i, [float(x) for x in rng.normal(size=64) * (1 + i % 3)]) for i in range(120)]
    rows += [(200 + i, rows[5][1]) for i in range(9)]  # repeated vectors: centroids coincide
    rows += [(5, rows[7][1]), (None, rows[3][1]), (300, None), (301, [1.0] * 63), (302, [None] + [1.0] * 63), (303, [float("nan")] * 64), (304, [float("inf")] * 64), (305, []), (306, [0.0] * 64)]
    found = sortmeans.cluster(vectors(spark, rows), 16, rounds)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    got = sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in map(tuple, found.collect()))
    assert got == brute_clusters(rows, 16, rounds)


def test_sort_means_of_few_or_no_rows(spark):
    assert sortmeans.cluster(vectors(spark, [])).count() == 0
    assert sortmeans.cluster(vectors(spark, [(None, [1.0] * 64)])).count() == 0
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert sorted(map(tuple, sortmeans.cluster(vectors(spark, few)).collect())) == brute_clusters(few, 16, 3)
    huge = sortmeans.cluster(vectors(spark, [(1, [3e38] * 64), (2, [-3e38] * 64)])).collect()
    assert {r["distance"] for r in huge} == {0}


def test_assign_takes_the_smaller_number_of_equals():
    centroids = np.array([[0, 0], [4, 0], [0, 0], [2, 2]])
    x = np.array([[2, 0], [0, 0], [5, 0], [2, 1]])
    for last in range(4):
        at, d = sortmeans.assign(x, np.full(4, last), centroids)
        assert at.tolist() == [0, 0, 1, 3] and d.tolist() == [4, 0, 1, 1]


# Operator 11


def brute_whitened(rows, components):
    x = np.floor(64 * np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)) + 1_000_000
    centred = x - x.mean(axis=0)
    values, vectors_ = np.linalg.eigh(centred.T @ centred / len(x))
    values, vectors_ = values[::-1][:components], vectors_[:, ::-1][:, :components]
    return centred @ vectors_ / np.sqrt(values), values / np.trace(centred.T @ centred / len(x))


@pytest.mark.parametrize("size, components, block", [(64, 32, 16), (40, 5, 2), (6, 32, 16)])
def test_whitening_against_dense_eigenvectors(spark, size, components, block):
    rng = np.random.default_rng(size)
    rows = [(i, [float(x) for x in rng.normal(size=size) * np.arange(1, size + 1)]) for i in range(150)]
    odd = [(900, None), (901, [None] + [1.0] * (size - 1)), (902, [float("nan")] * size), (903, [float("-inf")] * size), (904, [1.0] * (size + 1)), (905, [])]
    found = whiten.whiten(vectors(spark, rows + odd), components, block=block).toPandas()
    want, shares = brute_whitened(rows, components)
    assert sorted(found["vec_id"].unique()) == [i for i, _ in rows] and set(found["n"]) == {150}
    got = found.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)
    assert np.allclose(found.groupby("component")["explained"].first(), shares, rtol=1e-10)
    assert found["identity_error"].nunique() == 1 and found["identity_error"].iloc[0] < 1e-10
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    deviation = {i: sum((150 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for (i, _), v in zip(rows, x, strict=True)}
    assert dict(zip(found["vec_id"], found["deviation"], strict=True)) == deviation


def test_whitening_of_flat_and_empty_tables(spark):
    assert whiten.whiten(vectors(spark, [])).count() == 0
    assert whiten.whiten(vectors(spark, [(1, [1.0] * 4)])).count() == 0
    assert whiten.whiten(vectors(spark, [(i, [1.0] * 4) for i in range(5)])).count() == 0
    # Two directions only: no more components, and rows without an id or with a repeated one stay.
    rows = [(None, [1.0, 0.0, 2.0]), (1, [0.0, 1.0, 2.0]), (1, [0.0, 1.0, 2.0]), (2, [5.0, 1.0, 2.0])]
    found = whiten.whiten(vectors(spark, rows)).collect()
    assert len(found) == 8 and {r["component"] for r in found} == {1, 2} and sum(r["vec_id"] is None for r in found) == 2
    huge = whiten.whiten(vectors(spark, [(1, [3e38, 1.0]), (2, [-3e38, 0.0]), (3, [0.0, 0.5])])).collect()
    assert {r["deviation"] for r in huge if r["vec_id"] == 1} == {None}


@pytest.mark.parametrize("values", [np.ones(30), np.r_[np.full(12, 5.0), np.linspace(1, 0.1, 48)], np.r_[3.0, 2.0, np.zeros(18)], 0.5 ** np.arange(200)])
def test_lanczos_restarts_and_finds_equal_eigenvalues(values):
    turn, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(len(values), len(values))))
    matrix = (turn * values) @ turn.T
    found, basis = whiten.lanczos(lambda v: matrix @ v, len(values), float(values.sum()), 8, block=3, most=20)
    assert np.allclose(found, np.sort(values)[::-1][:8], atol=1e-11)
    assert np.allclose(basis.T @ basis, np.eye(8), atol=1e-11)
    assert np.allclose(matrix @ basis, basis * found, atol=1e-10)


# Operator 12


def brute_removed(rows, least):
    bodies = [(t or "").encode() for _, t in rows]
    times = Counter(b[k : k + least] for b in bodies for k in range(len(b) - least + 1))
    out = []
    for (i, _), b in zip(rows, bodies, strict=True):
        gone = np.zeros(len(b) + 2, dtype=np.int8)
        for k in range(len(b) - least + 1):
            if times[b[k : k + least]] > 1:
                gone[k + 1 : k + 1 + least] = 1
        kept = bytes(c for c, g in zip(b, gone[1:-1], strict=True) if not g)
        out.append((-1 if i is None else i, len(b), int(gone.sum()), int((np.diff(gone) == 1).sum()), kept))
    return sorted(out)


def some_texts(seed, letters):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [word(rng.randint(15, 120)) for _ in range(6)]
    rows = [(i, "".join(rng.choice([word(rng.randint(0, 40)), rng.choice(passages), rng.choice(passages)[: rng.randint(1, 60)]]) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows += [(100 + i, passages[0] + word(30)) for i in range(20)]  # a common passage and different ends
    return rows + [(200, None), (201, ""), (None, passages[1]), (3, rows[3][1]), (202, rows[4][1]), (203, "a" * 300), (204, "ab" * 90 + "é" * 40), (205, "x" * 11), (206, "y" * 12)]


@pytest.mark.parametrize("seed, letters, group", [(1, "abcdefghij", 4096), (2, "ab", 4096), (3, "abé ", 3), (5, "ab", 2)])
def test_removal_against_brute_force(spark, seed, letters, group):
    rows = some_texts(seed, letters)
    found = repeats.remove(texts(spark, rows), least=12, gram=4, group=group).collect()
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found)
    assert got == brute_removed(rows, 12)


@pytest.mark.parametrize("segment", [1, 16, 37, 1 << 19])
def test_segments_hold_every_window_once_and_anchor_equal_windows_alike(monkeypatch, segment):
    monkeypatch.setattr(repeats, "SEGMENT", segment)
    bodies = [(t or "").encode() for _, t in some_texts(4, "abc")]
    seen, offsets = set(), {}
    for segments in repeats._segments(bodies, 12):
        joined, bounds, starts, at, hashes = repeats.anchors(segments, 12, 4)
        for p, a, h in zip(starts.tolist(), at.tolist(), hashes.tolist(), strict=True):
            s = np.searchsorted(bounds, p, side="right") - 1
            i, offset, _ = segments[s]
            place = (i, offset + p - int(bounds[s]))
            assert place not in seen and bodies[i][place[1] :][:12] == joined[p : p + 12]
            seen.add(place)
            assert offsets.setdefault(joined[p : p + 12], (a - p, h)) == (a - p, h)
    assert seen == {(i, k) for i, b in enumerate(bodies) for k in range(len(b) - 11)}


def test_removal_query_on_a_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = sorted(map(tuple, queries.op12_repeats(spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))
    assert found == [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute_removed(docs, 400)]


def test_no_text_repeats_nothing(spark):
    assert repeats.remove(texts(spark, [])).count() == 0
    assert repeats.repeats(texts(spark, [(1, None), (2, "a" * 399)])).count() == 0


def test_places_of_repeats_are_complete(spark):
    rows = some_texts(7, "abc")
    found = repeats.repeats(texts(spark, rows), least=12, gram=4).collect()
    bodies = {}
    for i, t in rows:
        bodies.setdefault(i, []).append((t or "").encode())
    groups = {}
    for r in found:
        groups.setdefault((bytes(r["repeat"]), r["length"]), set()).add((r["doc_id"], r["start"]))
    assert groups
    covered = {}
    for (digest, length), places in groups.items():
        strings = set()
        for i, start in places:
            strings |= {b[start : start + length] for b in bodies[i] if hashlib.sha256(b[start : start + length]).digest() == digest}
            covered.setdefault(i, set()).update(range(start, start + length))
        assert len(strings) == 1  # all places of a group hold one string, and it's the one that is named
    for i, _, removed, _, _ in brute_removed(rows, 12):
        if len(bodies.get(i, [])) == 1:
            assert len(covered.get(i, ())) == removed


@pytest.mark.parametrize("seed", range(5))
def test_maximal_repeats_of_an_anchor(seed):
    rng = random.Random(seed)
    word = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    members = sorted({(len(left), left + b"##" + word(rng.randint(0, 9))) for left in (word(rng.randint(0, 8)) for _ in range(25))})
    found = {(left, right, tuple(sorted(run))) for left, right, run in repeats.maximal_repeats(members, 6)}
    want = set()
    for a in range(len(members)):
        for b in range(a):
            left = repeats.common(members[a][1][: members[a][0]][::-1], members[b][1][: members[b][0]][::-1])
            right = repeats.common(members[a][1][members[a][0] :], members[b][1][members[b][0] :])
            if left + right >= 6:
                string = members[a][1][members[a][0] - left : members[a][0] + right]
                want.add((left, right, tuple(m for m, (at, body) in enumerate(members) if at >= left and body[at - left : at + right] == string)))
    assert found == want
