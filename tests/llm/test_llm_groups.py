"""Near duplicates, cap filters, sharding and components against brute force and edge cases."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from repeatwise.llm import caps, graph, neardup, shards


def connected(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["chain", "star", "random"])
def test_components(spark, kind):
    r = random.Random(1)
    edges = {"chain": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 60)],
             "random": [(r.randint(0, 300), r.randint(0, 300)) for _ in range(150)] + [(5, 5), (6, 7), (7, 6)]}[kind]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = connected([e for e in edges if e[0] != e[1]], {x for e in edges if e[0] != e[1] for x in e})
    assert got == want


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def plain_groups(rows, threshold=85):
    sets = {i: shingle_set(t) for i, t in rows}
    at = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            at[x].add(i)
    pairs = set()
    for i, s in sets.items():
        for j in {j for x in s for j in at[x] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= threshold * (len(s) + len(sets[j]) - both):
                pairs.add((i, j))
    return sets, connected(pairs, sets)


def near_copies(n_groups=25, size=12, seed=2):
    """Groups of texts around and above the threshold, chains, and a passage many texts share."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage, rows = [word() for _ in range(60)], []
    for g in range(n_groups):
        words = [word() for _ in range(r.randint(40, 160))] + (passage if g % 3 == 0 else [])
        for _ in range(size):
            rows.append(" ".join(words))
            words = list(words)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                words[r.randrange(len(words))] = word()
    rows += ["a b c", "A B  C", "a b c d", "x"] + [" ".join(word() for _ in range(30)) for _ in range(100)]
    r.shuffle(rows)
    return list(enumerate(rows))


def check_groups(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets, want = plain_groups(rows)
    for r in neardup.near_duplicates(df, **options).collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (
            len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_near_duplicates_equal_brute_force(spark):
    check_groups(spark, near_copies())


def test_large_nodes_are_branched_and_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    check_groups(spark, near_copies(n_groups=6, size=60, seed=4), leaf=4, depth=3)


def test_given_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check_groups(spark, rows)


def test_near_duplicates_of_awkward_rows(awkward, nothing):
    out = neardup.near_duplicates(awkward)
    assert sorted(out.columns) == sorted(awkward.columns) and out.count() == awkward.count()
    got = {r["doc_id"]: r for r in out.collect()}
    for empty in (0, 1, 2, -5):
        assert (got[empty]["n_shingles"], got[empty]["component_id"], got[empty]["kept"]) == (0, empty, True)
    assert got[5]["component_id"] == got[6]["component_id"] == got[7]["component_id"] == 5
    assert got[8]["component_id"] == got[9]["component_id"] == 8
    assert (got[None]["n_shingles"], got[None]["component_id"], got[None]["kept"]) == (None, None, True)
    assert neardup.near_duplicates(nothing).count() == 0


def clusters(n=900, dim=24, seed=3):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim))
    for i in range(0, n, 3):
        x[i + 1] = x[i] + r.standard_normal(dim) * r.choice([0.2, 0.45, 0.5])
    x[::50] = x[0]
    x[1::40] = x[1] + r.standard_normal((len(x[1::40]), dim)) * 0.3
    return x


@pytest.mark.parametrize("chunk", [1024, 16])
def test_vectors_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(caps, "CHUNK", chunk)
    x = clusters()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in caps.linked_vectors(df.repartition(3)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    want = connected(np.argwhere(np.triu(near)).tolist(), range(len(x)))
    found = sum(r["n_links"] for r in got.values())
    assert all(got[i]["n_links"] <= near[i].sum() for i in range(len(x)))
    assert found >= 0.99 * near.sum()
    assert sum(got[i]["component_id"] == want[i] for i in got) >= 0.99 * len(x)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_awkward_vectors(spark):
    rows = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
            (6, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1e-200, 0.0]), (9, [1.0, 0.1]), (9, [1.0, 0.1]), (None, [1.0, 0.0]),
            (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows],
                               "vec_id long, embedding array<double>, n_links int, kept string")
    out = caps.linked_vectors(df, bucket=1, shared=200.0)
    assert sorted(out.columns) == sorted([*df.columns, "component_id"]) and out.count() == len(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out.collect()}
    for i in (0, 1, 2, 3, 4, 5, 10, 11):
        assert got[i] == (0, i, True)
    assert got[6] == (4, 6, True) and got[7] == (4, 6, False) and got[8] == (4, 6, False) and got[9][1] == 6
    assert got[None] == (0, None, True)
    assert caps.linked_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [1, 2, 3, 8, 40])
def test_filters_of_any_dimension_find_pairs_at_the_threshold(dim):
    r = np.random.default_rng(dim)
    code = caps.Code(dim, 2000, 0.9, 128, 18.0)
    x = r.standard_normal((300, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = r.standard_normal((300, dim))
    side -= (side * x).sum(1, keepdims=True) * x
    norm = np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.9 * x + np.sqrt(1 - 0.81) * side / norm if dim > 1 else x
    lists = [[set() for _ in range(300)] for _ in range(2)]
    for own, z in zip(lists, (x, y)):
        for row, name in zip(*code.lists(z)):
            own[row].add(name)
    assert sum(bool(a & b) for a, b in zip(*lists)) >= 0.98 * 300


@pytest.mark.parametrize("dim, n", [
    (16, 50_000), (20, 10**6), (32, 10**6), (64, 50_000), (64, 10**6), (64, 10**7), (64, 10**9), (256, 10**8)])
def test_filters_for_any_number_of_vectors_find_pairs_at_the_threshold(dim, n):
    code = caps.Code(dim, n, 0.9, 128, 18.0)
    left, right = caps.pairs_at(dim, 0.9, 1000, np.random.default_rng(n + dim))
    missed = np.ones(1000, bool)
    for own in code.codes:
        for at in range(0, 1000, 250):
            missed[at:at + 250] &= ~code._meet(own, left[at:at + 250], right[at:at + 250])
    assert code.recall >= caps.RECALL and missed.mean() <= 0.015


def test_recall_out_of_reach_is_an_error(monkeypatch):
    monkeypatch.setattr(caps, "RECALL", 1.01)
    with pytest.raises(ValueError, match="no filters"):
        caps.Code(24, 1000, 0.9, 128, 18.0)


def test_planted_pairs_among_many_vectors(spark):
    r = np.random.default_rng(8)
    n, planted = 20_000, 600
    x = r.standard_normal((n, 20))
    left, right = caps.pairs_at(20, 0.901, planted, r)
    x[:planted], x[planted:2 * planted] = left * 3, right
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist()}))
    got = caps.linked_vectors(df.repartition(8)).select("vec_id", "component_id").toPandas().set_index("vec_id")["component_id"]
    assert sum(got[i] == got[i + planted] for i in range(planted)) >= 0.98 * planted


def check_shards(rows, n, tolerance):
    """Slots without gaps, order kept over shards, and sizes as near as the order allows."""
    of = defaultdict(list)
    for r in rows:
        key = -1 if r["text"] is None else int(hashlib.md5(r["text"].encode()).hexdigest()[:15], 16)
        of[r["shard"]].append((r["slot"], key, r["size"]))
    order = [x for s in sorted(of) for x in sorted(of[s])]
    assert [x[1] for x in order] == sorted(x[1] for x in order)
    assert all(sorted(x[0] for x in v) == list(range(len(v))) for v in of.values())
    assert all(0 <= s < n for s in of)
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    below = 0
    for s in range(n):
        below += sum(x[2] for x in of[s])
        assert abs(below - total * (s + 1) / n) <= max(largest / 2, tolerance * total / n) + 1


def test_shards(spark):
    r = random.Random(1)
    texts = ["hot text " * 40] * 300 + ["x" * r.randint(0, 400) + str(r.randint(0, 400)) for _ in range(700)] + [None] * 20
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    rows = shards.histogram_shards(df, 10).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    check_shards(rows, 10, 0.02)
    # Copies are cut only where a splitter falls among many of them.
    of = defaultdict(set)
    for r in rows:
        of[r["text"]].add(r["shard"])
    assert len(of["hot text " * 40]) >= 3
    assert sum(len(v) > 1 for v in of.values()) <= 10


def test_shards_of_equal_rows(spark):
    df = spark.createDataFrame([(1, "same")] * 500, "doc_id long, text string").repartition(4)
    rows = shards.histogram_shards(df, 7).collect()
    check_shards(rows, 7, 0.02)


def test_shards_of_awkward_rows(awkward, nothing):
    out = shards.histogram_shards(awkward, 5)
    assert sorted(out.columns) == sorted([*awkward.columns, "slot"]) and out.count() == awkward.count()
    check_shards(out.collect(), 5, 0.02)
    assert shards.histogram_shards(nothing, 5).count() == 0
    assert all(r["size"] == 8 + len((r["text"] or "").encode()) for r in out.collect())


def test_near_copy_group_has_no_pairs_written(spark):
    """A group of copies of one text is a single record."""
    df = spark.createDataFrame([(i, "one two three four five six") for i in range(400)], "doc_id long, text string")
    out = neardup.near_duplicates(df)
    assert out.select("component_id").distinct().collect()[0][0] == 0
    assert out.where(F.col("kept")).count() == 1
