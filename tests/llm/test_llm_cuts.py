"""Middles cut by words of bytes, backtracking byte pairs and bit-plane clusters against plain versions."""

import hashlib
import random
import re
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import example, given, settings
from hypothesis import strategies as st

from repeatwise.llm import backtrack, fim, planes

MULTI, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=backtrack.load_ranks(MULTI), special_tokens={})
PARTS = list("abcdeABC  \n\t\r\x0b\x0c'.,#*1239éñüßЖ日本😀\u0085\x1c\x1d²½​́\x00\x08\x0e\x1f!~\x7f౜") + [
    "'s", "'ll", "the ", "  ", "***", "aaaa", "<P>", "<S", "<", "M>"]
TEXTS = st.lists(st.sampled_from(PARTS), max_size=60).map("".join) | st.text(max_size=60)


def plain_cut(text, one, two):
    units = re.findall(fim.UNIT, text)
    a, b = sorted((one % (len(units) + 1), two % (len(units) + 1)))
    return len(units), "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])


def plain_middle(text, key, seed=42, rate=50, spm_rate=80):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n, p, m, s = plain_cut(text, h[0], h[1])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXTS | st.none(), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1)), max_size=12),
       st.integers(0, 3), st.sampled_from([pa.string(), pa.large_string()]))
def test_cuts_are_those_of_a_regular_expression(rows, skipped, kind):
    texts = pa.array([t for t, _, _ in rows], kind).slice(skipped)
    rows = rows[skipped:]
    n, a, b = fim.cut(texts, *(np.array([r[i] for r in rows], np.int64) for i in (1, 2)))
    for (text, one, two), *found in zip(rows, n, a, b):
        want, prefix, middle, _ = plain_cut(text or "", one, two)
        assert found == [want, len(prefix), len(middle)]


def test_white_space_of_words_of_bytes():
    every = np.arange(256, dtype=np.uint8)
    for shift in range(8):
        marked = fim.blanks(np.roll(every, shift).view("<u8")).view(np.uint8)
        assert np.array_equal(np.roll(marked, -shift) == 128, np.isin(every, [9, 10, 11, 12, 13, 32]))
    first = fim.first_bytes(every.view("<u8")).view(np.uint8) == 128
    assert np.array_equal(first, (every & 0xC0) != 0x80)


def test_every_mark_is_found_in_its_word():
    r = np.random.default_rng(5)
    words = r.integers(0, 2**63, 50, np.int64).astype(np.uint64) & fim.HIGH
    words[::7], words[3] = 0, fim.HIGH
    marks, places = fim.Marks(words), np.flatnonzero(words.view(np.uint8))
    assert np.array_equal(marks.select(np.arange(len(places))), places)
    at = np.arange(8 * 49)
    assert np.array_equal(marks.rank(at), np.searchsorted(places, at))


def check_middles(rows, texts):
    for r in rows:
        assert tuple(r["fim"]) == plain_middle(r["text"], r["doc_id"])
        assert r["back"] == (r["text"] or "")
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in rows))) == sorted(map(str, texts))


def test_middles_of_the_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = fim.fill_in_middle(docs, 42)
    rows = out.withColumn("back", fim.restored(out.fim.form, out.fim.output)).collect()
    check_middles(rows, [tuple(r) for r in docs.collect()])
    assert {r["fim"]["form"] for r in rows} == {"plain", "psm", "spm"}


def test_middles_of_awkward_rows(spark, awkward, nothing):
    rows = [(i, t) for i, t in enumerate(["<" * 9 + " <P", "a<S>b", "<M", "P> x", "  ", "\n", "x", " x", "x ", "<S <M <P", "<\x00>"] * 40)]
    more = spark.createDataFrame(rows, "doc_id long, text string").unionByName(awkward.select("doc_id", "text"))
    out = fim.fill_in_middle(more, 42)
    found = out.withColumn("back", fim.restored(out.fim.form, out.fim.output)).collect()
    check_middles(found, [tuple(r) for r in more.collect()])
    clashing = fim.fill_in_middle(awkward, 42, into="quality")
    assert clashing.columns == awkward.columns and clashing.count() == awkward.count()
    assert fim.fill_in_middle(awkward.withColumn("_cuts", awkward.size), 42).where("_cuts IS NULL").count() \
        == awkward.where("size IS NULL").count()
    assert fim.fill_in_middle(nothing, 42).count() == 0


def test_rates_choose_the_forms(awkward):
    forms = {r["form"] for r in fim.fill_in_middle(awkward.where("length(text) > 99"), 1, rate=100, spm_rate=0).select("fim.form").collect()}
    assert forms == {"psm"}
    assert {r["form"] for r in fim.fill_in_middle(awkward, 1, rate=0).select("fim.form").collect()} == {"plain"}


def ids_of(text):
    return LIBRARY.encode_ordinary(text or "")


@settings(max_examples=500, deadline=None)
@given(TEXTS)
@example("౜क़\U000323b0a1\U00011de0")
def test_backtracking_encodes_as_the_library(text):
    encode, tokens = backtrack.codec(MULTI, PATTERN)
    ids = encode(text)
    assert array("I", ids).tolist() == ids_of(text)
    assert tokens.decode(ids) == text.encode()


def test_backtracking_on_long_and_random_words():
    encode, _ = backtrack.codec(MULTI, PATTERN)
    r = random.Random(2)
    texts = ["a" * 3000, "ab" * 2000, " " * 500 + "x", "é" * 700, "*" * 999, "日本" * 900, "x" * 100_000]
    texts += ["".join(r.choice("aeinrstlo") for _ in range(r.randint(1, 40))) for _ in range(3000)]
    texts += ["".join(chr(r.choice([r.randint(0x400, 0x4FF), r.randint(0x4E00, 0x9FFF), r.randint(1, 0xD7FF)]))
                      for _ in range(r.randint(1, 20))) for _ in range(3000)]
    for text in texts:
        assert array("I", encode(text)).tolist() == ids_of(text)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.lists(st.text("abc", min_size=1, max_size=14), min_size=1, max_size=6))
def test_backtracking_by_any_ranks(seed, words):
    """Random vocabularies: tokens that no merges make, and ranks that don't grow with merges."""
    r = random.Random(seed)
    more = {"".join(r.choice("abc") for _ in range(r.randint(2, 5))).encode() for _ in range(r.randint(0, 25))}
    ranks = {t: i for i, t in enumerate([b"a", b"b", b"c", *r.sample(sorted(more), len(more))])}
    tokens = backtrack.Backtracker(ranks)
    for word in words:
        raw = word.encode()
        want = [ranks[raw]] if raw in ranks else [ranks[t] for t in backtrack.merged(raw, ranks)]
        assert array("I", tokens.word(raw)).tolist() == want


def test_words_without_tokens_are_an_error():
    with pytest.raises(ValueError, match="no tokens"):
        backtrack.Backtracker({b"a": 0}).word(b"ab")


def test_backtracking_of_awkward_rows(awkward, nothing):
    coded = backtrack.decoded(backtrack.encoded(awkward, MULTI, PATTERN), MULTI, PATTERN, into="back")
    for r in coded.collect():
        assert array("I", bytes(r["ids"])).tolist() == ids_of(r["text"])
        assert bytes(r["back"]).decode() == (r["text"] or "")
    digest = backtrack.round_trip(awkward, MULTI, PATTERN, into="quality")
    assert digest.columns == awkward.columns
    for r in digest.collect():
        ids = ids_of(r["text"])
        assert tuple(r["quality"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                                       hashlib.sha256((r["text"] or "").encode()).hexdigest())
    assert backtrack.encoded(nothing, MULTI, PATTERN).count() == backtrack.round_trip(nothing, MULTI, PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([0, 1, 2, 300, 2**27]), st.sampled_from([0, 1, 5, 2**20, 2**27]))
def test_planes_give_exact_products_distances_and_sums(seed, size, other):
    r = np.random.default_rng(seed)
    x = r.integers(-size, size, (7, 64), endpoint=True)
    c = r.integers(-other, other, (5, 64), endpoint=True)
    x[0], c[0] = size, -other
    px, pc = planes.to_planes(x), planes.to_planes(c)
    assert np.array_equal(planes.dots(px, pc), x @ c.T)
    assert np.array_equal(planes.squares(px), (x * x).sum(axis=1))
    want = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    cluster, distance = planes.nearest(px, pc)
    assert np.array_equal(cluster, want.argmin(axis=1)) and np.array_equal(distance, want.min(axis=1))
    counts, total = planes.sums(px, cluster, 5)
    for k in range(5):
        assert counts[k] == (cluster == k).sum() and np.array_equal(total[k], x[cluster == k].sum(axis=0))


def plain_clusters(rows, k, rounds, seed=2, scale=256):
    """(key, cluster, distance, inertia of the cluster, inertia, centroid) by whole-number loops."""
    kept = [(key, [int(np.floor(float(x) * scale)) for x in v]) for key, v in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    digest = lambda key: hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    first = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else digest(r[0]), r[0] or 0, r[1]))
    centroids = [v for _, v in first[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for i in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, of) if c == i]
            if own:
                centroids[i] = [sum(x) // len(own) for x in zip(*own)]
    found = [(key, *near(v)[::-1]) for key, v in kept]
    inertia = {i: sum(d for _, c, d in found if c == i) for i in range(k)}
    return sorted(((key, c, d, inertia[c], sum(inertia.values()),
                    hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for key, c, d in found), key=str)


def check_clusters(spark, rows, k, rounds=3, partitions=3):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string")
    found = planes.clustered(df.repartition(partitions), k, rounds, 2, 256)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_clusters(rows, k, rounds)


def test_clusters_by_brute_force(spark):
    r = np.random.default_rng(4)
    around = r.normal(0, 1, (6, 64))
    rows = [(i, (around[i % 6] + r.normal(0, .3, 64)).tolist()) for i in range(200)]
    check_clusters(spark, rows, 9)
    check_clusters(spark, [(i, (r.integers(-2, 2, 64) / 256).tolist()) for i in range(60)], 8)


def test_clusters_of_awkward_vectors(spark):
    r = np.random.default_rng(7)
    good = lambda size=1.0: (r.normal(0, size, 64)).tolist()
    v = good()
    rows = [(0, None), (1, []), (2, v[:63]), (3, v + [0.0]), (4, v[:63] + [None]), (5, v[:63] + [float("nan")]),
            (6, v[:63] + [float("inf")]), (7, v), (7, v), (8, v), (None, v), (None, good()), (9, [0.0] * 64), (10, [-0.0] * 64),
            (11, good(1e5)), (12, [2.0**19] * 64), (13, [-2.0**19] * 64), (-5, good(1e-9))] + [(20 + i, good()) for i in range(9)]
    check_clusters(spark, rows, 5)
    check_clusters(spark, rows, 100)
    check_clusters(spark, [(i, v) for i in range(40)], 4)
    assert planes.clustered(spark.createDataFrame(rows[:7], "vec_id long, embedding array<double>"), 5, 2, 2, 256).count() == 0
    empty = planes.clustered(spark.createDataFrame([], "vec_id long, embedding array<float>"), 5, 2, 2, 256)
    assert empty.count() == 0 and len(empty.columns) == 6
    with pytest.raises(Exception, match="beyond"):
        planes.clustered(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>"), 5, 2, 2, 256).count()
