"""Encoding, packing and the pipeline against the library, brute force and edge cases."""

import functools
import itertools
import json
import random
import re
import zlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from repeatwise.llm import binpack, bpe, packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PARTS = list("abcdeABC  \n\t'.,#*1239éñüßЖ日本😀\u0085\x1c\x1d²½​́") + [
    "<|endoftext|>", "'s", "'ll", "the ", "  ", "***", "aaaa"]


@functools.cache
def loaded():
    """Automaton, its encoder and the library's, loaded once: a worker keeps one operator's at a time."""
    return *bpe._by_automaton(PATH), tokens._by_library(PATH)


def ids_of(text):
    return np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids, "<u4")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40).map("".join) | st.text(max_size=60))
def test_automaton_encodes_as_the_library(text):
    encode, automaton, by_library = loaded()
    ids = encode(text)
    assert ids == ids_of(text).tobytes()
    assert automaton.decode(ids) == LIBRARY.decode(ids_of(text).tolist(), skip_special_tokens=False) == text
    assert by_library(text) == ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join) | st.text(max_size=30) | st.none(), max_size=8),
       st.sampled_from([1, 3, 10**6]), st.sampled_from([1, 2, 10**6]), st.sampled_from([2, 5, 10**6]))
def test_many_texts_are_encoded_as_each(texts, gathered, joined, memory):
    encode = loaded()[2]
    encode.parts.clear()
    encode.parts.older.clear()
    limits = tokens.GATHERED, tokens.JOINED, tokens.MEMORY
    try:
        tokens.GATHERED, tokens.JOINED, tokens.MEMORY = gathered, joined, memory
        assert list(encode.many(texts)) == [ids_of(t).tobytes() for t in texts]
    finally:
        tokens.GATHERED, tokens.JOINED, tokens.MEMORY = limits
    assert list(encode.many(texts)) == [ids_of(t).tobytes() for t in texts]


def test_words_of_settled_characters_are_encoded_as_by_the_library():
    r = random.Random(4)
    letters = [chr(c) for c in range(33, 0x530) if not chr(c).isspace()]
    parts = ["".join(r.choice(letters[:94] if i % 2 else letters) for _ in range(r.randint(1, 12))) for i in range(6000)]
    parts += ["".join(r.choice("aeioustrnl'") for _ in range(r.randint(1, 20))) for _ in range(6000)]
    encode = loaded()[2]
    encode.parts.clear()
    encode.parts.learn(set(parts), encode.batch)
    assert all(encode.parts[p] == ids_of(" " + p).tobytes() for p in parts)


def test_automaton_on_long_words():
    encode = loaded()[0]
    for text in ("a" * 3000, "ab" * 2000, " " * 500 + "x", "é" * 700, "*" * 999):
        assert encode(text) == ids_of(text).tobytes()


def test_automaton_looks_at_places_on_its_path_only():
    automaton = bpe.Automaton(PATH)
    assert automaton.word(b" government") == ids_of(" government").tobytes()
    assert len(automaton.table) == len(ids_of(" government"))


def test_automaton_tries_shorter_arcs_where_longer_ones_end(tmp_path):
    # "abc" is a, bc, though ab is a token; "bcd" is a token that no merge makes.
    merges = ["b c", "a b", "c d", "ab cd", "a a", "cd a"]
    tokens_ = [*tokens.byte_characters(), *(m.replace(" ", "") for m in merges), "bcd"]
    model = {"type": "BPE", "vocab": {t: i for i, t in enumerate(tokens_)}, "merges": merges}
    pretokenizer = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    path = tmp_path / "small.json"
    path.write_text(json.dumps({"version": "1.0", "added_tokens": [], "model": model, "pre_tokenizer": pretokenizer}))
    library, automaton = Tokenizer.from_file(str(path)), bpe.Automaton(str(path))
    for n in range(1, 7):
        for word in map("".join, itertools.product("abcd", repeat=n)):
            assert automaton.word(word.encode()) == np.array(library.encode(word).ids, "<u4").tobytes(), word


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join) | st.text(max_size=30) | st.none(), max_size=8))
def test_automaton_encodes_many_texts_as_each(texts):
    encode = loaded()[0]
    encode.parts.clear()
    encode.parts.older.clear()
    assert list(encode.many(texts)) == [ids_of(t).tobytes() for t in texts]


def test_encoding_of_awkward_rows(awkward, nothing):
    coded = bpe.decoded(bpe.encoded(awkward, PATH), PATH, into="back")
    for r in coded.collect():
        assert bytes(r["ids"]) == ids_of(r["text"]).tobytes() and r["back"] == (r["text"] or "")
    digest = bpe.round_trip(awkward, PATH, into="quality")
    assert digest.columns == awkward.columns and digest.count() == awkward.count()
    assert bpe.encoded(nothing, PATH).count() == bpe.round_trip(nothing, PATH).count() == 0


def check_pieces(rows, texts, capacity):
    of = {}
    for r in rows:
        of.setdefault(r["doc_id"], []).append(r)
    for key, text in texts.items():
        ids = np.append(ids_of(text), packing.END).astype("<u4")
        own = sorted(of[key], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1]]
        assert sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == capacity for r in own[1:])
        assert all(zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in own)
    check_sequences(rows, capacity)


def check_sequences(rows, capacity):
    of = {}
    for r in rows:
        of.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in of.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]]
        assert sum(n for _, n in own) <= capacity
    return len(of)


def test_patterns_pack_the_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack_patterns(docs, PATH).collect()
    check_pieces(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, 1024)
    total = sum(r["length"] for r in rows)
    assert check_sequences(rows, 1024) <= 1.01 * -(-total // 1024)


def test_ids_of_pieces_leave_the_worker_only_if_wanted(monkeypatch):
    task = SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3))
    monkeypatch.setattr(packing, "TaskContext", task)
    texts = [None, "a word", "x " * 90]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3], pa.int64()), pa.array(texts)], ["id", "text"])
    kept, = packing._pieces(PATH, 64, True)(iter([batch]))
    slim, = packing._pieces(PATH, 64, False)(iter([batch]))
    assert slim.schema.names == kept.schema.names[:-1] and slim.to_pylist() == kept.drop_columns("ids").to_pylist()
    wanted = b"".join(ids_of(t).tobytes() + packing.END_IDS for t in texts)
    assert b"".join(r["ids"] for r in kept.to_pylist()) == wanted


def test_packing_of_awkward_rows(spark, awkward, nothing):
    rows = packing.pack_patterns(awkward, PATH, capacity=128, with_ids=True).collect()
    check_sequences(rows, 128)
    wanted = sum(len(ids_of(r["text"])) + 1 for r in awkward.collect())
    assert sum(r["length"] for r in rows) == wanted == sum(len(r["ids"]) // 4 for r in rows)
    assert packing.pack_patterns(nothing, PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=120))
def test_plan_places_every_piece_once(lengths):
    histogram = np.bincount(lengths, minlength=33)
    plan = packing.Plan(histogram, 32)
    sizes = np.array(sorted(lengths), np.int64)
    ranks = np.concatenate([np.arange(n) for n in histogram if n] or [np.zeros(0, int)])
    sequence, offset = plan.place(sizes, ranks)
    rows = [dict(zip(("sequence_id", "offset", "length"), x)) for x in zip(sequence, offset, sizes)]
    assert check_sequences(rows, 32) == plan.n_sequences == len(set(sequence))
    # Never worse than first-fit-decreasing is known to be.
    assert plan.n_sequences <= 11 / 9 * -(-sum(lengths) // 32) + 1 + sum(n > 16 for n in lengths)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80))
def test_segment_tree_finds_the_best_fit(sizes):
    rows, room = binpack.best_fit_decreasing(sizes, 20), []
    assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in r) <= 20 for r in rows)
    for size in sorted(sizes, reverse=True):  # the same by looking at every row
        fits = [x for x in room if x >= size]
        best = min(fits) if fits else 20
        if fits:
            room.remove(best)
        room.append(best - size)
    assert sorted(20 - sum(sizes[i] for i in r) for r in rows) == sorted(room)


def test_packed_matrices_round_trip(spark, awkward, nothing, tmp_path):
    rows = binpack.packed_rows(awkward, PATH, capacity=64, block=50)
    binpack.write_packed(rows, str(tmp_path / "rows"))
    pieces = {}
    for r in spark.read.parquet(str(tmp_path / "rows")).collect():
        ids, positions = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["positions"], "<u2")
        assert len(ids) == len(positions) == 64
        assert r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] <= 64
        for a, b, key, piece, start in zip(r["cu_seqlens"], r["cu_seqlens"][1:], r["doc_ids"], r["pieces"], r["starts"]):
            assert positions[a:b].tolist() == list(range(b - a))
            pieces.setdefault(key, []).append((piece, start, ids[a:b]))
        assert (ids[r["n_tokens"]:] == binpack.PAD).all()
    for r in awkward.where("doc_id IS NOT NULL AND doc_id <> 5").collect():
        own = sorted(pieces[r["doc_id"]], key=lambda p: p[0])
        joined = np.concatenate([p[2] for p in own])
        assert joined.tolist() == [*ids_of(r["text"]).tolist(), binpack.END]
        assert [p[1] for p in own] == [64 * k for k in range(len(own))]
    assert binpack.packed_rows(nothing, PATH).count() == 0


def test_ids_that_do_not_fit_are_an_error(spark, awkward, monkeypatch):
    class Task:
        partitionId = staticmethod(lambda: 0)  # noqa: N815

    wide = tokens.Encoder(lambda text: b"", {}, vocabulary=100_000)
    monkeypatch.setattr(binpack, "encoder", lambda path: wide)
    monkeypatch.setattr(binpack.TaskContext, "get", lambda: Task)
    rows = iter([pa.RecordBatch.from_pydict({"id": [1], "text": ["a"]})])
    with pytest.raises(ValueError, match="16 bits"):
        list(binpack._packed(PATH, 64, 10, False)(rows))


def test_stages_return_the_columns_of_documents(spark, awkward, sf_dir):
    docs = awkward
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.collect(), docs.schema)
    kept = [r["doc_id"] for r in docs.collect()]
    assert 11 in kept and 0 not in kept and 12 not in kept and not {6, 7} & set(kept)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == set(kept)


def test_stages_on_nothing(spark, nothing, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf_dir).count() == 0


def passes_quality(text):
    """The base rules, and the repeat rules by looking up windows of every length from 3 words on."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    size, n = [len(w.encode()) for w in words], len(words)
    repeated, covered, longest, k = set(), set(), 0, 3
    while True:
        at = defaultdict(list)
        for i in range(n - k + 1):
            at[tuple(words[i:i + k])].append(i)
        again = [i for places in at.values() if len(places) > 1 for i in places]
        if not again:
            break
        longest = max(longest, max(sum(size[i:i + k]) for i in again))
        marked = {p for i in again for p in range(i, i + k)}
        repeated = marked if k == 8 else repeated
        covered |= marked
        k += 1
    if n < 20 or 100 * len(repeated) > 30 * n:
        return False
    return sum(size[p] for p in covered) <= 0.3 * sum(size) and longest <= 0.25 * sum(size)


def test_pipeline_equals_its_stages_by_brute_force(spark, sf_dir):
    """Every stage in plain Python at the pipeline's own parameters, but language, whose model has tests of its own."""
    from test_llm_groups import plain_groups
    from test_llm_texts import plain_lines

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [r for r in docs.collect() if passes_quality(r["text"])]
    spoken = corpus_pipeline.language_stage(spark, spark.createDataFrame(rows, docs.schema), sf_dir).collect()
    assert 0.8 * len(rows) < len(spoken) <= len(rows) < docs.count()
    cleaned = plain_lines([(r["doc_id"], r["text"], r["source"]) for r in spoken], corpus_pipeline.RATIO, corpus_pipeline.MIN_PAGES)
    _, group = plain_groups([(i, t) for i, _, t in cleaned], threshold=corpus_pipeline.SIMILARITY)
    want = {i: t for i, _, t in cleaned if group[i] == i}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in got} == set(want)
    check_pieces(got, want, 1024)


def test_random_texts_keep_their_order_of_pieces():
    r = random.Random(1)
    encode = loaded()[2]
    for _ in range(200):
        text = "".join(r.choice(PARTS) for _ in range(r.randint(0, 50)))
        assert encode(text) == ids_of(text).tobytes()


@pytest.mark.parametrize("lengths", [[700] * 50, [600, 424] * 20 + [300] * 9, [1024] * 3, [1]])
def test_best_fit_reaches_the_bound(lengths):
    plan = packing.Plan(np.bincount(lengths, minlength=1025), 1024)
    large = sum(n > 512 for n in lengths)
    assert plan.n_sequences <= max(large, -(-sum(lengths) // 1024)) + 1
