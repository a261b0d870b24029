"""Byte-pair encoding by a tokenization automaton.

The automaton reads token after token; the paths it accepts are the correct encodings. It
starts with one state and an arc for each byte, and grows by a gadget for each merge
(u, v) -> w, in order. Wherever an arc u leads to a state with an arc v, that state is
replaced, behind u, by a copy without v, and an arc w is added beside u, to where v led.

All arcs of one token lead to the same state, so a state is named by the token before it,
and the copies need no storage of their own: a state keeps the arcs that gadgets have taken
from it, with their times, and otherwise refers to the state it was copied from, as of the
time of copying. An arc is there if no gadget took it, or an arc it was built from, in time.
`arc` reads this off the two derivations, and remembers the answer in the transition table.

Each prefix of a word has exactly one correct encoding, so at most one path leads to a place of
a word. A trie of tokens names the arcs that may go on from a place; the longest one that the
automaton has is followed first, and where a path ends too early, the next one. No place is
come to twice, and most are never looked at. Decoding emits the labels of the arcs.

Texts are split first at special strings and then by the pattern of the vocabulary's
byte-level splitter. Null counts as empty and gives no ids. Texts of any length are taken whole,
equal rows get equal results, and an empty table gives an empty table; a column of the result's name is replaced.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatwise.llm.tokens import PATTERN, Encoder, byte_characters
from repeatwise.llm.work import fresh, ship, worker_state

#: Transitions and words a worker remembers.
TRANSITIONS, WORDS, WORD_BYTES = 500_000, 100_000, 64
#: Texts held as Python strings at a time.
ROWS = 256
START = NONE = -1
NEVER = 1 << 60


class Automaton:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        characters = byte_characters()
        vocab = spec["model"]["vocab"]
        to_bytes = lambda token: bytes(map(characters.__getitem__, token))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.labels: dict[int, bytes] = {i: to_bytes(t) for t, i in vocab.items() if t not in self.special}
        self.labels |= {i: t.encode() for t, i in self.special.items()}
        self.made: dict[int, tuple[int, int, int]] = {}
        self.taken: dict[int, dict[int, int]] = {}
        for time, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self._gadget(vocab[left], vocab[right], vocab[left + right], time)
        self._trie(i for t, i in vocab.items() if t not in self.special and self._whole(i))
        self.table: dict[tuple[int, int], bool] = {}

    def _gadget(self, u: int, v: int, w: int, time: int) -> None:
        # The state behind u loses v; the state behind w starts as what v led to at this time.
        self.taken.setdefault(u, {}).setdefault(v, time)
        self.made.setdefault(w, (u, v, time))

    def _whole(self, token: int) -> bool:
        """Whether some text becomes this token: a byte, or made of such tokens that follow one another by then."""
        if token not in self.made:
            return len(self.labels[token]) == 1
        u, v, time = self.made[token]
        return self.arc(u, v, time)

    def _trie(self, tokens: Iterator[int]) -> None:
        self.step: dict[int, int] = {}
        above, own = [0], [NONE]
        for i in tokens:
            node = 0
            for byte in self.labels[i]:
                key = node << 8 | byte
                if key not in self.step:
                    self.step[key] = len(own)
                    above.append(node)
                    own.append(NONE)
                node = self.step[key]
            own[node] = i
        # The longest token down to a node, and the longest one that another begins with.
        self.best, self.shorter = [NONE], {}
        for node in range(1, len(own)):
            before = self.best[above[node]]
            if own[node] != NONE:
                self.shorter[own[node]] = before
            self.best.append(before if own[node] == NONE else own[node])
        self.sizes = {i: len(label) for i, label in self.labels.items()}
        self.longest = max(self.sizes.values())

    def arc(self, state: int, token: int, until: int = NEVER) -> bool:
        """Whether the state behind the token `state` has an arc `token` (before the time `until`)."""
        if state == START:
            return True
        behind = state
        while True:
            taken = self.taken.get(behind)
            if taken:
                part, before = token, NEVER
                while True:
                    time = taken.get(part)
                    # Equal times: a token merged with itself. The copy without it, behind it,
                    # gets no arc for the pair either, as pairs are merged from the left.
                    if time is not None and time < until and time <= before:
                        return False
                    if part not in self.made:
                        break
                    part, _, before = self.made[part]
            if behind not in self.made:
                return True
            _, behind, until = self.made[behind]

    def word(self, word: bytes) -> bytes:
        """Ids of a word without a split inside, as little-endian unsigned 32-bit integers."""
        n, longest = len(word), self.longest
        step, best, shorter, sizes, table = self.step.get, self.best, self.shorter, self.sizes, self.table
        path, at, state = [], 0, START
        while at < n:
            node = 0
            for byte in word[at:at + longest]:
                below = step(node << 8 | byte)
                if below is None:
                    break
                node = below
            token = best[node]
            while True:
                while token == NONE:
                    last = path.pop()
                    at, state, token = at - sizes[last], path[-1] if path else START, shorter[last]
                there = table.get((state, token))
                if there is None:
                    if len(table) >= TRANSITIONS:
                        table.clear()
                    there = table[state, token] = self.arc(state, token)
                if there:
                    break
                token = shorter[token]
            path.append(token)
            at, state = at + sizes[token], token
        return array("I", path).tobytes()

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.labels.__getitem__, array("I", ids))).decode("utf-8", "replace")


class _Words(dict):
    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> bytes:
        ids = self.automaton.word(word.encode())
        if len(word) <= WORD_BYTES:
            if len(self) >= WORDS:
                self.clear()
            self[word] = ids
        return ids


def codec(path: str) -> tuple[Encoder, Automaton]:
    """Encoder and automaton of a vocabulary file, one for each Python worker."""
    return worker_state(f"codec {path}", lambda: _by_automaton(path))


def _by_automaton(path: str) -> tuple[Encoder, Automaton]:
    import regex

    automaton, split = Automaton(path), regex.compile(PATTERN)
    words = _Words(automaton)
    specials = {s: array("I", [i]).tobytes() for s, i in automaton.special.items()}

    def batch(parts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for piece in split.findall(" " + " ".join(parts)):
            if piece[0] == " ":
                out.append(words[piece])
            else:
                out[-1] += words[piece]
        return out

    return Encoder(lambda text: b"".join(map(words.__getitem__, split.findall(text))), specials, batch), automaton


def encoded(docs: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """`docs` with the ids of `text` in `into` (binary, little-endian unsigned 32-bit)."""
    ship(docs.sparkSession)

    @F.arrow_udf("binary")
    def ids(column: pa.Array) -> pa.Array:
        encode, _ = codec(path)
        return pa.array(encode.many(column.to_pylist()), pa.binary())

    return docs.withColumn(into, ids(F.col(text)))


def decoded(docs: DataFrame, path: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """`docs` with the text of `ids` in `into`; null ids give null."""
    ship(docs.sparkSession)

    @F.arrow_udf("string")
    def texts(column: pa.Array) -> pa.Array:
        _, automaton = codec(path)
        return pa.array([None if x is None else automaton.decode(x) for x in column.to_pylist()], pa.string())

    return docs.withColumn(into, texts(F.col(ids)))


def round_trip(docs: DataFrame, path: str, text: str = "text", into: str = "coded") -> DataFrame:
    """`docs` with a struct `into`: n_tokens, and SHA-256 of the ids and of the text decoded from them."""
    ship(docs.sparkSession)

    @F.arrow_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    def digests(column: pa.Array) -> pa.Array:
        encode, automaton = codec(path)
        rows = []
        for at in range(0, len(column), ROWS):
            for ids in encode.many(column.slice(at, ROWS).to_pylist()):
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                             hashlib.sha256(automaton.decode(ids).encode()).hexdigest()))
        n, a, b = zip(*rows) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                                          ["n_tokens", "ids_sha256", "decoded_sha256"])

    raw = fresh(docs, "_coded")
    return docs.withColumn(raw, digests(F.col(text))).withColumn(into, F.col(raw)).drop(raw)
