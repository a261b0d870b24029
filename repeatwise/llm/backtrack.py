"""Byte-pair encoding by backtracking from longest matches.

A sequence of tokens is the encoding of its bytes if and only if each two neighbours are: as
long as no merge crosses a border between tokens, the merges inside two neighbours are those
that happen in their bytes alone, so the first crossing merge would happen there too. A
word is therefore encoded from the left by the longest token that goes with the one before
it; where none does, the last token is taken back and a shorter one tried. As the bytes up to
any place have one encoding only, no place is reached twice, and the work is linear in the word.

The longest token at a place comes from a trie over all tokens (pyahocorasick), with each byte
as the Latin-1 character of the same number. Whether two tokens may meet is computed once and
remembered. At their border, x is the end of the left token and y
the beginning of the right one as the merges make them, and a merge of x and y crosses the
border if it comes before both are merged into something larger; of two merges of equal rank
the left one comes first.

Texts are cut by the vocabulary's pattern first. A word that is a token as a whole gets that
token, whatever its merges. Null counts as empty and gives no ids; white space and very long
words are encoded like all others; equal rows give equal results, there are no ties, and an
empty table gives an empty table. A column that has the name of the result is replaced.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatwise.llm.tokens import Encoder
from repeatwise.llm.work import fresh, ship, worker_state

#: Pairs and words a worker remembers, and the longest remembered word.
PAIRS, WORDS, WORD_CHARS = 1_000_000, 100_000, 64
NEVER = 1 << 60
#: Fixed: letters and numbers (hexadecimal) that `regex` knows and the Unicode version 16 of
#: vocabularies' own splitters doesn't.
NEWER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 "
    "16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 "
    "1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED "
    "1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F")


def load_ranks(path: str) -> dict[bytes, int]:
    """Rank, which is also the id, of each token of a vocabulary file: base64, blank, rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def merged(word: bytes, ranks: dict[bytes, int], stop: int = NEVER) -> list[bytes]:
    """Tokens of a word by merging the pair of least rank, the leftmost first, below rank `stop`."""
    parts = [word[i:i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= stop:
            break
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Cuts texts by a pattern; characters of `NEWER` are neither letters nor numbers to it."""
    import regex

    newer = "[" + "".join("-".join(rf"\U{int(x, 16):08X}" for x in r.split("-")) for r in NEWER.split()) + "]"
    some, usual = regex.compile(newer).search, regex.compile(pattern).findall
    for kind in (r"\p{L}", r"\p{N}"):
        pattern = pattern.replace(kind, f"[{kind}--{newer}]")
    strict = regex.compile(pattern, regex.V1).findall
    return lambda text: usual(text) if text.isascii() or not some(text) else strict(text)


#: One end of a token at a time: its bytes, the rank that made it, the rank that takes it up.
Spine = list[tuple[bytes, int, int]]


class Backtracker:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        import ahocorasick

        self.ranks = ranks
        self.labels: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        self.matcher = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.labels[i] = token
            self.matcher.add_word(token.decode("latin-1"), i)
        self.reach = max(map(len, ranks), default=0)
        self.shorter: dict[int, int] = {}
        self.spines: dict[int, tuple[Spine, Spine] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def spine(self, token: int) -> tuple[Spine, Spine] | None:
        """What lies at the left and at the right end of a token while it is made, latest first.

        None if its merges don't come in the order of their ranks, or don't make it at all.
        """
        if token not in self.spines:
            label = self.labels[token]
            if len(label) == 1:
                self.spines[token] = [(label, -1, NEVER)], [(label, -1, NEVER)]
            else:
                parts = merged(label, self.ranks, token)
                inner = [self.spine(self.ranks[part]) for part in parts] if len(parts) == 2 else [None]
                self.spines[token] = None if None in inner else tuple(
                    [(label, token, NEVER), (*part[side][0][:2], token), *part[side][1:]]
                    for side, part in enumerate(inner))
        return self.spines[token]

    def meet(self, left: int, right: int) -> bool:
        """Whether the two tokens are the encoding of their bytes."""
        if self.spine(left) is None or self.spine(right) is None:
            a, b = self.labels[left], self.labels[right]
            return merged(a + b, self.ranks) == [a, b]
        xs, ys = self.spine(left)[1], self.spine(right)[0]
        i = j = 0
        while True:
            (x, made_x, taken_x), (y, made_y, taken_y) = xs[i], ys[j]
            rank = self.ranks.get(x + y)
            if rank is not None and rank < taken_x and rank <= taken_y:
                return False
            if made_x == made_y == -1:
                return True
            # One step back in time: the one made later is not there yet.
            if made_x > made_y:
                i += 1
            else:
                j += 1

    def meets(self, left: int, right: int) -> bool:
        """The same, remembered."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.meet(left, right)
        return known

    def longest(self, text: str) -> int:
        """The longest token a Latin-1 text begins with, -1 if none."""
        for size in range(self.matcher.longest_prefix(text), 0, -1):
            token = self.matcher.get(text[:size], -1)
            if token >= 0:
                return token
        return -1

    def word(self, word: bytes) -> bytes:
        """Ids of a word as little-endian unsigned 32-bit integers."""
        whole = self.ranks.get(word)
        if whole is not None:
            return array("I", [whole]).tobytes()
        text, n, reach = word.decode("latin-1"), len(word), self.reach
        labels, meets, shorter, longest = self.labels, self.meets, self.shorter, self.longest
        out, place = array("I"), 0
        token = longest(text[:reach])
        while place < n:
            if token < 0:
                if not out:
                    raise ValueError(f"the vocabulary has no tokens for {word[:60]!r}")
                token = out.pop()
                place -= len(labels[token])
            elif not out or meets(out[-1], token):
                out.append(token)
                place += len(labels[token])
                token = longest(text[place:place + reach])
                continue
            # The next shorter token that begins like this one.
            if token not in shorter:
                shorter[token] = longest(labels[token][:-1].decode("latin-1"))
            token = shorter[token]
        return out.tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.labels.__getitem__, array("I", ids)))


class _Words(dict):
    """Ids of words, bounded; long words are encoded anew each time."""

    def __init__(self, encode: Callable[[bytes], bytes]) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word.encode())
        if len(word) <= WORD_CHARS:
            if len(self) >= WORDS:
                self.clear()
            self[word] = ids
        return ids


def codec(path: str, pattern: str) -> tuple[Encoder, Backtracker]:
    """Encoder and tokens of a vocabulary file, one for each Python worker."""
    def build() -> tuple[Encoder, Backtracker]:
        tokens, split = Backtracker(load_ranks(path)), splitter(pattern)
        words = _Words(tokens.word)
        return Encoder(lambda text: b"".join(map(words.__getitem__, split(text))), {}), tokens

    return worker_state(f"backtrack {path} {pattern}", build)


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """`docs` with the ids of `text` in `into` (binary, little-endian unsigned 32-bit)."""
    ship(docs.sparkSession)

    @F.arrow_udf("binary")
    def ids(column: pa.Array) -> pa.Array:
        encode, _ = codec(path, pattern)
        return pa.array([encode(value.as_py()) for value in column], pa.binary())

    return docs.withColumn(into, ids(F.col(text)))


def decoded(docs: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "bytes") -> DataFrame:
    """`docs` with the bytes that `ids` stand for in `into`; null ids give null."""
    ship(docs.sparkSession)

    @F.arrow_udf("binary")
    def labels(column: pa.Array) -> pa.Array:
        _, tokens = codec(path, pattern)
        return pa.array([None if not x.is_valid else tokens.decode(x.as_py()) for x in column], pa.binary())

    return docs.withColumn(into, labels(F.col(ids)))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "coded") -> DataFrame:
    """`docs` with a struct `into`: n_tokens, and SHA-256 of the ids and of the bytes decoded from them.

    The ids are hashed as decimal numbers joined by commas.
    """
    ship(docs.sparkSession)

    @F.arrow_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    def digests(column: pa.Array) -> pa.Array:
        encode, tokens = codec(path, pattern)
        n, names, texts = [], [], []
        for value in column:
            ids = encode(value.as_py())
            n.append(len(ids) // 4)
            names.append(hashlib.sha256(",".join(map(str, array("I", ids))).encode()).hexdigest())
            texts.append(hashlib.sha256(tokens.decode(ids)).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(names, pa.string()), pa.array(texts, pa.string())],
                                          ["n_tokens", "ids_sha256", "decoded_sha256"])

    raw = fresh(docs, "_coded")
    return docs.withColumn(raw, digests(F.col(text))).withColumn(into, F.col(raw)).drop(raw)
