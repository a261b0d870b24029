"""Encoding whole texts fast: parts between single blanks are encoded once and remembered.

In the byte-level pattern a blank before a visible character always begins a new token, so
the parts of a text between such blanks can be encoded apart. Texts where a part is empty
or begins or ends with white space are encoded as a whole. Of several texts at a time, the
parts not remembered are gathered first and encoded as one text of parts between blanks; a
token that begins with a blank tells where the next part begins.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Callable, Iterator

import numpy as np

from repeatwise.llm.work import worker_state

#: Fixed: how a blank is written in labels of a byte-level vocabulary.
BLANK = "\u0120"
#: Fixed: how the byte-level splitter cuts text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Parts of each of two generations an encoder remembers, and their longest length.
MEMORY, PART_CHARS = 300_000, 48
#: Characters of texts whose new parts are gathered at a time.
GATHERED = 1_000_000
#: Below it are Latin, Greek and Cyrillic; libraries don't agree on which of the newest characters are letters.
SETTLED = "\u0530"
#: Parts encoded as one text.
JOINED = 10_000


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary's file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Parts(dict):
    """Ids of parts that follow a blank, as little-endian unsigned 32-bit integers.

    None stands for a part that can't be encoded apart. When the younger generation is
    full it becomes the older one, from which parts that are met again come back.
    """

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, part: str) -> bytes | None:
        if part in self.older:
            ids = self.older[part]
        elif not part or part[0].isspace() or part[-1].isspace():
            ids = None
        else:
            ids = self.encode(" " + part)
        if len(part) <= PART_CHARS:
            self.keep(part, ids)
        return ids

    def keep(self, part: str, ids: bytes | None) -> None:
        if len(self) >= MEMORY:
            self._age()
        self[part] = ids

    def _age(self) -> None:
        self.older = dict(self)
        self.clear()

    def learn(self, parts: set[str], encode: Callable[[list[str]], list[bytes]]) -> None:
        """Remembers the new ones among the parts that can be, of settled characters."""
        new = [p for p in parts.difference(self) if 0 < len(p) <= PART_CHARS and p not in self.older
               and p.strip() == p and (p.isascii() or max(p) < SETTLED)]
        for at in range(0, len(new), JOINED):
            some = new[at:at + JOINED]
            if self and len(self) + len(some) > MEMORY:
                self._age()
            self.update(zip(some, encode(some)))


class Encoder:
    """Encodes texts whose special strings are those of `specials` (string to ids)."""

    #: `batch` encodes parts, each as if it followed a blank.
    def __init__(self, encode: Callable[[str], bytes], specials: dict[str, bytes],
                 batch: Callable[[list[str]], list[bytes]] | None = None, vocabulary: int = 0) -> None:
        self.encode, self.specials, self.parts, self.batch = encode, specials, Parts(encode), batch
        self.vocabulary = vocabulary

    def __call__(self, text: str | None, split: list[str] | None = None) -> bytes:
        """Ids of a text; `split` are the parts between its blanks, where they are known."""
        if not text:
            return b""
        for special, ids in self.specials.items():
            if special in text:
                return ids.join(map(self, text.split(special)))
        first, *rest = split or text.split(" ")
        if not rest:
            return self.encode(text)
        if not first or first[-1].isspace():
            return self.encode(text)
        try:
            return self.encode(first) + b"".join(map(self.parts.__getitem__, rest))
        except TypeError:
            return self.encode(text)

    def many(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text in turn."""
        start = 0
        while start < len(texts):
            end, size, found, splits = start, 0, set(), []
            while end < len(texts) and size < GATHERED:
                splits.append(texts[end].split(" ") if texts[end] else [])
                found.update(splits[-1])
                size += len(texts[end] or "")
                end += 1
            if self.batch:
                self.parts.learn(found, self.batch)
            yield from map(self, texts[start:end], splits)
            start = end


def encoder(path: str) -> Encoder:
    """Encoder with the ids of the tokenizers library, one for each Python worker."""
    return worker_state(f"encoder {path}", lambda: _by_library(path))


def _ranked(path: str) -> Callable[[str], np.ndarray] | None:
    """Ids of text by the merges of a vocabulary file, if its ids are in the order of its merges.

    Then merging the pair with the least id of the two together is merging by the list, and the
    tiktoken library does it in a fifth of the time.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    characters, special = byte_characters(), {t["content"] for t in spec.get("added_tokens", [])}
    vocab = spec["model"]["vocab"]
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    if made != sorted(set(made)):
        return None
    ranks = {bytes(map(characters.__getitem__, t)): i for t, i in vocab.items() if t not in special}
    model = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: model.encode_to_numpy(text, disallowed_special=())


def _by_library(path: str) -> Encoder:
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    to_bytes = lambda ids: struct.pack(f"<{len(ids)}I", *ids)
    encode = lambda text: to_bytes(model.encode(text, add_special_tokens=False).ids)
    specials = {t.content: to_bytes([i]) for i, t in model.get_added_tokens_decoder().items()}
    ranked = _ranked(path)
    blank = np.zeros(model.get_vocab_size(), bool)
    for label, i in model.get_vocab().items():
        blank[i] = label.startswith(BLANK)

    def batch(parts: list[str]) -> list[bytes]:
        joined = " " + " ".join(parts)
        if not ranked:
            return [encode(" " + p) for p in parts]
        ids = ranked(joined).astype("<u4")
        starts = np.flatnonzero(blank[ids])
        raw, ends = ids.tobytes(), (4 * np.append(starts[1:], len(ids))).tolist()
        return [raw[a:b] for a, b in zip((4 * starts).tolist(), ends, strict=True)]

    return Encoder(encode, specials, batch, len(blank))
