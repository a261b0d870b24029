"""Quality rules from a suffix array: how much of a text is repetition of itself.

Words are `[^\\x20\\x09-\\x0D]+`. The suffix array of a text's words is built by prefix
doubling, where only suffixes that still share a rank are sorted again. Two neighbours in
the array have a longest common prefix (LCP); the intervals of the array over which it
doesn't fall below a length are the maximal repeated substrings of that length. At each
word, the longest of them that starts there is as long as the larger LCP with its two
neighbours, and the union of these spans is the union of all maximal repeats.

A text fails the base rules with under `MIN_WORDS` words or with more than
`MAX_REPEAT_WORDS` of its words in repeated 8-word windows. It fails the repeat rules if
repeats of at least `min_repeat` words hold more than `max_covered` of its bytes in words, or
the longest of them more than `max_longest`. Repeats count from fewer words than the base
windows have, so that stuttering and short phrases said over and over are seen. Null and empty texts have no words and fail
the base rules. Rows never influence each other, so copies and ties get equal results. Texts of
any length are taken whole. An empty table gives an empty table; a column of the result's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatwise.llm.work import fresh, ship, worker_state

MIN_WORDS, WINDOW, MAX_REPEAT_WORDS = 20, 8, 30
#: Words from which a repeat counts for the method's own verdict.
MIN_REPEAT = 3
#: Words of a group of texts that are sorted together.
GROUP_WORDS = 1 << 17
SPACE = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
FIELDS = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("covered", pa.float64()),
    ("longest", pa.float64()), ("longest_words", pa.int64()),
    ("spans", pa.list_(pa.int32())),
]
SCHEMA = ("struct<n_words: long, word_chars: long, n_symbols: long, n_dup_lines: long, "
          "n_repeat_words: long, covered: double, longest: double, longest_words: long, "
          "spans: array<int>>")


def suffix_repeats(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word, the length in words of the longest repeat that starts there.

    `words` are integers, equal where the words are and different across texts; `ends` is
    for each position the end of its text.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(words, kind="stable")
    levels = []
    rank = np.empty(n, np.int64)
    first = np.concatenate([[True], words[order][1:] != words[order][:-1]])
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    active, step = order, 1
    while True:
        levels.append(rank)
        # Only suffixes that share their rank with another one can be part of a longer repeat.
        group = rank[active]
        same = group[1:] == group[:-1]
        keep = np.zeros(len(active), bool)
        keep[1:] |= same
        keep[:-1] |= same
        active = active[keep]
        if not len(active):
            break
        ahead = active + step
        inside = ahead < ends[active]
        second = np.where(inside, rank[np.where(inside, ahead, 0)], -1)
        by = np.lexsort((second, rank[active]))
        active, second = active[by], second[by]
        group = rank[active]
        start = np.concatenate([[True], group[1:] != group[:-1]])
        new = start | np.concatenate([[True], second[1:] != second[:-1]])
        at = np.arange(len(active))
        offset = np.maximum.accumulate(np.where(new, at, 0)) - \
            np.maximum.accumulate(np.where(start, at, 0))
        rank = rank.copy()
        rank[active] = group + offset
        step *= 2
    array = np.empty(n, np.int64)
    array[rank] = np.arange(n)
    # Neighbours with different words have an LCP of 0 and need no search.
    a, b = array[:-1], array[1:]
    pairs = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[pairs], b[pairs]
    common = np.zeros(len(pairs), np.int64)
    for power in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < ends[a]) & (y < ends[b])
        equal = inside & (levels[power][np.where(inside, x, 0)] == levels[power][np.where(inside, y, 0)])
        common += np.where(equal, 1 << power, 0)
    lcp = np.zeros(n + 1, np.int64)
    lcp[pairs + 1] = common
    longest = np.empty(n, np.int64)
    longest[array] = np.maximum(lcp[:-1], lcp[1:])
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a repeat of at least `least` words."""
    n = len(longest)
    starts = np.flatnonzero(longest >= least)
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    np.subtract.at(edge, starts + longest[starts], 1)
    return np.cumsum(edge[:n]) > 0


def measure(texts: Iterable[bytes | None], min_repeat: int) -> list[tuple]:
    """The values of `FIELDS` for each text."""
    rows, group, total = [], [], 0
    for text in texts:
        text = text or b""
        words = text.split()
        if group and total + len(words) > GROUP_WORDS:
            rows += _group(group, min_repeat)
            group, total = [], 0
        group.append((text, words))
        total += len(words)
    return rows + _group(group, min_repeat) if group else rows


def _group(group: list[tuple[bytes, list[bytes]]], min_repeat: int) -> list[tuple]:
    """Texts whose words are sorted together."""
    sizes = np.array([len(words) for _, words in group], np.int64)
    flat = [w for _, words in group for w in words]
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, len(flat))
    lengths = np.fromiter(map(len, flat), np.int64, len(flat))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(group)), sizes)
    # Words of different texts must differ: their ranks never mix.
    hashed = hashed + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    longest = suffix_repeats(hashed, bounds[1:][owner])
    in_window, in_repeat = covered(longest, WINDOW), covered(longest, min_repeat)
    return [_row(text, slice(bounds[k], bounds[k + 1]), longest, in_window, in_repeat, lengths, min_repeat)
            for k, (text, _) in enumerate(group)]


def _row(text, own, longest, in_window, in_repeat, lengths, min_repeat) -> tuple:
    mine, size = longest[own], lengths[own]
    n_words, n_bytes = len(mine), int(size.sum())
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    inside = in_repeat[own]
    top, part = 0, 0.0
    if n_words and (top := int(mine.max())) >= min_repeat:
        # The longest repeat by characters among those that start at some word.
        total = np.concatenate([[0], np.cumsum(size)])
        starts = np.flatnonzero(mine >= min_repeat)
        part = int((total[starts + mine[starts]] - total[starts]).max()) / n_bytes
    else:
        top = 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
    return (n_words, len(text.translate(None, SPACE + CONTINUATION)),
            len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
            int(in_window[own].sum()), int(size[inside].sum()) / n_bytes if n_bytes else 0.0,
            part, top, edge.tolist())


def quality_rules(docs: DataFrame, text: str = "text", min_repeat: int = MIN_REPEAT,
                  max_covered: float = 0.3, max_longest: float = 0.25,
                  into: str = "quality") -> DataFrame:
    """`docs` with a struct column `into`, replacing one of that name.

    The struct holds the counts of the base rules, `covered` and `longest` (shares of the
    bytes in words), `longest_words`, `spans` (flat list of starts and ends, in words, of
    the union of repeats), `base_failed` and `kept`.
    """
    @F.arrow_udf(SCHEMA)
    def measured(column: pa.Array) -> pa.Array:
        worker_state("quality", dict)
        values = list(zip(*measure((x.as_py() for x in column.cast(pa.binary())), min_repeat)))
        values = values or [()] * len(FIELDS)
        return pa.StructArray.from_arrays(
            [pa.array(v, t) for v, (_, t) in zip(values, FIELDS)], [n for n, _ in FIELDS])

    ship(docs.sparkSession)
    raw = fresh(docs, "_quality")
    q = F.col(raw)
    failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_WORDS * q["n_words"])
    kept = ~failed & (q["covered"] <= max_covered) & (q["longest"] <= max_longest)
    fields = [q[n].alias(n) for n, _ in FIELDS]
    return docs.withColumn(raw, measured(F.col(text))).withColumn(
        into, F.struct(*fields, failed.alias("base_failed"), kept.alias("kept"))).drop(raw)
