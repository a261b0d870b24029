"""Fill-in-the-middle documents, cut at unit ends found eight bytes at a time.

A unit is white space with the visible characters behind it, or white space at the end of a
text (`UNIT`). In UTF-8 all white space of a unit is one byte long and no byte of a longer
character looks like it, so unit ends can be read off the bytes. All texts of an Arrow batch
are viewed as one array of 64-bit words. Additions that can't carry from byte to byte mark
the white space of each word; a visible byte before a marked one, and the last byte of every
text, ends a unit. `bitwise_count` of the marks and their running sum give the number of
units before any place; the place of the k-th end is the word found in the running sum, and in it
the one that remains when lower marks are taken away one by one. The same sums over the first
bytes of characters turn places into code points. No loop runs over texts, units or bytes.

Two cuts make prefix, middle and suffix, and hashes of the id choose them and the form.

Results in special cases: a null or empty text has no units, the form `plain` and itself, or
the empty text, as output; so does a text that holds a sentinel, with its units counted. A
null id takes part as if it were the empty text. White space alone is one unit. Texts of any length are taken whole. Repeated rows are
handled row by row and get the same result if id and text are equal; there are no ties. An
empty table gives an empty table. A column that has the name of the result is replaced, other columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repeatwise.llm.work import fresh, ship

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Of 100 documents, those transformed, and of 100 transformed ones, those with the suffix first.
RATE, SPM_RATE = 50, 80

ONES = np.uint64(0x0101010101010101)
HIGH = np.uint64(0x8080808080808080)
LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
ONE, SEVEN, EIGHT, TOP = (np.uint64(x) for x in (1, 7, 8, 56))


def _at_least(low: np.ndarray, value: int) -> np.ndarray:
    """The high bit of every byte of at least `value`; bytes of `low` are below 128, so none carries."""
    return low + ONES * np.uint64(128 - value)


def blanks(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is white space: 9 to 13, or 32."""
    low = words & LOW
    control = _at_least(low, 9) & ~_at_least(low, 14)
    space = _at_least(low, 32) & ~_at_least(low, 33)
    return (control | space) & ~words & HIGH


def first_bytes(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that begins a character: all but 0b10xxxxxx."""
    return (~words | words << ONE) & HIGH


class Marks:
    """Marked bytes of an array of words: how many lie before a place, and where the k-th is."""

    def __init__(self, marks: np.ndarray) -> None:
        self.marks = marks
        self.before = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(np.bitwise_count(marks), out=self.before[1:])

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Number of marks in the bytes before `place`."""
        word, byte = place >> 3, (place & 7).astype(np.uint64)
        inside = self.marks[word] & ((ONE << (byte * EIGHT)) - ONE)
        return self.before[word] + np.bitwise_count(inside)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte of mark number `k`, counted from 0."""
        word = np.searchsorted(self.before, k, side="right") - 1
        left, value = k - self.before[word], self.marks[word]
        for gone in range(7):  # a word has at most eight marks
            value = np.where(left > gone, value & (value - ONE), value)
        lowest = value & (~value + ONE)
        return (word << 3) + (np.bitwise_count(lowest - ONE) >> 3).astype(np.int64)


def cut(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, and code points of its prefix and middle.

    The prefix holds the smaller of `first` and `second` modulo units + 1, and the middle
    reaches to the larger.
    """
    texts = texts.fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    count, wide = len(texts), pa.types.is_large_string(texts.type)
    if not count:
        return (np.zeros(0, np.int64),) * 3
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, "<i8" if wide else "<i4")[texts.offset:texts.offset + count + 1].astype(np.int64)
    base, size = ends[0], int(ends[-1] - ends[0])
    # One word more than the bytes need, so that the place behind the last byte has a word.
    words = np.zeros(size // 8 + 1, "<u8")
    if size:
        words.view(np.uint8)[:size] = np.frombuffer(data, np.uint8)[base:base + size]
    start, end = ends[:-1] - base, ends[1:] - base

    white = blanks(words)
    following = white >> EIGHT
    following[:-1] |= white[1:] << TOP
    unit = following & ~white & HIGH
    last = end[end > start] - 1
    # Several texts may end in one word.
    np.bitwise_or.at(unit, last >> 3, ONE << ((last & 7).astype(np.uint64) * EIGHT + SEVEN))
    units = Marks(unit)
    before = units.rank(start)
    n = units.rank(end) - before

    one, two = first % (n + 1), second % (n + 1)
    characters = Marks(first_bytes(words))
    places = []
    for k in (np.minimum(one, two), np.maximum(one, two)):
        place = start.copy()
        some = k > 0
        place[some] = units.select(before[some] + k[some] - 1) + 1
        places.append(characters.rank(place))
    return n, places[0] - characters.rank(start), places[1] - places[0]


def _number(digest: Column, group: int) -> Column:
    """Group `group` of eight hexadecimal digits, from 1, as an unsigned number."""
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int, text: str = "text", key: str = "doc_id", into: str = "fim",
                   rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """`docs` with a struct `into`: n, form, prefix_chars, middle_chars and the output.

    Everything but finding the cuts is left to Spark: cutting by characters, joining with
    the sentinels, and the hashes of `seed` and `key`.
    """
    ship(docs.sparkSession)

    @F.arrow_udf("struct<n: long, prefix_chars: long, middle_chars: long>")
    def cuts(column: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        found = cut(column, first.to_numpy(zero_copy_only=False), second.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found],
                                          ["n", "prefix_chars", "middle_chars"])

    digest, place, whole = (fresh(docs, x) for x in ("_digest", "_cuts", "_whole"))
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    out = docs.withColumns({digest: F.sha2(F.concat(F.lit(f"{seed}:"), name), 256),
                            whole: F.coalesce(F.col(text), F.lit(""))})
    out = out.withColumn(place, cuts(F.col(whole), _number(F.col(digest), 1), _number(F.col(digest), 2)))
    content, a, b = F.col(whole), F.col(place)["prefix_chars"], F.col(place)["middle_chars"]
    plain = (content == "") | (_number(F.col(digest), 3) % 100 >= rate)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | content.contains(sentinel)
    form = F.when(plain, PLAIN).when(_number(F.col(digest), 4) % 100 < spm_rate, SPM).otherwise(PSM)
    out = out.withColumn(digest, form)
    form = F.col(digest)
    prefix, middle = F.substring(content, F.lit(1), a.cast("int")), F.substring(content, (a + 1).cast("int"), b.cast("int"))
    suffix = F.substring(content, (a + b + 1).cast("int"), F.length(content))
    output = F.when(form == PLAIN, content) \
        .when(form == SPM, F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)) \
        .otherwise(F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    made = F.struct(F.col(place)["n"].alias("n"), form.alias("form"), F.when(form != PLAIN, a).alias("prefix_chars"),
                    F.when(form != PLAIN, b).alias("middle_chars"), output.alias("output"))
    return out.withColumn(into, made).drop(*({digest, place, whole} - {into}))


def restored(form: Column, output: Column) -> Column:
    """The text that an output of this form was made of.

    No sentinel occurs in a transformed text, nor can one arise where a part meets a
    sentinel, as `<` is only ever its first character.
    """
    first, second = F.when(form == SPM, SUFFIX).otherwise(PREFIX), F.when(form == SPM, PREFIX).otherwise(SUFFIX)
    middle = F.substring_index(output, MIDDLE, -1)
    front = F.substring_index(output, MIDDLE, 1)
    parts = F.split(F.replace(front, first, F.lit("")), F.concat(F.lit(r"\Q"), second, F.lit(r"\E")), F.lit(-1))
    return F.when(form == PLAIN, output).when(form == SPM, F.concat(parts[1], middle, parts[0])) \
        .otherwise(F.concat(parts[0], middle, parts[1]))


#: DuckDB: the same over table `docs` (doc_id, text), with the seed and both rates.
SQL = r"""
cut AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM {docs}),
placed AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                   OR ('0x' || h[17:24])::BIGINT % 100 >= {rate} THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < {spm_rate} THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
         array_to_string(u[greatest(a, b) + 1:], '') AS s
  FROM placed),
fim AS (
  SELECT doc_id, n, form, t, p, m, s, CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
         ELSE '<P>' || p || '<S>' || s || '<M>' || m END AS output
  FROM parts)"""
