"""Pattern packing by non-negative least squares.

Texts are encoded and end with the id `END`. Those longer than a sequence are cut; all of
their pieces but the first are full. A histogram of piece lengths, at most as many numbers
as a sequence has tokens, is all that the plan is made from:

1. Full pieces are sequences of their own. Patterns of two or three lengths that fill a
   sequence exactly are enumerated, and how often to use each is fitted to the histogram by
   non-negative least squares, where longer pieces weigh more, as they are harder to place.
2. Counts are rounded down, and lowered where patterns together ask for more pieces of a
   length than there are. Rests of at least one of the shares `ROUND_UP` are rounded up; the
   share that leads to the fewest sequences is taken.
3. Pieces that are left are packed best-fit-decreasing, by length and count: equal pieces go
   into equal sequences in one step, so the work depends on the lengths, not on the rows.

The plan is a list of patterns with repeat counts, hence ranges of ranks for each length. A
piece's rank among those of its length is its number within its task plus the number of
such pieces in earlier tasks, so no task sees more than its own input and the counts. All
lengths are hit exactly once; nothing is padded, dropped or cut beyond the above.

Null texts count as empty: one piece with `END` alone. Equal rows are packed each, and a null id
is an id like others. Very long texts are cut into pieces, none is dropped. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repeatwise.llm.tokens import encoder
from repeatwise.llm.work import ship, stored

CAPACITY, END = 1024, 2
ROUND_UP = (0.01, 0.25, 0.5, 0.75, 1.01)
END_IDS = np.array([END], "<u4").tobytes()


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of three lengths (the last may be 0) that are present and fill a sequence."""
    present = np.zeros(capacity + 1, bool)
    present[lengths] = True
    present[0] = True
    sizes = lengths[lengths < capacity]
    a, b = np.meshgrid(sizes, sizes, indexing="ij")
    c = capacity - a - b
    good = (a >= b) & (b >= c) & (c >= 0)
    a, b, c = a[good], b[good], c[good]
    good = present[c]
    return np.stack([a[good], b[good], c[good]], 1)


def fit(found: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that bring their lengths closest to the histogram.

    Accelerated projected gradient on the weighted squares; longer pieces weigh more.
    """
    if not len(found):
        return np.zeros(0)
    weight = np.arange(len(histogram), dtype=float) / (len(histogram) - 1)
    weight[0] = 0
    used = lambda x: sum(np.bincount(found[:, k], x, len(histogram)) for k in range(3))
    # Each pattern takes a step by what its own lengths are shared with.
    share = used(np.ones(len(found)))
    step = 1 / (np.maximum(share[found], 1) * weight[found]).sum(1)
    scale = 1 / 3
    x = np.zeros(len(found))
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        gradient = (weight * (used(y) - histogram))[found].sum(1)
        new = np.maximum(0, y - scale * step * gradient)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = np.maximum(0, new + (before - 1) / t * (new - x))
        x = new
    return x


def rounded(found: np.ndarray, x: np.ndarray, histogram: np.ndarray,
            up: float) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeat counts that never use more pieces than there are, largest counts first.

    Counts are rounded down, then patterns with a rest of at least `up` are used once more.
    The pieces used are taken out of `histogram`.
    """
    whole = np.floor(x + 1e-6)
    out: Counter = Counter()
    for wanted in (whole, (x - whole >= up) * 1):
        for i in np.argsort(-wanted, kind="stable"):
            if wanted[i] < 1:
                break
            need = Counter(int(v) for v in found[i] if v)
            n = min(int(wanted[i]), *(int(histogram[v]) // k for v, k in need.items()))
            if n:
                out[tuple(sorted(need.elements(), reverse=True))] += n
                for v, k in need.items():
                    histogram[v] -= n * k
    return list(out.items())


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit-decreasing on (length, count): equal pieces fill equal sequences at once."""
    groups: dict[int, list[list]] = defaultdict(list)  # by room: [pattern, count]
    rooms = np.zeros(capacity + 1, np.int64)
    for size in range(capacity, 0, -1):
        todo = int(histogram[size])
        while todo:
            fits = np.flatnonzero(rooms[size:])
            if not len(fits):
                per = capacity // size
                for k, n in ((per, todo // per), (todo % per, 1)):
                    if k and n:
                        groups[capacity - k * size].append([(size,) * k, n])
                        rooms[capacity - k * size] += 1
                break
            room = int(fits[0]) + size
            pattern, n = groups[room].pop()
            rooms[room] -= 1
            k = min(room // size, max(1, todo // n))
            take = min(n, todo // k)
            if take < n:
                groups[room].append([pattern, n - take])
                rooms[room] += 1
            groups[room - k * size].append([pattern + (size,) * k, take])
            rooms[room - k * size] += 1
            todo -= take * k
    return [(tuple(p), n) for own in groups.values() for p, n in own]


class Plan:
    """Where the piece of a length and a rank goes."""

    def __init__(self, histogram: np.ndarray, capacity: int) -> None:
        left = histogram.copy()
        left[capacity] = 0
        whole = [((capacity,), int(histogram[capacity]))] if histogram[capacity] else []
        lengths = np.flatnonzero(left)
        found = patterns(lengths, capacity)
        x, plans = fit(found, left), []
        for up in ROUND_UP:
            rest = left.copy()
            chosen = rounded(found, x, rest, up)
            plans.append(chosen + best_fit(rest, capacity))
        self.patterns = whole + min(plans, key=lambda plan: sum(n for _, n in plan))
        self.n_sequences = sum(n for _, n in self.patterns)
        ranges: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        taken, first = Counter(), 0
        for lengths_, n in self.patterns:
            offset = 0
            for size in lengths_:
                ranges[size].append((taken[size], first, offset))
                taken[size] += n
                offset += size
            first += n
        self.ranges = {k: np.array(v, np.int64) for k, v in ranges.items()}

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for size in np.unique(lengths):
            own = np.flatnonzero(lengths == size)
            starts, first, at = self.ranges[int(size)].T
            k = np.searchsorted(starts, ranks[own], "right") - 1
            sequence[own] = first[k] + ranks[own] - starts[k]
            offset[own] = at[k]
        return sequence, offset


def _pieces(path: str, capacity: int, with_ids: bool):
    """Function for mapInArrow: (id, text) to pieces, numbered for each length in the task.

    Their ids leave the Python worker only if they are wanted.
    """
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64(), *[pa.binary()] * with_ids]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number", *["ids"] * with_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = []
                for key, ids in zip(part.column(0).to_pylist(), encode.many(part.column(1).to_pylist())):
                    ids += END_IDS
                    total, start, piece = len(ids) // 4, 0, 0
                    while start < total:
                        size = (total - start - 1) % capacity + 1 if not piece else capacity
                        own = ids[4 * start:4 * (start + size)]
                        rows.append((key, piece, start, size, zlib.crc32(own), task, seen[size], own))
                        seen[size] += 1
                        start, piece = start + size, piece + 1
                columns = list(zip(*rows)) if rows else [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return cut


def pack_patterns(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id",
                  capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces (doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all rows.

    `key` is a column of integers. With `with_ids` the pieces carry their `ids` too, as
    little-endian unsigned 32-bit integers.
    """
    ship(docs.sparkSession)
    slim = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    cut = slim.mapInArrow(
        _pieces(tokenizer, capacity, with_ids), "doc_id long, piece int, start long, length long, ids_crc32 long, "
        "task int, number long" + ", ids binary" * with_ids)
    pieces = stored(cut, "pieces")
    counts = stored(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        histogram[row["length"]] = row["n"]
    plan = docs.sparkSession.sparkContext.broadcast(Plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def placed(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        values = plan.value.place(lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(v) for v in values], ["sequence_id", "offset"])

    out = pieces.join(bases, ["task", "length"]).withColumn("at", placed("length", F.col("base") + F.col("number")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset",
                      *(["ids"] if with_ids else []))
