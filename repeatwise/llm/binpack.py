"""Packed training rows by best-fit-decreasing, written as id matrices.

Texts are encoded and end with the id `END`. Those longer than a row are cut into full
pieces and a rest; joined in order, the pieces give the ids back. A block of texts, up to
`block` pieces of one task, is packed longest piece first into the open row with the least
room that still fits. A segment tree over the amounts of room, which knows for each stretch
of amounts whether any row has one, finds that row in logarithmic time.

Each packed row holds its `ids`, padded with `pad` to the full length, the cumulative
segment lengths `cu_seqlens` (from 0 to the number of used tokens), and `positions`, which
start from 0 again at each segment. Both are little-endian, with 16 bits, or 32 if `wide` or a row
is that long; a vocabulary whose ids don't fit is an error. `doc_ids`, `pieces` and `starts` say where
segments are from.

Blocks are independent, so memory is bounded by a block, and a lost executor costs a block's
task. The rows a block fills only in part are a small share, as the short pieces come last.
Null texts count as empty: a segment with `END` alone. Equal rows are packed each, and an empty table
gives no rows. Best fit holds within a block, so each block may leave a row or two partly filled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatwise.llm.tokens import encoder
from repeatwise.llm.work import ship

CAPACITY, END, PAD = 2048, 2, 50256
BLOCK = 4096
SCHEMA = ("block string, row int, n_tokens int, n_segments int, ids binary, positions binary, "
          "cu_seqlens array<int>, doc_ids array<long>, pieces array<int>, starts array<long>")


class Rooms:
    """Open rows by room, under a segment tree that finds the least room of at least a size."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.leaves)
        self.rows: dict[int, list[int]] = defaultdict(list)

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = room + self.leaves
        while node and not self.tree[node]:
            self.tree[node] = 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """A row with the least room of at least `size`, and its room."""
        node = size + self.leaves
        if not self.tree[node]:
            # Up until a right sibling holds larger rooms, then down to its least.
            while node > 1 and (node & 1 or not self.tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node + (not self.tree[2 * node])
        room = node - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            while node:
                self.tree[node] = 0
                node >>= 1
                if self.tree[2 * node] or self.tree[2 * node + 1]:
                    break
        return row, room


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of the pieces in each row."""
    rooms, rows = Rooms(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = rooms.take(sizes[i])
        if found is None:
            rows.append([])
            found = len(rows) - 1, capacity
        row, room = found
        rows[row].append(i)
        if room > sizes[i]:
            rooms.add(room - sizes[i], row)
    return rows


def _packed(path: str, capacity: int, block: int, wide: bool):
    kind = "<u4" if wide or capacity > 1 << 16 else "<u2"
    end = np.array([END], "<u4").tobytes()

    def pack(name: str, pieces: list[tuple]) -> pa.RecordBatch:
        rows = []
        for number, own in enumerate(best_fit_decreasing([len(p[3]) for p in pieces], capacity)):
            chosen = [pieces[i] for i in own]
            lengths = [len(p[3]) for p in chosen]
            ids = np.full(capacity, PAD, kind)
            positions = np.zeros(capacity, kind)
            used = sum(lengths)
            ids[:used] = np.concatenate([p[3] for p in chosen])
            positions[:used] = np.concatenate([np.arange(n) for n in lengths])
            rows.append((name, number, used, len(own), ids.tobytes(), positions.tobytes(),
                         [0, *np.cumsum(lengths).tolist()], [p[0] for p in chosen],
                         [p[1] for p in chosen], [p[2] for p in chosen]))
        columns = list(zip(*rows)) if rows else [()] * 10
        types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(),
                 pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, blocks, pieces = encoder(path), TaskContext.get().partitionId(), 0, []
        if kind == "<u2" and encode.vocabulary > 1 << 16:
            raise ValueError(f"ids of {path} don't fit into 16 bits: use wide=True")
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                for key, raw in zip(part.column(0).to_pylist(), encode.many(part.column(1).to_pylist())):
                    ids = np.frombuffer(raw + end, "<u4").astype(kind)
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        pieces.append((key, k, start, ids[start:start + capacity]))
                        if len(pieces) == block:
                            yield pack(f"{task}-{blocks}", pieces)
                            blocks, pieces = blocks + 1, []
        if pieces:
            yield pack(f"{task}-{blocks}", pieces)

    return packed


def packed_rows(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id",
                capacity: int = CAPACITY, block: int = BLOCK, wide: bool = False) -> DataFrame:
    """The packed rows of all texts, with the columns of `SCHEMA`; `key` is a column of integers."""
    ship(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")) \
        .mapInArrow(_packed(tokenizer, capacity, block, wide), SCHEMA)


def write_packed(rows: DataFrame, path: str) -> None:
    """Writes packed rows as Parquet: a file's `ids` and `positions`, joined, are its matrices."""
    rows.write.option("compression", "zstd").mode("errorifexists").parquet(path)
