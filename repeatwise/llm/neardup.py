"""Near duplicates by a chosen-path set similarity join.

A text's set holds the hashes of its distinct five-word shingles, in lower case. Texts with
equal sets are one record from the start; records never expand into pairs of copies. A
record has `SIGNATURE` minwise tokens, of which two records share each with a probability
equal to their Jaccard similarity.

Trees: at each node of each of `trees` independent trees, a hash of the node's path selects
some of the signature's positions, `1 / branching` of them on average, and a record goes to
one child for each selected position, named by its token there. Records that are similar
select the same children together; others part after one or two tokens. Nodes with at most
`leaf` records end, and so do dense nodes, whose records agree in `DENSE` of positions with
one of them on average; other nodes are branched again, up to `depth`.

Small nodes are compared exhaustively. First every record is compared with the smallest
record of its nodes only, which joins most copies. Then pairs of a node that are still in
different components and whose sketches (a byte for each token) agree in at least
`sketch_share` of positions, `DEVIATIONS` standard deviations below what the threshold leads
one to expect, are gathered and confirmed on full sets, computed again from the texts of these records.

Dense nodes hold many similar texts that differ, such as thousands of near copies. Their
full sets meet in blocks of bounded size, and the exact sizes of all intersections of two
blocks come from a product of their incidence matrices. Only a spanning forest of the links
between different components leaves the task, at most a row for each record; the pairs of a
group are never written out, none is left out by a cap, and no task holds a group.

Results: every row gets the size of its set, the smallest id of its component, and whether
that is itself. Texts without words, or null, have an empty set and link with nothing. A row
with a null id has a null component and null size and is kept. Rows with one id count as one
document, whose copies stay or go together. Equal texts share a component. Texts of any length are
taken whole. An empty table gives an empty table; columns of the results' names are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatwise.llm.graph import components
from repeatwise.llm.work import fresh, ship, stored, worker_state

SHINGLE = 5
SIGNATURE = 64
DEVIATIONS = 4.25
#: Children that a pair at the threshold is expected to share at each node of a tree.
SHARED = 0.85 / 0.7
DENSE = 0.4
#: Records, and bytes of their sets, on one side of a comparison of blocks.
BLOCK, BLOCK_BYTES = 1024, 4 << 20
#: Shingles that one product of incidence matrices takes.
COLUMNS = 4096
_MASK = (1 << 64) - 1


def sketch_share(threshold: int) -> float:
    share = threshold / 100
    return share - DEVIATIONS * (share * (1 - share) / SIGNATURE) ** 0.5


def branching_of(threshold: int) -> float:
    return threshold / 100 / SHARED


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit integers that looks random (finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = mix(np.arange(1, 4 * SIGNATURE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS, _SHIFTS = _SEEDS[:SIGNATURE] | np.uint64(1), _SEEDS[SIGNATURE:2 * SIGNATURE]
_POSITIONS = _SEEDS[2 * SIGNATURE:3 * SIGNATURE]
_ORDER = _SEEDS[3 * SIGNATURE:3 * SIGNATURE + SHINGLE] | np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the text's five-word shingles; of all words if fewer."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(SHINGLE, len(h))
    total = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        total += mix(h[k:len(h) - width + 1 + k] ^ _SHIFTS[k]) * _ORDER[k]
    return np.unique(mix(total))


def signature(shingled: np.ndarray) -> bytes:
    least = np.full(SIGNATURE, _MASK, np.uint64)
    for at in range(0, len(shingled), 4096):
        part = shingled[at:at + 4096, None] * _FACTORS + _SHIFTS
        np.minimum(least, part.min(0), out=least)
    return (mix(least) >> np.uint64(32)).astype("<u4").tobytes()


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_state("near duplicates", dict)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            n, keys, signatures = [], [], []
            for text in part.column(1).cast(pa.binary()).to_pylist():
                own = shingles(text)
                n.append(len(own))
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                signatures.append(signature(own) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(signatures, pa.binary())], ["id", "n", "key", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([shingles(t).tobytes() for t in part.column(1).cast(pa.binary()).to_pylist()],
                                          pa.binary())], ["r", "items"])


def _matrix(column: pa.Array, kind: str = "<u4") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), SIGNATURE)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(r, sig) to (r, sketch): the low byte of each token."""
    for batch in batches:
        low = _matrix(batch.column(1)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([x.tobytes() for x in low], pa.binary())], ["r", "sketch"])


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, sig, sig of the node's centre) to (path, share)."""
    for batch in batches:
        if batch.num_rows:
            same = (_matrix(batch.column(1)) == _matrix(batch.column(2))).mean(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same)], ["path", "share"])


def _branch(share: float):
    """Function for mapInArrow: (id, path, sig) to (id, path) of the children."""
    limit = np.uint64(int(share / SIGNATURE * 2.0 ** 64))

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                paths = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                tokens = _matrix(part.column(2)).astype(np.uint64)
                row, position = np.nonzero(mix(paths[:, None] ^ _POSITIONS) < limit)
                named = mix(paths[row] * np.uint64(0x9E3779B97F4A7C15) + _POSITIONS[position])
                child = mix(named ^ mix(tokens[row, position] + np.uint64(1)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row], pa.int64()), pa.array(child.view(np.int64))], ["r", "path"])

    return children


def _agree(threshold: int):
    """Function for mapInArrow: (a, b, sketch_a, sketch_b) to the pairs (a, b) whose sketches agree enough."""
    least = sketch_share(threshold)

    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (_matrix(batch.column(2), "u1") == _matrix(batch.column(3), "u1")).mean(1)
                keep = pa.array(same >= least)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return agreeing


def _small(threshold: int):
    """Function for mapInArrow: (records, components, sketches) of small nodes to their pairs across components."""
    least = sketch_share(threshold)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, sketches in zip(*(c.to_pylist() for c in batch.columns)):
                ids, labels = np.array(ids, np.int64), np.array(labels, np.int64)
                x = np.frombuffer(b"".join(sketches), "u1").reshape(-1, SIGNATURE)
                i, j = np.nonzero((labels[:, None] != labels) & (ids[:, None] < ids))
                keep = (x[i] == x[j]).mean(1) >= least
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i[keep]]), pa.array(ids[j[keep]])], ["a", "b"])

    return pairs


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right."""
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    both = np.zeros((len(left), len(right)), np.float32)
    sides = []
    for sets in (left, right):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        items = np.concatenate(sets)
        at = np.minimum(np.searchsorted(common, items), max(len(common) - 1, 0))
        known = common[at] == items if len(common) else np.zeros(len(items), bool)
        order = np.argsort(at[known], kind="stable")
        sides.append((row[known][order], at[known][order], len(sets)))
    for start in range(0, len(common), COLUMNS):
        parts = []
        for row, at, n in sides:
            a, b = np.searchsorted(at, [start, start + COLUMNS])
            part = np.zeros((n, min(COLUMNS, len(common) - start)), np.float32)
            part[row[a:b], at[a:b] - start] = 1
            parts.append(part)
        both += parts[0] @ parts[1].T
    return both.astype(np.int64)


def _dense(threshold: int):
    """Function for mapInArrow: (records, components, sets) of two blocks to linking pairs."""
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels, items, ids2, labels2, items2 = (c[row].as_py() for c in batch.columns)
                if len({*labels, *labels2}) == 1:
                    continue
                left, right = ([np.frombuffer(x, np.uint64) for x in s] for s in (items, items2))
                both = intersections(left, right)
                sizes = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])
                i, j = np.nonzero((100 * both >= threshold * (sizes - both))
                                  & (np.array(labels)[:, None] != np.array(labels2)))
                # A spanning forest over components says as much as all these links.
                root = {x: x for x in (*labels, *labels2)}
                found = []
                for p, q in zip(i.tolist(), j.tolist()):
                    x, y = labels[p], labels2[q]
                    while root[x] != x:
                        root[x] = x = root[root[x]]
                    while root[y] != y:
                        root[y] = y = root[root[y]]
                    if x != y:
                        root[x] = y
                        found.append((ids[p], ids2[q]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return linked


def _confirm(threshold: int):
    """Function for mapInArrow: (a, b, items_a, items_b) to the linked pairs."""
    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= threshold * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return confirmed


def _full_sets(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """(r, items) of the records `wanted` (r); `texts` (r, text) holds the text of each record."""
    # Other texts are left out before shingles are computed.
    sets = texts.join(wanted, "r", "left_semi").select("r", "text").mapInArrow(_sets, "r long, items binary")
    return stored(sets.groupBy("r").agg(F.max("items").alias("items")), "sets")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of records that are linked, by their full sets."""
    pairs = stored(pairs.distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("r")).union(pairs.select(F.col("b").alias("r"))).distinct()
    sets = _full_sets(wanted, texts)
    right = sets.select(F.col("r").alias("b"), F.col("items").alias("items_b"))
    left = sets.select(F.col("r").alias("a"), F.col("items").alias("items_a"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "items_a", "items_b")
    return stored(both.mapInArrow(_confirm(threshold), "a long, b long"), "links")


def _grown(records: DataFrame, trees: int, branching: float, leaf: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """(path, r, n) of the nodes with 2 to `leaf` records, and of those that end with more."""
    roots = F.explode(F.transform(F.sequence(F.lit(1), F.lit(trees)), lambda t: F.xxhash64(t, F.lit("tree"))))
    open_ = records.select("r", roots.alias("path"), "sig")
    small, large = [], []
    for level in range(1, depth + 1):
        rows = stored(open_.mapInArrow(_branch(1 / branching), "r long, path long"), f"level{level}")
        sizes = rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        # Paths with a single record, nearly all of them, end here.
        nodes = stored(rows.join(sizes, "path").select("path", "r", "n"), f"nodes{level}")
        small.append(nodes.where(F.col("n") <= leaf))
        more = nodes.where(F.col("n") > leaf)
        if level == depth:
            large.append(more)
        if level == depth or more.isEmpty():
            break
        signed = stored(more.join(records.select("r", "sig"), "r"), f"open{level}")
        centre = signed.groupBy("path").agg(F.min_by("sig", F.xxhash64("r")).alias("centre"))
        dense = stored(signed.join(centre, "path").select("path", "sig", "centre")
                       .mapInArrow(_agreement, "path long, share double").groupBy("path")
                       .agg(F.avg("share").alias("share")).where(F.col("share") >= DENSE).select("path"), "dense")
        large.append(more.join(dense, "path", "left_semi"))
        open_ = signed.join(dense, "path", "left_anti").select("r", "path", "sig")
    return tuple(stored(reduce(DataFrame.union, x), name) if x else x
                 for x, name in ((small, "small"), (large or [more], "large")))


def _to_smallest(nodes: DataFrame, sketches: DataFrame, threshold: int) -> DataFrame:
    """For each record the smallest record of its nodes that its sketch agrees with, as (a, b)."""
    least = nodes.groupBy("path").agg(F.min("r").alias("a"))
    pairs = nodes.join(least, "path").where("a < r").select("a", F.col("r").alias("b")).distinct()
    with_b = pairs.join(sketches.select(F.col("r").alias("b"), F.col("sketch").alias("sketch_b")), "b")
    signed = with_b.join(sketches.select(F.col("r").alias("a"), F.col("sketch").alias("sketch_a")), "a") \
        .select("a", "b", "sketch_a", "sketch_b")
    return signed.mapInArrow(_agree(threshold), "a long, b long").groupBy("b").agg(F.min("a").alias("a")) \
        .select("a", "b")


def _apart(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(path, r, n, c) of the nodes that hold more than one component c."""
    rows = nodes.join(labels.select(F.col("node").alias("r"), "component"), "r", "left") \
        .select("path", "r", "n", F.coalesce("component", "r").alias("c"))
    spread = rows.groupBy("path").agg(F.min("c").alias("c0"), F.max("c").alias("c1")) \
        .where("c0 <> c1").select("path")
    return rows.join(spread, "path")


def _across_small(nodes: DataFrame, labels: DataFrame, sketches: DataFrame, threshold: int) -> DataFrame:
    """Candidate pairs (a, b) across components of small nodes."""
    rows = _apart(nodes, labels).join(sketches, "r").groupBy("path").agg(
        F.collect_list(F.struct("r", "c", "sketch")).alias("x"))
    return rows.select("x.r", "x.c", "x.sketch").mapInArrow(_small(threshold), "a long, b long")


def _across_large(nodes: DataFrame, labels: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) that join all components of large nodes that have links between them."""
    rows = _apart(nodes, labels)
    rows = stored(rows.join(_full_sets(rows.select("r").distinct(), texts), "r"), "large-sets")
    k = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.octet_length("items")) / BLOCK_BYTES)).cast("int")
    counts = rows.groupBy("path").agg(k.alias("k"))
    block = rows.join(counts, "path") \
        .withColumn("own", F.pmod(F.xxhash64("r"), F.col("k")).cast("int")) \
        .groupBy("path", "k", "own").agg(F.collect_list(F.struct("r", "c", "items")).alias("x"))
    # A block meets the blocks from its own on; a node of one block meets itself.
    left = block.select("path", F.explode(F.sequence(F.col("own"), F.col("k") - 1)).alias("own"), "x")
    right = block.select("path", "own", F.col("x").alias("y"))
    met = left.join(right, ["path", "own"]).select(
        F.col("x.r"), F.col("x.c"), F.col("x.items"), F.col("y.r").alias("r2"), F.col("y.c").alias("c2"),
        F.col("y.items").alias("items2"))
    return stored(met.mapInArrow(_dense(threshold), "a long, b long").distinct(), "links")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id",
                    threshold: int = 85, trees: int = 12, branching: float | None = None,
                    leaf: int = 32, depth: int = 8, n_shingles: str = "n_shingles",
                    component: str = "component_id", kept: str = "kept") -> DataFrame:
    """`docs` with the columns `n_shingles`, `component` and `kept`, replacing such.

    `key` is a column of integers. Texts are linked at `threshold` per cent of Jaccard
    similarity or more; branching follows from the threshold unless given.
    """
    branching = branching_of(threshold) if branching is None else branching
    ship(docs.sparkSession)
    slim = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    mapped = stored(slim.mapInArrow(_records, "id long, n long, key binary, sig binary"), "sets")
    # One record for each different set, named by its smallest id.
    records = stored(mapped.where("id IS NOT NULL AND key IS NOT NULL").groupBy("key")
                     .agg(F.min("id").alias("r"), F.max("sig").alias("sig")), "records")
    texts = slim.where("id IS NOT NULL").withColumnRenamed("id", "r")
    sketches = stored(records.select("r", "sig").mapInArrow(_sketch, "r long, sketch binary"), "sketches")
    small, large = _grown(records, trees, branching, leaf, depth)
    first = _verified(_to_smallest(small.union(large), sketches, threshold), texts, threshold)
    labels = components(first)
    second = _verified(_across_small(small, labels, sketches, threshold), texts, threshold)
    third = _across_large(large, components(first.union(second)), texts, threshold)
    labels = components(first.union(second).union(third))

    of_set = records.join(labels, F.col("r") == F.col("node"), "left") \
        .select(F.col("key"), F.coalesce("component", "r").alias("c"))
    own, n, c = (fresh(docs, x) for x in ("_id", "_n", "_c"))
    found = mapped.where("id IS NOT NULL").join(of_set, "key", "left") \
        .groupBy(F.col("id").alias(own)).agg(F.max("n").alias(n), F.min(F.coalesce("c", "id")).alias(c))
    joined = docs.join(found, F.col(key).cast("long") == F.col(own), "left")
    values = {n_shingles: F.col(n), component: F.col(c),
              kept: F.coalesce(F.col(own) == F.col(c), F.lit(True))}
    return joined.select(*(x for x in docs.columns if x not in values),
                         *(v.alias(k) for k, v in values.items()))
