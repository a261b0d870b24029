"""Centroid clustering in exact integers, on bit planes of 64 components.

Components are whole numbers. A vector is stored as bit planes: plane b is one 64-bit word
with bit b of each of its 64 components, in two's complement, so the last plane counts
negatively and repeating it changes nothing. The dot product of two vectors is then the sum over
pairs of planes of 2 ** (i + j) times the number of bits in both, which `bitwise_count` of their AND
gives for all vectors of a batch and all centroids; pairs of the same i + j are added up
before they are weighed. Squared distances follow as |x|^2 + |c|^2 - 2 x c. Sums over a
cluster come from the planes as well: the number of set bits by plane and component.

Planes are written once to the shared folder, read in every round and removed in the end. A round is one pass: a
task assigns its vectors and returns at most one row of sums and counts for each cluster, and Spark adds
them up, so a cluster with most of the vectors costs no more than any other. Only the centroids,
k times 64 numbers, pass through the driver, and with them a table of k totals in the end.

Results in special cases: vectors that are null, of another length, or hold a null, NaN or
infinite component aren't kept and give no row. A null id takes part, and comes last when the first
centroids are chosen. Repeated rows count as often as they occur; of equal hashes the smaller id, then
the smaller vector comes first. Ties between centroids go to the smaller number. With fewer vectors
than k there are as many centroids as vectors. A component beyond 2 ** 27 in either direction after
scaling is an error, as distances would no longer fit a long. An empty table gives an empty
table. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repeatwise.llm.work import Scratch, ship, stored

DIM = 64
LIMIT = 1 << 27
#: Vectors compared with all centroids at a time: their counts stay in a processor's cache.
BLOCK = 1024


def to_planes(vectors: np.ndarray) -> np.ndarray:
    """Bit planes (n, bits) of whole numbers (n, 64), with as many planes as the largest needs."""
    bits = 1 + max((int(x).bit_length() for x in (vectors.max(initial=0), ~vectors.min(initial=0))), default=0)
    shifts = np.arange(bits)[None, :, None]
    return np.packbits((vectors[:, None, :] >> shifts & 1).astype(np.uint8), axis=2, bitorder="little") \
        .view("<u8")[:, :, 0]


def _signs(bits: int) -> np.ndarray:
    return np.where(np.arange(bits) == bits - 1, -1, 1)


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Dot products (n, k) of the vectors with planes `x` (n, bits) and `c` (k, bits)."""
    n, k, xs, cs = len(x), len(c), x.shape[1], c.shape[1]
    x, c = np.ascontiguousarray(x.T)[:, :, None], np.ascontiguousarray(c.T)[:, None, :]
    total = np.zeros((n, k), np.int64)
    both = np.empty((n, k), np.uint64)
    # One sum for each weight: at most 64 * 28 bits either way, so 16 bits hold it.
    for power in range(xs + cs - 1):
        count = np.zeros((n, k), np.int16)
        for i in range(max(0, power - cs + 1), min(xs, power + 1)):
            np.bitwise_and(x[i], c[power - i], out=both)
            bits = np.bitwise_count(both)
            if (i == xs - 1) != (power - i == cs - 1):
                count -= bits
            else:
                count += bits
        total += count.astype(np.int64) << power
    return total


def squares(planes: np.ndarray) -> np.ndarray:
    """Squared lengths of vectors."""
    out = np.zeros(len(planes), np.int64)
    signs = _signs(planes.shape[1])
    for i in range(planes.shape[1]):
        for j in range(i + 1):
            weight = int(signs[i] * signs[j]) << (i + j + (i != j))
            out += np.bitwise_count(planes[:, i] & planes[:, j]).astype(np.int64) * weight
    return out


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and squared distance to it; ties go to the smaller number."""
    cluster, distance = np.zeros(len(planes), np.int32), np.zeros(len(planes), np.int64)
    lengths = squares(centroids)
    for at in range(0, len(planes), BLOCK):
        block = planes[at:at + BLOCK]
        rest = lengths - 2 * dots(block, centroids)
        best = rest.argmin(axis=1)
        cluster[at:at + BLOCK] = best
        distance[at:at + BLOCK] = squares(block) + rest[np.arange(len(block)), best]
    return cluster, distance


def sums(planes: np.ndarray, cluster: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of vectors, and sum of each component, by cluster."""
    counts, total = np.bincount(cluster, minlength=k), np.zeros((k, DIM), np.int64)
    weights = _signs(planes.shape[1]) << np.arange(planes.shape[1])
    order = np.argsort(cluster, kind="stable")
    ends = np.cumsum(counts)
    for c in np.flatnonzero(counts):
        own = planes[order[ends[c] - counts[c]:ends[c]]]
        for plane, weight in zip(np.ascontiguousarray(own.T), weights):
            bits = np.unpackbits(plane.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total[c] += bits.sum(axis=0, dtype=np.int64) * weight
    return counts, total


def _read(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Planes of a column of binaries, and the rows they belong to, by number of planes."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        raw = b"".join(column.take(pa.array(rows)).to_pylist())
        yield rows, np.frombuffer(raw, "<u8").reshape(len(rows), -1)


def kept_vectors(vectors: DataFrame, key: str, embedding: str, scale: int) -> DataFrame:
    """`key` and `whole`, the scaled components rounded down, of vectors that are usable."""
    v = F.col(embedding)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    fits = F.forall(v, lambda x: F.abs(x.cast("double") * scale) <= LIMIT)
    error = F.raise_error(F.lit(f"a component beyond {LIMIT} after scaling")).cast("array<bigint>")
    usable = F.coalesce((F.size(v) == DIM) & finite, F.lit(False))
    return vectors.where(usable).select(F.col(key).alias("key"), F.when(fits, whole).otherwise(error).alias("whole"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = batch.column("whole").flatten().to_numpy().reshape(batch.num_rows, DIM)
        planes = to_planes(whole)
        size = planes.shape[1] * 8
        raw = planes.astype("<u8").tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array([raw[i:i + size] for i in range(0, len(raw), size)], pa.binary())],
            ["key", "planes"])


def _first_centroids(kept: DataFrame, k: int, seed: int) -> list[list[int]]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    rows = kept.select(digest.alias("digest"), "key", "whole") \
        .orderBy(F.col("digest").asc_nulls_last(), "key", "whole").limit(k).collect()
    return [r["whole"] for r in rows]


def _moved(planes: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after a round: each the mean of its vectors, rounded down, if it has any."""
    k, wire = len(centroids), np.array(centroids, np.int64)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts, total = to_planes(wire), np.zeros(k, np.int64), np.zeros((k, DIM), np.int64)
        for batch in batches:
            for _, some in _read(batch.column("planes")):
                cluster, _ = nearest(some, own)
                more, added = sums(some, cluster, k)
                counts += more
                total += added
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(counts[used], pa.int64()),
             pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = planes.select("planes").mapInArrow(partial, "cluster int, n long, total array<long>")
    # Decimals: sums over any number of vectors are exact.
    added = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(DIM)]
    out = [list(c) for c in centroids]
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *added).collect():
        out[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(DIM)]
    return out


def _at_number(values: list, kind: str) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in values)), F.col("cluster") + 1).cast(kind)


def clustered(vectors: DataFrame, k: int, rounds: int, seed: int, scale: int, key: str = "vec_id",
              embedding: str = "embedding") -> DataFrame:
    """One row for each kept vector: its cluster, distance, inertias and its centroid's digest.

    Components are multiplied by `scale`, a power of two, and rounded down. Centroids start as
    the k vectors with the least SHA-256 of `seed`:id.
    """
    ship(vectors.sparkSession)
    scratch = Scratch(vectors.sparkSession)
    kept = kept_vectors(vectors, key, embedding, scale)
    kind = kept.schema["key"].dataType
    centroids = _first_centroids(kept, k, seed)
    planes = scratch.stored(kept.mapInArrow(_packed, f"key {kind.simpleString()}, planes binary"), "planes")
    if centroids:
        for _ in range(rounds):
            centroids = _moved(planes, centroids)
    wire = np.array(centroids, np.int64).reshape(-1, DIM)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = to_planes(wire)
        for batch in batches:
            for rows, some in _read(batch.column("planes")):
                cluster, distance = nearest(some, own)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(rows)), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())],
                    ["key", "cluster", "distance"])

    assigned = planes.mapInArrow(assign, f"key {kind.simpleString()}, cluster int, distance long")
    if not centroids:
        return assigned.select(F.col("key").alias(key), "cluster", "distance", F.col("distance").alias("cluster_inertia"),
                               F.col("distance").alias("inertia"), F.lit("").alias("centroid_sha256"))
    assigned = stored(assigned, "clusters")
    scratch.clear()
    found = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    inertia = {r["cluster"]: int(r["total"]) for r in found}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return assigned.select(
        F.col("key").alias(key), "cluster", "distance",
        _at_number([inertia.get(c, 0) for c in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), _at_number(digests, "string").alias("centroid_sha256"))


def sql(table: str, k: int, rounds: int, seed: int, scale: int) -> str:
    """DuckDB SQL with the same rows: every round is two tables, assignments and centroids."""
    steps = [f"""
kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS w
  FROM {table}
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
  SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR) NULLS LAST, vec_id, w) - 1)::INTEGER AS cluster, w
  FROM kept QUALIFY cluster < {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS (
  SELECT vec_id, any_value(v) AS w, min(struct_pack(distance := d, cluster := cluster)) AS best
  FROM (SELECT k.vec_id, k.w AS v, c.cluster,
               list_sum(list_transform(list_zip(k.w, c.w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
        FROM kept k, c{r} c)
  GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (
  SELECT cluster, list(floor_mean ORDER BY i) AS w
  FROM (SELECT best.cluster AS cluster, i, ((sum(w[i]) - ((sum(w[i]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS floor_mean
        FROM a{r}, range(1, {DIM + 1}) t(i) GROUP BY ALL)
  GROUP BY cluster),
c{r + 1} AS (SELECT cluster, coalesce(m.w, c.w) AS w FROM c{r} c LEFT JOIN m{r} m USING (cluster))""")
    return f"""
WITH {",".join(f"{s}" for s in steps)}
SELECT vec_id, cluster, best.distance AS distance,
       sum(best.distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
       sum(best.distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.w, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.best.cluster = c.cluster
"""
