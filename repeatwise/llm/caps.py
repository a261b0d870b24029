"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction; a vector passes it if its cosine with the direction reaches `cap`.
Directions come from a random product code: a vector, rotated at random, is cut into blocks,
each block has its own short list of random unit vectors, and every combination of one from
each block, scaled to length one, is a direction. A vector is decoded to the list of all
directions it passes block by block: combinations are given up as soon as the best that the
remaining blocks can add doesn't reach the cap any more, so the cost follows the list and
not the number of directions. There are `CODES` such codes or more.

Vectors that share a filter are compared by cosine in double precision. How many filters
there are follows from the number of vectors: the cap keeps about `bucket` vectors in each,
and there are so many that a pair at the threshold shares `shared` of them on average. As filters of
one code aren't independent, the chance of a pair to share any is measured on the code itself, with random
pairs at exactly the threshold; codes are added, and then the cap widened, until `RECALL` of them do. If
that can't be reached it is an error. `Code.recall` is the share measured.

A pair counts in the first filter it shares, found from the two lists, so links are counted
once without being written out. Filters with many vectors are cut into chunks by a hash of
the vector, and each two chunks of a filter meet in one task, of bounded size. Tasks return
one row for each vector: its links, and a vector that stands for all it is connected with.

Equal vectors are one from the start and count as often as they occur. Vectors that are
null, zero, or hold null, NaN or infinite components link with nothing. Vectors of different
lengths are compared within their length only. Equal rows are vectors of their own under one
id. A null id is given no component and kept, and is no partner of others. An empty table gives an
empty table; columns of the results' names are replaced, others stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatwise.llm.graph import components
from repeatwise.llm.work import fresh, ship, stored

#: Vectors of one chunk of a filter.
CHUNK = 1024
#: Independent codes, each with a rotation of its own: directions of one share their blocks. At least
#: and at most so many.
CODES, MOST_CODES = 4, 32
#: Share of pairs at the threshold that have to share a filter, and pairs it is measured on.
RECALL, PAIRS = 0.995, 1500
#: Below so many components directions are plain random unit vectors, and shares are sampled.
FEW = 16


def pairs_at(dim: int, cosine: float, n: int, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Random pairs of unit vectors at exactly this cosine; equal ones in one dimension."""
    x, side = random.standard_normal((2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side -= (side * x).sum(1, keepdims=True) * x
    if dim == 1:
        return x, x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    return x, cosine * x + math.sqrt(1 - cosine ** 2) * side


class Code:
    """A product code with the filters for `n` vectors of `dim` components."""

    def __init__(self, dim: int, n: int, threshold: float, bucket: int, shared: float, seed: int = 7) -> None:
        random = np.random.default_rng([seed, dim])
        share = min(0.02, max(bucket / max(n, 1), 1e-9))
        left, right = pairs_at(dim, threshold, PAIRS, random)
        while True:
            self._shape(dim, share, threshold, shared, random)
            missed = np.ones(len(left), bool)
            while len(self.codes) < CODES or missed.mean() > 1 - RECALL and len(self.codes) < MOST_CODES:
                self.codes.append(self._code(dim, random))
                for at in range(0, len(left), 250):
                    missed[at:at + 250] &= ~self._meet(self.codes[-1], left[at:at + 250], right[at:at + 250])
                # So few that no number of codes would do: the cap has to be wider.
                if len(self.codes) == CODES and missed.mean() ** (MOST_CODES / CODES) > 1 - RECALL:
                    break
            self.recall = 1 - float(missed.mean())
            if self.recall >= RECALL:
                return
            share *= 2
            if share > 0.5:
                raise ValueError(f"no filters for vectors of {dim} components find {RECALL} of the pairs at {threshold}")

    def _shape(self, dim: int, share: float, threshold: float, shared: float, random: np.random.Generator) -> None:
        self.cap, both = self._passing(dim, share, threshold, random)
        # In few dimensions a small cap can't hold two vectors at the threshold.
        while both < share / 10 and share < 0.5 and dim < FEW:
            share *= 1.5
            self.cap, both = self._passing(dim, share, threshold, random)
        wanted = max(1, shared / max(both, 1e-12) / CODES)
        self.blocks = 1 if dim < FEW else 2 if wanted < 1 << 20 else 3
        self.size = math.ceil(wanted ** (1 / self.blocks))
        self.bounds = np.linspace(0, dim, self.blocks + 1).astype(int)
        self.codes = []

    def _code(self, dim: int, random: np.random.Generator) -> tuple[np.ndarray, list[np.ndarray]]:
        rotation = np.linalg.qr(random.standard_normal((dim, dim)))[0]
        words = [random.standard_normal((self.size, b - a)) for a, b in zip(self.bounds, self.bounds[1:])]
        return rotation, [w / np.linalg.norm(w, axis=1, keepdims=True) for w in words]

    def _meet(self, code: tuple, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which pairs share a filter of a code."""
        keys = [row * self.size ** self.blocks + name for row, name in (self._list(x, *code) for x in (left, right))]
        both = np.intersect1d(*keys, assume_unique=True)
        return np.bincount(both // self.size ** self.blocks, minlength=len(left)) > 0

    @staticmethod
    def _passing(dim: int, share: float, threshold: float, random: np.random.Generator) -> tuple[float, float]:
        """The cap that `share` of vectors pass, and how many of all pairs at the threshold do."""
        tilt = math.sqrt(1 - threshold ** 2)
        if dim < FEW:
            x = random.standard_normal((100_000, dim))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            side = random.standard_normal((100_000, dim))
            side -= (side * x).sum(1, keepdims=True) * x
            side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
            cap = min(float(np.quantile(x[:, 0], 1 - min(share, 0.4))), 1 - 1e-9)
            y = threshold * x[:, 0] + tilt * side[:, 0] if dim > 1 else x[:, 0]
            return cap, float(((x[:, 0] >= cap) & (y >= cap)).mean())
        # Components of a random unit vector in many dimensions are nearly normal.
        normal = NormalDist()
        cut = normal.inv_cdf(1 - share)
        z = np.linspace(cut, cut + 8, 4001)
        density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        rest = [1 - normal.cdf((cut - threshold * v) / tilt) for v in z]
        return cut / math.sqrt(dim), float(np.sum(density * rest) * (z[1] - z[0]))

    def lists(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all directions that unit vectors pass."""
        found = [self._list(vectors, *code) for code in self.codes]
        return (np.concatenate([row for row, _ in found]),
                np.concatenate([k * self.size ** self.blocks + name for k, (_, name) in enumerate(found)]))

    def _list(self, vectors: np.ndarray, rotation: np.ndarray, words: list[np.ndarray]) -> tuple:
        rotated = vectors @ rotation
        scores = [rotated[:, a:b] @ w.T / math.sqrt(self.blocks)
                  for a, b, w in zip(self.bounds, self.bounds[1:], words)]
        best = [s.max(1) for s in scores]
        row, name, score = np.arange(len(vectors)), np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
        for k, s in enumerate(scores):
            ahead = sum(best[k + 1:], np.zeros(len(vectors)))
            total = score[:, None] + s[row]
            i, j = np.nonzero(total >= (self.cap - ahead[row])[:, None])
            row, name, score = row[i], name[i] * self.size + j, total[i, j]
        return row, name


def _bytes(x: np.ndarray) -> bytes:
    """Components in single precision if that loses nothing, else in double."""
    short = x.astype("<f4")
    return (short if (short == x).all() else x.astype("<f8")).tobytes()


def _unit(vectors: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    if all(len(v) == 4 * dim for v in vectors):
        x = np.frombuffer(b"".join(vectors), "<f4").reshape(-1, dim).astype(float)
    else:
        x = np.array([np.frombuffer(v, "<f4" if len(v) == 4 * dim else "<f8") for v in vectors], float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector) to (id, dim, vector as bytes) of those that can link."""
    for batch in batches:
        ids, dims, out = [], [], []
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key is None or not value or None in value:
                continue
            x = np.array(value, float)
            if np.isfinite(x).all() and x.any():
                # The same direction in a range where squares neither vanish nor overflow.
                x = x / np.abs(x).max() if not 1e-100 < np.abs(x).max() < 1e100 else x
                ids.append(key)
                dims.append(len(x))
                out.append(_bytes(x + 0.0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())],
            ["id", "dim", "vector"])


def _compare(dim: int, threshold: float):
    """Function for applyInPandas: links of two chunks of a filter."""
    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own, _, a, b = key
        rows = rows.sort_values(["side", "r"])
        ids, n = rows["r"].to_numpy(), rows["n"].to_numpy()
        x = _unit(list(rows["vector"]), dim)
        # Filters before this one that each vector passes: pairs that share one count there.
        earlier = [f[:np.searchsorted(f, own)] for f in rows["filters"]]
        names, at = np.unique(np.concatenate(earlier), return_inverse=True)
        passed = np.zeros((len(rows), len(names)), np.float32)
        passed[np.repeat(np.arange(len(rows)), [len(e) for e in earlier]), at] = 1
        cut = int((rows["side"] == 0).sum()) if a != b else 0
        left, right = (slice(0, cut), slice(cut, None)) if a != b else (slice(None), slice(None))
        linked = (x[left] @ x[right].T >= threshold) & (passed[left] @ passed[right].T == 0)
        if a == b:
            np.fill_diagonal(linked, False)
        i, j = np.nonzero(linked)
        j = j + cut
        links = np.bincount(i, n[j], len(rows))
        if a != b:
            links += np.bincount(j, n[i], len(rows))
        # One edge for each vector, to what represents its component here, in place of all pairs.
        root = np.arange(len(rows))
        while True:
            new = root.copy()
            np.minimum.at(new, i, root[j])
            np.minimum.at(new, j, root[i])
            if (new == root).all():
                break
            root = new
        hit = links > 0
        return pd.DataFrame({"r": ids[hit], "links": links[hit].astype(np.int64), "to": ids[root][hit]})

    return compare


def linked_vectors(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id",
                   threshold: float = 0.9, bucket: int = 128, shared: float = 18.0,
                   n_links: str = "n_links", component: str = "component_id",
                   kept: str = "kept") -> DataFrame:
    """`vectors` with the columns `n_links`, `component` and `kept`, replacing such."""
    spark = vectors.sparkSession
    ship(spark)
    slim = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    valid = stored(slim.mapInArrow(_normalised, "id long, dim int, vector binary"), "vectors")
    records = stored(valid.groupBy("dim", "vector").agg(F.min("id").alias("r"), F.count("*").alias("n")), "records")
    counts: DataFrame | None = None
    for dim, size in sorted(records.groupBy("dim").count().collect()):
        found = _links(records.where(F.col("dim") == dim).select("r", "n", "vector"), dim, size,
                       threshold, bucket, shared)
        counts = found if counts is None else counts.union(found)
    if counts is None:
        counts = spark.createDataFrame([], "r long, links long, to long")
    counts = stored(counts, "links")
    labels = components(counts.select(F.col("r").alias("a"), F.col("to").alias("b")))
    links = counts.groupBy(F.col("r").alias("v")).agg(F.sum("links").alias("links"))
    of_record = records.join(labels, F.col("r") == F.col("node"), "left") \
        .join(links, F.col("r") == F.col("v"), "left") \
        .select("dim", "vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
                F.coalesce("component", "r").alias("c"))
    own, n, c = (fresh(vectors, x) for x in ("_id", "_n", "_c"))
    of_row = valid.join(of_record, ["dim", "vector"]).groupBy(F.col("id").alias(own)) \
        .agg(F.max("links").alias(n), F.min("c").alias(c))
    joined = vectors.join(of_row, F.col(key).cast("long") == F.col(own), "left")
    id_ = F.col(key).cast("long")
    values = {n_links: F.coalesce(F.col(n), F.lit(0)), component: F.coalesce(F.col(c), id_),
              kept: F.coalesce(F.coalesce(F.col(c), id_) == id_, F.lit(True))}
    return joined.select(*(x for x in vectors.columns if x not in values),
                         *(v.alias(k) for k, v in values.items()))


def _links(records: DataFrame, dim: int, size: int, threshold: float, bucket: int,
           shared: float) -> DataFrame:
    """(r, links, to) of the records of one length, a row for each filter with links."""
    code = Code(dim, size, threshold, bucket, shared)
    spark = records.sparkSession
    sent = spark.sparkContext.broadcast(code)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                row, name = sent.value.lists(_unit(part.column(2).to_pylist(), dim))
                order = np.lexsort((name, row))
                ends = np.searchsorted(row[order], np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(name[order], pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], ["r", "n", "vector", "filters"])

    decoded = stored(records.mapInArrow(decode, "r long, n long, vector binary, filters array<long>"), "filters")
    rows = decoded.select("r", F.explode("filters").alias("f"))
    sizes = rows.groupBy("f").agg(F.count("*").alias("m")).where("m > 1")
    chunked = rows.join(sizes, "f").withColumn("k", F.ceil(F.col("m") / CHUNK).cast("int")) \
        .withColumn("own", F.pmod(F.xxhash64("r"), F.col("k")).cast("int"))
    # A chunk meets each chunk of its filter, and itself.
    met = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
        "r", "f", "k", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))
    full = met.join(decoded, "r")
    return full.groupBy("f", "k", "a", "b").applyInPandas(
        _compare(dim, threshold), "r long, links long, to long")
