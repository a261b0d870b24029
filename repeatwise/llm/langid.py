"""Language of a text by unigram pieces, summed over all segmentations.

The pieces are those of a public vocabulary, which is never changed. A language gives each
piece a probability; a word's probability is the sum over all ways to cut it into pieces of
the product of their probabilities (forward algorithm), and a text's is the product over
its words. Probabilities come from expectation maximisation: the expected number of uses of
each piece, over all segmentations of the training words, normalised.

Words are runs of letters, in lower case. A text without a letter, or null, is `und` with
score 0. Otherwise the language with the highest probability wins, ties by name, and the
score is its share among all languages, each of them equally likely beforehand.

That share is near 1 after a few dozen words of anything. On request a prediction also holds
evidence that doesn't grow with the text: `surprise`, the negative logarithm of the winner's
probability per character, against that of its training words; and `agreement`, the share of
words to which no other language gives over e times the winner's probability. Text of a
language that isn't known surprises, text of several languages disagrees.

Training reads at most `sample_docs` labelled texts of each language, those with the
smallest hash of their id; this bound is a parameter. Everything else reads whole texts.
Without any labelled text every prediction is `und`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repeatwise.llm.work import fresh, ship, worker_state

LETTERS = re.compile(r"[^\W\d_]+")
MARK = "▁"
UNKNOWN = "und"
#: Longer words are cut, so that a product of probabilities stays a normal number.
WORD_CHARS = 24
MAX_PIECE = 12
FLOOR = 1e-7
#: Words whose scores a Python worker remembers.
MEMORY = 200_000
SCHEMA = "struct<lang: string, score: double>"
EVIDENCE = "struct<lang: string, score: double, surprise: double, agreement: double>"
#: Hashes of ids lie between these; a range of them that holds too few ids grows by this factor.
SMALLEST, LARGEST, GROWTH = -(1 << 63), (1 << 63) - 1, 16
#: The least usual cost of a character, for languages with hardly any training words.
LEAST_COST = 0.1


def vocabulary(path: str) -> list[str]:
    """The vocabulary's pieces of letters, in lower case, each with or without word mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if len(p) <= MAX_PIECE and p.removeprefix(MARK).isalpha()}
                  | {MARK})


def words_of(text: str) -> list[str]:
    """Its runs of letters in lower case, long ones in parts."""
    found = LETTERS.findall(text.lower())
    if not all(map(str.isalpha, found)):
        # Digits and the like that the regular expression takes for letters, such as a superscript.
        found = [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]
    if max(map(len, found), default=0) > WORD_CHARS:
        found = [w[i:i + WORD_CHARS] for w in found for i in range(0, len(w), WORD_CHARS)]
    return found


@dataclass
class Lattice:
    """Looks up pieces at all places of many words at once."""

    pieces: list[str]

    def __post_init__(self) -> None:
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in sorted({len(p) for p in self.pieces}):
            ids = np.array([i for i, p in enumerate(self.pieces) if len(p) == size])
            codes = np.array([[ord(c) for c in self.pieces[i]] for i in ids], np.uint64)
            hashed = np.zeros(len(ids), np.uint64)
            for k in range(size):
                hashed = self.grow(hashed, codes[:, k])
            order = np.argsort(hashed)
            self.by_length[size] = hashed[order], ids[order]

    @staticmethod
    def grow(hashed: np.ndarray, codes: np.ndarray) -> np.ndarray:
        mixed = (hashed ^ codes) * np.uint64(0x9E3779B97F4A7C15)
        return mixed ^ (mixed >> np.uint64(29))

    def places(self, words: list[str]) -> dict[int, np.ndarray]:
        """For words of one length: by piece length, ids (word, start), -1 for none.

        A single character that isn't a piece has the id after the last.
        """
        text = "".join(MARK + w for w in words)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = codes.reshape(len(words), -1).astype(np.uint64)
        n, found = codes.shape[1], {}
        hashed = np.zeros(codes.shape, np.uint64)
        for size in range(1, min(n, max(self.by_length, default=0)) + 1):
            hashed = self.grow(hashed[:, :n - size + 1], codes[:, size - 1:])
            if size in self.by_length:
                known, ids = self.by_length[size]
                at = np.minimum(np.searchsorted(known, hashed), len(known) - 1)
                found[size] = np.where(known[at] == hashed, ids[at], -1)
        one = found.get(1, np.full(codes.shape, -1))
        found[1] = np.where(one < 0, len(self.pieces), one)
        return found

    def forward(self, places: dict[int, np.ndarray], p: np.ndarray) -> list[np.ndarray]:
        """Sums over all segmentations of each prefix; p is (pieces + 2, languages)."""
        rows, n = places[1].shape
        sums = [np.ones((rows, p.shape[1]))]
        for end in range(1, n + 1):
            total = np.zeros((rows, p.shape[1]))
            for size, ids in places.items():
                if size <= end:
                    total += sums[end - size] * p[ids[:, end - size]]
            sums.append(total)
        return sums

    def expected(self, places: dict[int, np.ndarray], p: np.ndarray,
                 counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece by one language's words, weighted with counts."""
        rows, n = places[1].shape
        ahead = self.forward(places, p)
        behind = [np.ones((rows, 1))] * (n + 1)
        for start in range(n - 1, -1, -1):
            total = np.zeros((rows, 1))
            for size, ids in places.items():
                if start + size <= n:
                    total += p[ids[:, start]] * behind[start + size]
            behind[start] = total
        used = np.zeros(len(p))
        scale = counts / ahead[n][:, 0]
        for size, ids in places.items():
            for start in range(n - size + 1):
                at = ids[:, start]
                share = (ahead[start] * p[at] * behind[start + size])[:, 0] * scale
                used += np.bincount(np.where(at < 0, len(p) - 1, at), share, len(p))
        used[-1] = 0
        return used


@dataclass
class Model:
    langs: list[str]
    pieces: list[str]
    #: (pieces + 2, languages); the last two rows are unknown characters and "no piece".
    p: np.ndarray
    #: By language, the negative logarithm of probability per character of its training words.
    cost: np.ndarray


def characters(words: list[str]) -> np.ndarray:
    """Lengths with word mark."""
    return np.fromiter((len(w) + 1 for w in words), np.int64, len(words))


def by_length(words: list[str]) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    return groups


def _normal(used: np.ndarray) -> np.ndarray:
    p = (used + FLOOR * used.sum(0)) / (used.sum(0) * (1 + FLOOR * len(used)))
    p[-2], p[-1] = FLOOR, 0
    return p


def _bound(wanted: int, n: int) -> int:
    """A hash below which `wanted` of `n` different ids lie, but for a chance of one in a billion."""
    share = (wanted + 6 * wanted ** 0.5 + 20) / max(n, 1)
    return LARGEST if share >= 1 else SMALLEST + int(share * (LARGEST - SMALLEST))


def _up_to(limits: dict[str, int]) -> Column:
    """Rows of the languages named whose hash is at most theirs."""
    return reduce(Column.__or__, [(F.col("lang") == x) & (F.col("h") <= F.lit(h)) for x, h in limits.items()],
                  F.lit(False))


def sample(docs: DataFrame, text: str, lang: str, key: str, allowed: Column | None,
           sample_docs: int) -> DataFrame:
    """(lang, text) of the `sample_docs` allowed rows of each language with the least hash.

    Rows are counted by language first. That count tells which hashes can be among the least, so
    that little more than the sample is ranked, however many rows a language has.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull()) \
        .where(F.lit(True) if allowed is None else allowed) \
        .select(F.col(lang).alias("lang"), F.xxhash64(F.col(key)).alias("h"), F.col(text).alias("text"))
    bounds = {r["lang"]: _bound(sample_docs, r["n"]) for r in rows.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    open_, limits = set(bounds), {}
    while open_:
        # Some more hashes than asked for, as a rule; copies of one id can leave too few of them.
        tried = {x: bounds[x] for x in open_}
        least = rows.select("lang", "h").where(_up_to(tried)).distinct()
        rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
        found = {r["lang"]: (r["n"], r["limit"]) for r in least.withColumn("r", rank)
                 .where(F.col("r") <= sample_docs).groupBy("lang")
                 .agg(F.count(F.lit(1)).alias("n"), F.max("h").alias("limit")).collect()}
        for x, bound in tried.items():
            n, limit = found.get(x, (0, None))
            if n == sample_docs or bound == LARGEST:
                limits[x] = limit
                open_.remove(x)
            else:
                bounds[x] = min(LARGEST, bound + max(1, bound - SMALLEST) * (GROWTH - 1))
    chosen = _up_to(limits)
    # Rows with one id count once, so that copies don't lift the bound.
    return rows.where(chosen).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")


def fit(docs: DataFrame, vocab_path: str, text: str = "text", lang: str = "lang",
        key: str = "doc_id", allowed: Column | None = None, sample_docs: int = 1000,
        rounds: int = 3) -> Model:
    """Piece probabilities of each language, from a sample bounded by `sample_docs`."""
    ship(docs.sparkSession)
    pieces = vocabulary(vocab_path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for tag, value in zip(*(c.to_pylist() for c in batch.columns)):
                seen.update((tag, w) for w in words_of(value))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()),
                 pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    # Never more than the distinct words of the sample.
    words = sample(docs, text, lang, key, allowed, sample_docs) \
        .mapInArrow(count, "lang string, word string, n long") \
        .groupBy("lang", "word").agg(F.sum("n").alias("n")).cache()
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    p = _normal(np.ones((len(pieces) + 2, len(langs))))
    for _ in range(rounds if langs else 0):
        def uses(batches: Iterator[pa.RecordBatch], p: np.ndarray = p) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(pieces)
            used = np.zeros((len(langs), len(p)))
            for batch in batches:
                tags, values, n = (c.to_pylist() for c in batch.columns)
                groups: dict[tuple, list[int]] = {}
                for i, key_ in enumerate(zip(tags, map(len, values))):
                    groups.setdefault(key_, []).append(i)
                for (tag, _), own in groups.items():
                    k = langs.index(tag)
                    used[k] += lattice.expected(lattice.places([values[i] for i in own]),
                                                p[:, k:k + 1], np.array([n[i] for i in own], float))
            k, piece = np.nonzero(used)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k, pa.int64()), pa.array(piece, pa.int64()), pa.array(used[k, piece])],
                ["k", "piece", "used"])

        # As many rows as languages and pieces, however much was read.
        rows = words.mapInArrow(uses, "k long, piece long, used double") \
            .groupBy("k", "piece").agg(F.sum("used").alias("used")).toPandas()
        used = np.zeros_like(p)
        used[rows["piece"], rows["k"]] = rows["used"]
        p = _normal(used)

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces)
        for batch in batches:
            tags, values, n = (c.to_pylist() for c in batch.columns)
            k, n = np.array([langs.index(tag) for tag in tags], np.int64), np.array(n, float)
            own = _logs(lattice, p, values)[np.arange(len(k)), k] if len(k) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k), pa.array(-own * n), pa.array(characters(values) * n)], ["k", "cost", "chars"])

    cost = np.zeros(len(langs))
    for row in words.mapInArrow(costs, "k long, cost double, chars double").groupBy("k") \
            .agg(F.sum("cost") / F.sum("chars")).collect() if langs else []:
        cost[row[0]] = max(row[1], LEAST_COST)
    words.unpersist()
    return Model(langs, pieces, p, cost)


def _logs(lattice: Lattice, p: np.ndarray, words: list[str]) -> np.ndarray:
    """Logarithms of the probabilities of words, by language."""
    logs = np.zeros((len(words), p.shape[1]))
    for own in by_length(words).values():
        logs[own] = np.log(lattice.forward(lattice.places([words[i] for i in own]), p)[-1])
    return logs


def _learn(model: Model, lattice: Lattice, new: list[str]) -> np.ndarray:
    return _logs(lattice, model.p, new)


def predict(docs: DataFrame, model: Model, text: str = "text", into: str = "language",
            evidence: bool = False) -> DataFrame:
    """`docs` with a struct column `into` (lang, score), replacing one of that name.

    With `evidence` it has the fields `surprise` and `agreement` as well, null for `und`.
    """
    import hashlib

    ship(docs.sparkSession)
    name = "languages " + hashlib.sha256(model.p.tobytes() + repr(model.langs).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(EVIDENCE if evidence else SCHEMA)
    def language(column: pa.Array) -> pa.Array:
        model = shared.value
        lattice, known, logs = worker_state(name, lambda: (
            Lattice(model.pieces), {}, [np.zeros((0, len(model.langs)))]))
        langs, scores, surprises, agreements = [], [], [], []
        for at in range(0, len(column), 256):
            split = [words_of(t) if t else [] for t in column[at:at + 256].to_pylist()]
            new = list({w for ws in split for w in ws} - known.keys())
            if new:
                if len(known) + len(new) > MEMORY:
                    known.clear()
                    logs[0] = logs[0][:0]
                    new = list({w for ws in split for w in ws})
                known.update(zip(new, range(len(logs[0]), len(logs[0]) + len(new))))
                logs[0] = np.concatenate([logs[0], _learn(model, lattice, new)])
            for ws in split:
                if not model.langs or not any(map(str.isalpha, ws)):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    surprises.append(None)
                    agreements.append(None)
                    continue
                own = logs[0][np.fromiter(map(known.__getitem__, ws), np.int64, len(ws))]
                total = own.sum(0)
                best = int(total.argmax())
                langs.append(model.langs[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
                if evidence:
                    # Words that say nothing have the logarithm 0 everywhere.
                    says = own[:, best] < 0
                    chars = (characters(ws) * says).sum()
                    surprises.append(float(-total[best] / chars / model.cost[best]))
                    agreements.append(float((own[says, best] >= own[says].max(1) - 1).mean()))
        columns = {"lang": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())}
        if evidence:
            columns["surprise"] = pa.array(surprises, pa.float64())
            columns["agreement"] = pa.array(agreements, pa.float64())
        return pa.StructArray.from_arrays(list(columns.values()), list(columns))

    raw = fresh(docs, "_language")
    return docs.withColumn(raw, language(F.col(text))).withColumn(into, F.col(raw)).drop(raw)
