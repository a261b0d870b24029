"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept as `docs` and decides on all of it. All but the
last return the columns that `docs` has. Null and empty texts fail the quality stage, texts of any
length are taken whole, of equal texts the smallest id stays, rows with a null id are judged like
others, and an empty table gives an empty table at every stage; columns of any name pass through. `run` writes each stage's result as Parquet into
the shared folder, where the next one reads it, so a lost executor never costs more than
the stage at work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repeatwise.llm import langid, lines, neardup, packing, quality
from repeatwise.llm.queries import BYTE_BPE, MIN_PAGES, PIECES, RATIO
from repeatwise.llm.work import documents, fresh, stored

#: Language predictions of less than this share are rejected.
MIN_SCORE = 0.5
#: And those of texts that cost over this multiple, per character, of the language's own texts,
#: or of whose words less than this share agrees.
MAX_SURPRISE, MIN_AGREEMENT = 2, 2 / 3
#: Per cent of Jaccard similarity from which documents are near duplicates.
SIMILARITY = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or repeat themselves too much."""
    into = fresh(docs, "quality")
    return quality.quality_rules(docs, into=into).where(F.col(into)["kept"]).select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, of no language that is known, or mixed of several."""
    into = fresh(docs, "language")
    model = langid.fit(docs, PIECES)
    found = langid.predict(docs, model, into=into, evidence=True)
    return found.where((F.col(into)["lang"] != langid.UNKNOWN) & (F.col(into)["score"] >= MIN_SCORE)
                       & (F.col(into)["surprise"] <= MAX_SURPRISE)
                       & (F.col(into)["agreement"] >= MIN_AGREEMENT)).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes boilerplate lines of a source out of its texts; no document goes."""
    return lines.drop_boilerplate(docs, ratio=RATIO, min_pages=MIN_PAGES)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves the document with the smallest id of each group of near duplicates."""
    names = {x: fresh(docs, x) for x in ("n_shingles", "component", "kept")}
    return neardup.near_duplicates(docs, threshold=SIMILARITY, **names).where(F.col(names["kept"])).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all that is left."""
    return packing.pack_patterns(docs, BYTE_BPE)


STAGES = [
    ("quality rules", quality_stage),
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", duplicate_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can express neither suffix arrays, language models, shingle sets nor packing; each
#: stage is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
