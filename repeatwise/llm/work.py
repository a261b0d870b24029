"""Tables in the shared folder, and other small helpers of the operators here."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repeatwise.session import shared_folder
from repeatwise.sources.store import remove


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's source to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "repeatwise.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    out.write(file, os.path.relpath(file, os.path.dirname(package)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


_kept: dict[str, Any] = {}


def worker_state(name: str, build: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: that of one operator at a time."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = build()
    return _kept[name]


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written below the folder of `spark.checkpoint.dir` and read again.

    Cuts the lineage: a lost executor costs no more than the stages after this one.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that only one run of an operator needs."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """`df` written and read again, as by `stored`."""
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Removes the tables; nothing that is still to be computed may read them."""
        remove(self.spark, self.folder)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that `df` doesn't have."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def held_out(doc_id: Column) -> Column:
    """Documents that nothing may be learned from: remainder 2 of 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
