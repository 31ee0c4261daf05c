"""Running Arrow functions of this package on executors."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()

# Whole texts make wide rows: unless the session says otherwise, a batch holds a few MB, in the JVM as in Python.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", "8388608"),
}


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers of the session this package, once an application, and batches of bounded size.

    Spark serves the archive from the driver, so workers need no path of it.
    """
    for key, (default, value) in BATCHES.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix=f"{package.name}-code-")
    archive = os.path.join(folder, f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with a function that may use this package."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back_memory()

    return df.mapInArrow(run, schema)


def give_back_memory() -> None:
    """Return what a finished task has freed: Spark keeps its Python workers, stage after stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc has nothing of the kind
        pass


def with_text(docs: DataFrame, names: list[str], text: str) -> tuple[DataFrame, list[str], int]:
    """``docs`` as columns ``_0``, ``_1``, ... of ``names``, their types, and the place of the text, sent once."""
    places = [f"_{k}" for k in range(len(names))]
    columns = [F.col(n).alias(p) for n, p in zip(names, places)]
    if text not in names:
        columns.append(F.col(text).alias("_text"))
    rows = docs.select(*columns)
    kinds = [f"{p} {rows.schema[p].dataType.simpleString()}" for p in places]
    return rows, kinds, names.index(text) if text in names else len(names)


def keep_rows(found: DataFrame, docs: DataFrame, id: str, condition: Callable[..., Column]) -> DataFrame:
    """The rows of ``docs`` whose results meet a condition, with the columns of ``docs``.

    ``found``: the id, the other columns of ``docs`` in order, then results, which
    go to ``condition`` as columns. Columns are told by place, so names may clash.
    """
    names = [id, *(c for c in docs.columns if c != id)]
    flat = found.toDF(*(f"_c{k}" for k in range(len(found.columns))))
    results = [F.col(f"_c{k}") for k in range(len(names), len(found.columns))]
    kept = flat.filter(condition(*results))
    return kept.select(*(F.col(f"_c{names.index(c)}").alias(c) for c in docs.columns))
