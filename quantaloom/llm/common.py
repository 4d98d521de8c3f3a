"""Shared helpers of the training-data operators."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, shared_checkpoint_dir  # noqa: F401

#: ASCII only: other letters keep their case, as the contracts ask.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(column):
    return F.translate(column, UPPER, LOWER)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Whole texts travel to Python in Arrow batches: keep few rows in each, since some are very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def chunks_by_weight(weights, most: int) -> Iterator[slice]:
    """Slices over rows whose summed weights stay within ``most`` (one row at least)."""
    start = total = 0
    for i, w in enumerate(weights):
        if i > start and total + w > most:
            yield slice(start, i)
            start, total = i, 0
        total += w
    if start < len(weights):
        yield slice(start, len(weights))


def learned(rows: DataFrame, learn: Callable[[pa.Table], object]) -> object:
    """What ``learn`` makes of a bounded sample of rows, in a task, so that the driver holds the model alone; a lost executor costs a retry."""
    schema = pa.schema([(f.name, pa.string() if f.dataType.simpleString() == "string" else pa.int64()) for f in rows.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        table = pa.Table.from_batches(held) if held else schema.empty_table()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn(table))], pa.binary())], ["model"])

    found = rows.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found[0]) if found else learn(schema.empty_table())
