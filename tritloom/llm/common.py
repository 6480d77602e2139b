"""Helpers shared by the training-data operators: tables, the shared folder, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..shared import Scratch, removed, shared_dir, ship, spread, written

__all__ = ["Scratch", "arrow_schema", "map_rows", "pieces", "removed", "shared_dir", "ship", "spread", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; only Spark opens the path."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def map_rows(df: DataFrame, columns: list[str], make: Callable[..., Callable], schema: str | T.StructType, *args) -> DataFrame:
    """``mapInArrow`` over ``columns``: ``make(*args)`` runs once a task and returns batch -> dict of lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make(*args)
        for batch in batches:
            for piece in pieces(batch):
                yield pa.RecordBatch.from_pydict(step(piece), schema=arrow)

    arrow = arrow_schema(schema)
    ship(df.sparkSession)
    return df.select(*columns).mapInArrow(run, schema)


def arrow_schema(schema: str | T.StructType) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def pieces(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Splits a batch so that no piece but a single row holds much over ``most`` bytes."""
    if batch.num_rows > 1 and batch.nbytes > most:
        half = batch.num_rows // 2
        yield from pieces(batch.slice(0, half), most)
        yield from pieces(batch.slice(half), most)
    elif batch.num_rows:
        yield batch
