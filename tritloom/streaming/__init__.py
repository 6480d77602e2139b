"""Streams of metrics and engrams: the same plans for batch and streaming DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RATE = "100 milliseconds"


def source(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def alerts(events: DataFrame, value: str, threshold: float) -> DataFrame:
    return events.where(F.col(value) >= threshold)


def windowed(events: DataFrame, time: str, size: str, slide: str | None, keys: list[str], value: str, late: str | None = None) -> DataFrame:
    """(start, keys, n, total) of tumbling or sliding windows; ``late`` is the watermark of a stream."""
    events = events.withWatermark(time, late) if late else events
    counted = events.groupBy(F.window(time, size, slide).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return counted.select(F.col("w.start").alias("start"), *keys, "n", "total")


def bundle_state(trits: DataFrame, keys: list[str]) -> DataFrame:
    """Running votes of a superposition; on a stream use update or complete mode, since sums go on changing."""
    return trits.groupBy(*keys, "dim").agg(F.sum("trit").cast("bigint").alias("votes"))


def subscribe(stream: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str, rate: str = RATE, mode: str = "append") -> StreamingQuery:
    """Calls ``callback`` with each micro-batch, at most once per ``rate``."""
    return stream.writeStream.foreachBatch(callback).outputMode(mode).option("checkpointLocation", checkpoint).trigger(processingTime=rate).start()


def run_available(stream: DataFrame, table: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what its source has now, into an in-memory table."""
    query = stream.writeStream.format("memory").queryName(table).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(table)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what its source has now, into a Parquet table that executors write."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def encode_stream(files: DataFrame, ident: str, data: str, chunk: int | None = None) -> DataFrame:
    """Chunk engrams (ident, chunk_no, dim, trit) of streamed files: each row holds whole chunks, so there is no state."""
    from ..operators.codebook import CHUNK, bound_codes, encode_files

    return encode_files(files, bound_codes(files.sparkSession, chunk or CHUNK), ident, data)


def decode_stream(files: DataFrame, ident: str, data: str, chunk: int | None = None) -> DataFrame:
    """(ident, chunk_no, pos, decoded, score) of streamed files after encoding, without state."""
    from ..operators.codebook import CHUNK, bound_codes, decode_files

    return decode_files(files, bound_codes(files.sparkSession, chunk or CHUNK), ident, data)
