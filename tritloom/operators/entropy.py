"""Entropy of byte content, adaptive dimensions, outlier regions and n-gram counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..shared import ship

FLOOR, CEILING, LOW, HIGH = 10_000, 250_000, 0.3, 0.8


def byte_counts(df: DataFrame, ident: str, data: str, block: int | None = None) -> DataFrame:
    """(ident[, block], byte, n) with bytes as two hexadecimal digits; blocks are of ``block`` bytes.

    A row's bytes are counted in its task by one pass of numpy; what is shuffled are counts, at most 256 for each row or
    block, so rows with equal ids add up. Null data counts nothing.
    """
    ship(df.sparkSession)
    ident_type = df.schema[ident].dataType
    fields = [T.StructField(ident, ident_type), *([T.StructField("block", T.IntegerType())] if block else []), T.StructField("byte", T.StringType()), T.StructField("n", T.LongType())]
    schema = T.StructType(fields)
    arrow, hexes = to_arrow_schema(schema), np.array([f"{b:02X}" for b in range(256)])

    def run(batches):
        for batch in batches:
            ids, rows, keys, counts = batch.column(0), [], [], []
            for k, raw in enumerate(batch.column(1).to_pylist()):
                if not raw:
                    continue
                seen = np.frombuffer(raw, np.uint8).astype(np.int64)
                if block:
                    seen += np.arange(len(seen)) // block * 256
                    key, n = np.unique(seen, return_counts=True)
                else:
                    n = np.bincount(seen, minlength=256)
                    key = np.flatnonzero(n)
                    n = n[key]
                rows.append(np.full(len(key), k))
                keys.append(key)
                counts.append(n)
            if rows:
                key = np.concatenate(keys)
                columns = [ids.take(pa.array(np.concatenate(rows))), *([pa.array((key // 256).astype(np.int32))] if block else []), pa.array(hexes[key % 256]), pa.array(np.concatenate(counts))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    counted = df.select(ident, F.col(data).cast("binary").alias("__data")).mapInArrow(run, schema)
    return counted.groupBy(*[f.name for f in fields[:-1]]).agg(F.sum("n").alias("n"))


def entropy(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_bytes, entropy): Shannon bits a byte, from sums of n and n log2 n."""
    per = counts.groupBy(*keys).agg(F.sum("n").alias("n_bytes"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("__s"))
    return per.select(*keys, "n_bytes", F.round(F.log2(F.col("n_bytes").cast("double")) - F.col("__s") / F.col("n_bytes"), 6).alias("entropy"))


def select_dimension(share: Column, curve: str = "linear") -> Column:
    """Dimensions for an entropy share in [0, 1]: the floor up to LOW, the ceiling from HIGH, between them by the curve."""
    x = (share - LOW) / (HIGH - LOW)
    span = CEILING - FLOOR
    between = {
        "linear": FLOOR + x * span,
        "logarithmic": FLOOR + F.log2(1 + x) * span,
        "stepped": FLOOR + F.floor(x * 4) / 4 * span,
    }[curve]
    return F.when(share <= LOW, FLOOR).when(share >= HIGH, CEILING).otherwise(F.round(between)).cast("bigint")


def outlier_regions(per_block: DataFrame, ident: str, threshold: float) -> DataFrame:
    """(ident, first_block, last_block): maximal runs of blocks at or above the entropy, by gaps and islands."""
    high = per_block.where(F.col("entropy") >= threshold)
    island = F.col("block") - F.row_number().over(Window.partitionBy(ident).orderBy("block"))
    return high.withColumn("__g", island).groupBy(ident, "__g").agg(F.min("block").alias("first_block"), F.max("block").alias("last_block")).drop("__g")


#: Bytes whose counts are dense at once, and bytes of an id's rows that are kept before they become counts.
PIECE, KEPT = 1 << 16, 1 << 26


def outlier_regions_of(df: DataFrame, ident: str, data: str, block: int, threshold: float) -> DataFrame:
    """What :func:`outlier_regions` gives of the entropy of :func:`byte_counts` by ``block`` bytes, without a row a count.

    Rows are brought together by id, whole, as bytes of equal ids add up; blocks are counted and runs found in the task.
    """
    ship(df.sparkSession)
    schema = T.StructType([T.StructField(ident, df.schema[ident].dataType), T.StructField("first_block", T.IntegerType()), T.StructField("last_block", T.IntegerType())])
    arrow, piece, kept = to_arrow_schema(schema), max(1, PIECE // block) * block, KEPT
    rows = df.select(ident, F.col(data).cast("binary").alias("__data")).repartition(ident).sortWithinPartitions(ident)

    def run(batches):
        held, size, keys, counts, last = [], 0, np.zeros(0, np.int64), np.zeros(0, np.int64), None

        def folded():
            """Turns the rows kept into counts by block and byte."""
            nonlocal held, size, keys, counts
            more = [np.frombuffer(x, np.uint8) + np.arange(len(x)) // block * 256 for x in held]
            n = np.concatenate([counts, np.ones(sum(map(len, more)), np.int64)])
            keys, where = np.unique(np.concatenate([keys, *more]), return_inverse=True)
            counts, held, size = np.bincount(where, n, len(keys)).astype(np.int64), [], 0

        def found():
            longest = max([*map(len, held), (int(keys[-1]) // 256 + 1) * block if len(keys) else 0], default=0)
            high = []
            for at in range(0, longest, piece):
                first = at // block
                n = np.zeros(piece // block * 256, np.int64)
                for x in held:
                    cut = np.frombuffer(x[at : at + piece], np.uint8)
                    n += np.bincount(cut + np.arange(len(cut)) // block * 256, minlength=len(n))
                a, b = np.searchsorted(keys, (first * 256, first * 256 + len(n)))
                n[keys[a:b] - first * 256] += counts[a:b]
                n = n.reshape(-1, 256)
                total = n.sum(1)
                used = np.flatnonzero(total)
                n, total = n[used], total[used].astype(float)
                bits = np.log2(total) - (n * np.log2(np.maximum(n, 1))).sum(1) / total
                high.append(used[np.floor(bits * 1e6 + 0.5) / 1e6 >= threshold] + first)
            high = np.concatenate([np.zeros(0, np.int64), *high])
            starts = np.flatnonzero(np.r_[True, np.diff(high) > 1]) if len(high) else high
            return high[starts], high[np.r_[starts[1:], len(high)] - 1] if len(high) else high

        def emitted():
            first, end = found()
            if len(first):
                yield pa.RecordBatch.from_arrays([pa.array([last] * len(first), arrow.field(0).type), pa.array(first, pa.int32()), pa.array(end, pa.int32())], schema=arrow)

        for batch in batches:
            for ident_, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ident_ != last:
                    yield from emitted()
                    held, size, keys, counts, last = [], 0, keys[:0], counts[:0], ident_
                if raw:
                    held.append(raw)
                    size += len(raw)
                    if size > kept and len(held) > 1:
                        folded()
        yield from emitted()

    return rows.mapInArrow(run, schema)


def ngram_counts(df: DataFrame, text: str, n: int, least: int = 1) -> DataFrame:
    """(gram, n): n-grams of words (split at spaces) over all rows, counted with map-side combination."""
    words = df.select(F.filter(F.split(text, " "), lambda w: w != "").alias("w"))
    grams = F.expr("w") if n == 1 else F.expr("slice(w, 1, greatest(0, size(w) - " + str(n - 1) + "))")
    for k in range(1, n):
        grams = F.zip_with(grams, F.expr(f"slice(w, {k + 1}, greatest(0, size(w) - {n - 1}))"), lambda x, y: F.concat_ws(" ", x, y))
    # An outer generator: others get a filter that works the array out a second time.
    rows = words.select(F.explode_outer(grams).alias("gram")).where("gram is not null")
    return rows.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= least)
