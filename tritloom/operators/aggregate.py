"""Aggregates of reports: ratios, rollups, percentiles, histograms, counters and retrieval quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compression_ratio(encoded: Column, original: Column) -> Column:
    """Encoded over original in percent, cut (not rounded) to two places; 'N/A' where either is zero."""
    cents = F.floor(encoded * 10000 / original)
    text = F.format_string("%d.%02d", F.floor(cents / 100), F.pmod(cents, F.lit(100)))
    return F.when((encoded == 0) | (original == 0), "N/A").otherwise(text)


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, mean, population standard deviation, median, p95 and p99, exact and interpolated."""
    v = F.col(value)
    exact = [F.round(F.percentile(v, F.lit(p)), 6).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))]
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("stddev"), *exact)


def histogram(df: DataFrame, value: str, low: float, high: float, buckets: int) -> DataFrame:
    """(bucket, n): 0 below ``low``, buckets + 1 at or above ``high``."""
    bucket = F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(buckets))
    return df.where(F.col(value).isNotNull()).groupBy(bucket.cast("bigint").alias("bucket")).agg(F.count("*").alias("n"))


def counters(df: DataFrame, keys: list[str], value: str, time: str) -> DataFrame:
    """Counter (sum of one), gauge (latest value; ties to the larger) and peak of each key."""
    latest = F.max(F.struct(F.col(time), F.col(value)))[value]
    return df.groupBy(*keys).agg(F.count("*").alias("counter"), latest.alias("gauge"), F.max(value).alias("peak"))


def directory_rollup(files: DataFrame, levels: list[str], size: str) -> DataFrame:
    """Counts and bytes for every level of a hierarchy, and in all; n_grouped is how many levels a row still has."""
    gid = F.lit(len(levels)) - sum((F.grouping(x) for x in levels), F.lit(0))
    return files.rollup(*levels).agg(gid.cast("bigint").alias("n_grouped"), F.count("*").alias("files"), F.sum(size).alias("bytes"))


def retrieval_quality(ranked: DataFrame, labels: DataFrame, key: str, k: int) -> DataFrame:
    """Per query: hits among the first k, recall and NDCG at k; relevant are other rows of the query's label."""
    q = labels.select(F.col(key).alias("query_id"), F.col("label").alias("ql"))
    v = labels.select(key, F.col("label").alias("vl"))
    total = labels.groupBy("label").agg((F.count("*") - 1).alias("n"))
    rel = ranked.join(q, "query_id").join(v, key).join(total, F.col("ql") == F.col("label"))
    rel = rel.select("query_id", "rank", "n", F.when(F.col("ql") == F.col("vl"), 1).otherwise(0).alias("rel"))
    gain = F.col("rel") / (F.ln(F.col("rank") + 1) / F.ln(F.lit(2.0)))
    best = F.expr(f"aggregate(sequence(1, {k}), cast(0 as double), (s, i) -> s + if(i <= n, 1 / (ln(i + 1) / ln(2)), 0))")
    per = rel.groupBy("query_id").agg(F.sum("rel").cast("bigint").alias("hits"), F.first("n").alias("n"), F.sum(gain).alias("dcg"))
    return per.select("query_id", "hits", F.round(F.col("hits") / F.col("n"), 6).alias("recall"), F.round(F.col("dcg") / best, 6).alias("ndcg"))
