"""Factorisation of bound vectors, and a basis from data by principal components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written


def factorise(bound: DataFrame, first: DataFrame, second: DataFrame, key: str, rounds: int = 10) -> DataFrame:
    """The two codebook ids whose binding is nearest to each row of ``bound``: (key, first_id, second_id, score).

    bound: key, dim, trit; first and second: id, dim, trit. A resonator: starting from all of ``second`` superposed,
    the estimate of one factor is the vector unbound by the other's estimate, cleaned up against its codebook, in
    turns. The number of rounds is fixed, so the plan is; a score is the agreement of the last clean-up. Ties go to the
    smaller id.
    """

    def cleaned(estimate: DataFrame, book: DataFrame) -> DataFrame:
        scores = bound.join(estimate.select(key, "dim", F.col("trit").alias("e")), [key, "dim"]).select(key, "dim", (F.col("trit") * F.col("e")).alias("u"))
        scores = scores.join(book, "dim").groupBy(key, "id").agg(F.sum(F.col("u") * F.col("trit")).cast("bigint").alias("score"))
        best = scores.groupBy(key).agg(F.max(F.struct("score", (-F.col("id")).alias("n"))).alias("m"))
        return best.select(key, (-F.col("m.n")).cast("int").alias("id"), F.col("m.score").alias("score"))

    def vector(found: DataFrame, book: DataFrame) -> DataFrame:
        return found.select(key, "id").join(book, "id").select(key, "dim", "trit")

    keys = bound.select(key).distinct()
    whole = second.groupBy("dim").agg(F.signum(F.sum("trit")).cast("int").alias("trit")).where("trit <> 0")
    estimate = keys.join(F.broadcast(whole))  # a codebook's superposition has at most dims rows
    a = b = None
    for k in range(rounds):
        a = cleaned(estimate, first)
        b = cleaned(vector(a, first), second)
        if k + 1 < rounds:
            b, _ = written(b, "resonator")
            estimate = vector(b, second)
    return a.select(key, F.col("id").alias("first_id")).join(b.select(key, F.col("id").alias("second_id"), "score"), key)


def principal_basis(vectors: DataFrame, column: str, size: int) -> DataFrame:
    """(id, dim, weight) of the leading principal directions of an array column.

    The covariance is summed over the rows by key (dim, dim), so only its dims**2 entries come to the driver.
    """
    import numpy as np

    x = vectors.select(F.transform(column, lambda v: v.cast("double")).alias("x")).where("x is not null and size(x) > 0")
    pairs = x.select(F.posexplode("x").alias("i", "a"), "x").select("i", "a", F.posexplode("x").alias("j", "b")).where("j >= i")
    sums = pairs.groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("s"), F.sum("a").alias("sa"), F.count("*").alias("n")).collect()
    dims = max((r["j"] for r in sums), default=-1) + 1
    second, mean = np.zeros((dims, dims)), np.zeros(dims)
    for r in sums:
        second[r["i"], r["j"]] = second[r["j"], r["i"]] = r["s"] / r["n"]
        if r["i"] == r["j"]:
            mean[r["i"]] = r["sa"] / r["n"]
    _, axes = np.linalg.eigh(second - np.outer(mean, mean)) if dims else (None, np.zeros((0, 0)))
    rows = []
    for k in range(min(size, dims)):
        axis = axes[:, -1 - k]
        axis = axis * (1 if axis[np.argmax(np.abs(axis))] > 0 else -1)
        rows += [(k, d, float(axis[d])) for d in range(dims)]
    return vectors.sparkSession.createDataFrame(rows, "id int, dim int, weight double")
