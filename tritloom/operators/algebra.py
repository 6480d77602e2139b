"""Algebra of sparse ternary vectors in long form: rows (key columns..., dim INT, trit INT), zeros not stored.

Every operator is a DataFrame expression: element-wise products are equi-joins on ``dim``, superposition is an integer
sum with map-side combination, and the sign is taken once, at the end. Votes (sums before the sign) stay exact, so
members can be added or taken out later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sign_of(x: Column) -> Column:
    return F.when(x > 0, 1).when(x < 0, -1).otherwise(0).cast("int")


def ternary(x: Column, threshold: float = 0.0) -> Column:
    """Projects a number to -1, 0 or 1; nulls and NaN to 0."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x), 0).when(x > threshold, 1).when(x < -threshold, -1).otherwise(0).cast("int")


def from_arrays(df: DataFrame, key: str, values: str, threshold: float = 0.0) -> DataFrame:
    """Long trits (key, dim, trit) of an array column; zero trits are dropped."""
    rows = df.select(F.col(key), F.posexplode(values).alias("dim", "x"))
    return rows.select(key, F.col("dim").cast("int").alias("dim"), ternary(F.col("x"), threshold).alias("trit")).where("trit <> 0")


def absmean(values: str | Column) -> Column:
    """Ternary quantisation of an array: each value over the mean absolute value, rounded and clamped to [-1, 1]."""
    x = F.transform(F.col(values) if isinstance(values, str) else values, lambda v: v.cast("double"))
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + F.abs(v)) / F.size(x)
    return F.transform(x, lambda v: F.when((mean > 0) & (F.abs(v) >= 0.5 * mean), F.signum(v)).otherwise(0.0).cast("int"))


def bind(a: DataFrame, b: DataFrame, keys: list[str] | None = None, how_key: list[str] | None = None) -> DataFrame:
    """Element-wise product. ``keys``: columns kept of ``a``; ``how_key``: columns beside dim that must agree."""
    on = ["dim", *(how_key or [])]
    right = b.select(*on, F.col("trit").alias("__t"))
    kept = keys or [c for c in a.columns if c not in ("dim", "trit")]
    return a.join(right, on).select(*kept, "dim", (F.col("trit") * F.col("__t")).cast("int").alias("trit"))


def unbind(a: DataFrame, b: DataFrame, keys: list[str] | None = None, how_key: list[str] | None = None) -> DataFrame:
    """Binding is its own inverse on the support of ``b``."""
    return bind(a, b, keys, how_key)


def votes(trits: DataFrame, keys: list[str]) -> DataFrame:
    """Integer sums by key and dim, zero sums included: what a superposition holds before its sign is taken."""
    return trits.groupBy(*keys, "dim").agg(F.sum("trit").cast("bigint").alias("votes"))


def signed(counted: DataFrame) -> DataFrame:
    """Trits of votes; ties fall to zero and are dropped."""
    kept = [c for c in counted.columns if c != "votes"]
    return counted.select(*kept, sign_of(F.col("votes")).alias("trit")).where("trit <> 0")


def bundle_many(trits: DataFrame, keys: list[str]) -> DataFrame:
    return signed(votes(trits, keys))


def bundle(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Pairwise superposition by key."""
    return bundle_many(a.select(*keys, "dim", "trit").unionByName(b.select(*keys, "dim", "trit")), keys)


def bundle_arrays(df: DataFrame, key: str, values: str, group: str, members: DataFrame, threshold: float = 0.0) -> DataFrame:
    """As :func:`bundle` of each key's projected array with the vector of its group in ``members`` (group, dim, trit).

    The rows of a key are brought together whole and added up in one row, so no task holds a sum for each dim of many
    keys. ``members`` has few groups (a row a class) and is broadcast.
    """
    own = F.transform(values, lambda x: ternary(x, threshold))
    by_dim = members.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("dim", "trit"))).alias("__m"))
    rows = df.select(key, group, own.alias("__t")).join(F.broadcast(by_dim), group, "left").select(key, F.struct("__t", "__m").alias("__r"))
    rows = rows.groupBy(key).agg(F.collect_list("__r").alias("__r"))
    size = F.greatest(F.array_max(F.transform("__r", lambda r: F.coalesce(F.size(r["__t"]), F.lit(0)))), F.coalesce(F.array_max(F.flatten(F.transform("__r", lambda r: F.map_keys(F.coalesce(r["__m"], F.create_map().cast("map<int,int>")))))) + 1, F.lit(0)))
    rows = rows.select(key, "__r", size.alias("__n")).where("__n > 0")
    dims = rows.select(key, "__r", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("dim"))
    total = F.aggregate("__r", F.lit(0), lambda s, r: s + F.coalesce(F.get(r["__t"], F.col("dim")), F.lit(0)) + F.coalesce(F.try_element_at(r["__m"], F.col("dim")), F.lit(0)))
    return dims.select(key, "dim", sign_of(total).alias("trit")).where("trit <> 0")


def unbundle(counted: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Votes without the votes of ``members``; exact, unlike removal from signs."""
    taken = members.select(*keys, "dim", (-F.col("trit")).cast("bigint").alias("votes"))
    return counted.select(*keys, "dim", "votes").unionByName(taken).groupBy(*keys, "dim").agg(F.sum("votes").cast("bigint").alias("votes"))


def permute(trits: DataFrame, shift: int | Column, dims: int) -> DataFrame:
    """Cyclic shift of dimensions."""
    by = F.lit(shift) if isinstance(shift, int) else shift
    return trits.withColumn("dim", F.pmod(F.col("dim") + by, F.lit(dims)).cast("int"))


def thin(counted: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """At most ``cap`` dims of each key: the strongest votes, ties to the smaller dim."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.abs("votes")), "dim")
    kept = counted.where("votes <> 0").withColumn("__n", F.row_number().over(order))
    return kept.where(F.col("__n") <= cap).drop("__n")


def conflicts(trits: DataFrame, keys: list[str]) -> DataFrame:
    """(key, dim) that occur more than once, with how many positive and negative entries: empty for valid vectors."""
    counted = trits.groupBy(*keys, "dim").agg(F.count_if(F.col("trit") > 0).alias("n_pos"), F.count_if(F.col("trit") < 0).alias("n_neg"))
    return counted.where("n_pos + n_neg > 1")


def resolved(trits: DataFrame, keys: list[str]) -> DataFrame:
    """Valid vectors: doubled entries become the sign of their sum."""
    return bundle_many(trits, keys)


def nnz(trits: DataFrame, keys: list[str], dims: int) -> DataFrame:
    counted = trits.groupBy(*keys).agg(F.count("*").alias("nnz"), F.count_if(F.col("trit") > 0).alias("n_pos"))
    return counted.withColumn("density", F.round(F.col("nnz") / dims, 6))


OPERATIONS = {
    "add": lambda a, b: sign_of(a + b),
    "sub": lambda a, b: sign_of(a - b),
    "and": lambda a, b: F.least(a, b),
    "or": lambda a, b: F.greatest(a, b),
    "xor": lambda a, b: -a * b,
    "eq": lambda a, b: F.when(a == b, 1).otherwise(0),
}


def register_operation(name: str, operation) -> None:
    """Adds an operation of two trit columns to those of :func:`compute`; zero for two zeros, as those aren't stored."""
    if name in OPERATIONS:
        raise ValueError(f"{name} is defined already")
    OPERATIONS[name] = operation


def compute(a: DataFrame, b: DataFrame, operation: str, key: str, dims: int) -> DataFrame:
    """Ternary logic and arithmetic between equal keys; absent dims are zeros. Kleene's min and max for and/or.

    Each side may lack a dim, so the join is a full outer one; operations that make something of two zeros
    (``eq``) are not stored for those.
    """
    left, right = a.select(key, "dim", F.col("trit").alias("__a")), b.select(key, "dim", F.col("trit").alias("__b"))
    both = left.join(right, [key, "dim"], "full").na.fill(0, ["__a", "__b"])
    return both.select(key, "dim", OPERATIONS[operation](F.col("__a"), F.col("__b")).cast("int").alias("trit")).where("trit <> 0")


def support(a: DataFrame, b: DataFrame, key: str, how: str) -> DataFrame:
    """(key, dim) of the union, intersection or difference of supports."""
    left, right = a.select(key, "dim"), b.select(key, "dim")
    return {"union": left.union(right).distinct, "intersection": lambda: left.intersect(right), "difference": lambda: left.join(right, [key, "dim"], "left_anti").distinct()}[how]()


def matmul(trits: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """Ternary matrix product: weights (out, dim, trit); sums of signs, no multiplications but by -1 and 1."""
    joined = trits.join(weights.select("out", "dim", F.col("trit").alias("__w")), "dim")
    return joined.groupBy(key, "out").agg(F.sum(F.col("trit") * F.col("__w")).cast("bigint").alias("value"))
