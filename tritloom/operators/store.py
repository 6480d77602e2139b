"""The engram store: manifests, versions, updates, compaction, verification, skipping, priorities and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Encoding priority by path prefix (lower first) and the default.
PRIORITIES = [
    ("/usr/share", 10), ("/usr/lib", 20), ("/lib", 25), ("/etc", 30), ("/var/lib", 40), ("/opt", 50), ("/usr/bin", 60),
    ("/usr/sbin", 65), ("/bin", 70), ("/sbin", 75), ("/home", 80), ("/var/log", 90), ("/var/cache", 100),
]
DEFAULT_PRIORITY = 50
#: Compression profile by path prefix and the default.
PROFILES = [
    ("/boot", "kernel"), ("/lib/modules", "kernel"), ("/usr/lib", "libraries"), ("/lib", "libraries"), ("/usr/bin", "binaries"), ("/usr/sbin", "binaries"),
    ("/bin", "binaries"), ("/sbin", "binaries"), ("/etc", "config"), ("/var/log", "logs"), ("/tmp", "runtime"), ("/var/cache", "runtime"), ("/usr/share", "default"), ("/home", "default"),
]
DEFAULT_PROFILE = "default"


def manifest(files: DataFrame, path: str, size: Column, chunk: int) -> DataFrame:
    """(path, size, chunk_size, n_chunks, deleted, version) of new files."""
    return files.select(F.col(path).alias("path"), size.cast("bigint").alias("size"), F.lit(chunk).alias("chunk_size"), F.ceil(size / chunk).cast("bigint").alias("n_chunks"), F.lit(False).alias("deleted"), F.lit(1).alias("version"))


def upserted(current: DataFrame, changes: DataFrame, key: str = "path") -> DataFrame:
    """Latest version of each key over both; a change of an equal version wins."""
    both = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    latest = Window.partitionBy(key).orderBy(F.desc("version"), F.desc("__new"))
    return both.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n", "__new")


def applied(current: DataFrame, changes: DataFrame, key: str = "path") -> DataFrame:
    """Optimistic update: a change counts only if its ``expected`` version is the current one (0 for a new key)."""
    now = current.select(key, F.col("version").alias("__v"))
    fits = changes.join(now, key, "left").where(F.col("expected") == F.coalesce("__v", F.lit(0)))
    return upserted(current, fits.withColumn("version", F.col("expected") + 1).select(*current.columns), key)


def rejected(current: DataFrame, changes: DataFrame, key: str = "path") -> DataFrame:
    """The changes that :func:`applied` leaves out, with the version that was found."""
    now = current.select(key, F.coalesce(F.col("version"), F.lit(0)).alias("found"))
    return changes.join(now, key, "left").withColumn("found", F.coalesce("found", F.lit(0))).where("expected <> found")


def removed(current: DataFrame, paths: DataFrame, key: str = "path") -> DataFrame:
    """Soft removal: flags, and a new version."""
    gone = paths.select(key).distinct().withColumn("__gone", F.lit(True))
    flagged = current.join(gone, key, "left").withColumn("version", F.col("version") + F.when(F.col("__gone"), 1).otherwise(0))
    return flagged.withColumn("deleted", F.col("deleted") | F.coalesce("__gone", F.lit(False))).select(*current.columns)


def live(current: DataFrame) -> DataFrame:
    return current.where(~F.col("deleted"))


def compacted(engrams: DataFrame, current: DataFrame, ident: str) -> tuple[DataFrame, DataFrame]:
    """(root votes rebuilt from live files, statistics): what removal leaves behind goes."""
    kept = engrams.join(live(current).select(ident), ident, "left_semi")
    root = kept.groupBy("dim").agg(F.sum("trit").cast("bigint").alias("votes"))
    stats = current.agg(F.count_if(F.col("deleted")).alias("removed_files"), F.count_if(~F.col("deleted")).alias("live_files"), F.sum(F.when(F.col("deleted"), F.col("size")).otherwise(0)).cast("bigint").alias("reclaimed_bytes"))
    return root, stats


#: Prefix tables of at most so many rows become a map in the plan.
PREFIXES = 200


def longest_prefix(paths: DataFrame, prefixes: DataFrame, path: str, prefix: str, value: str, default: object) -> DataFrame:
    """Adds ``value``: that of the longest prefix that the path has as whole leading components, else ``default``.

    Candidate prefixes of a path are its own leading parts. Up to ``PREFIXES`` prefixes are looked up in the row, without
    any join; more are joined by equality with the parts.
    """
    few = prefixes.select(prefix, value).limit(PREFIXES + 1).collect()
    if few and len(few) <= PREFIXES:
        known = F.create_map(*[F.lit(x) for r in few for x in (r[0], r[1])])
        parts = F.split(F.col(path), "/")
        leading = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
        found = F.filter(F.transform(leading, lambda p: known[p]), lambda v: v.isNotNull())
        return paths.withColumn(value, F.coalesce(F.get(found, F.size(found) - 1), F.lit(default)))
    known = prefixes.select(F.col(prefix).alias("__p"), F.col(value).alias("__v"))
    rows = paths.select(F.col(path).alias("__path")).distinct().select("__path", F.explode(F.expr("transform(sequence(1, size(split(__path, '/'))), n -> array_join(slice(split(__path, '/'), 1, n), '/'))")).alias("__p"))
    best = rows.join(known, "__p").groupBy("__path").agg(F.max_by("__v", F.length("__p")).alias(value))
    joined = paths.join(best, F.col(path) == F.col("__path"), "left").drop("__path")
    return joined.withColumn(value, F.coalesce(value, F.lit(default)))


def priorities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRIORITIES, "prefix string, priority int")


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, "prefix string, profile string")


def encoding_plan(paths: DataFrame, path: str = "path") -> DataFrame:
    """Paths with priority and profile, numbered in encoding order (ties by path)."""
    spark = paths.sparkSession
    planned = longest_prefix(longest_prefix(paths, priorities(spark), path, "prefix", "priority", DEFAULT_PRIORITY), profiles(spark), path, "prefix", "profile", DEFAULT_PROFILE)
    return planned.orderBy("priority", path)


def stale(sources: DataFrame, engrams: DataFrame, key: str = "path") -> DataFrame:
    """Sources to encode: without an engram, or whose engram is not strictly newer (equal times are encoded again)."""
    done = engrams.select(key, F.col("mtime").alias("__e"))
    return sources.join(done, key, "left").where(F.col("__e").isNull() | (F.col("__e") <= F.col("mtime"))).drop("__e")


def systematic_sample(df: DataFrame, order: list[str], every: int, digits: int = 3) -> DataFrame:
    """Each ``every``-th row in the total order of the MD5 of ``order``, then ``order`` itself, nulls first.

    Rows are numbered within parts by the first ``digits`` hexadecimal digits of the MD5, which follow the same order;
    part offsets come from the part counts, 16 ** digits rows at most. Rows that agree in all of ``order`` share a part.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order]
    rows = df.withColumn("__md5", F.md5(F.concat_ws("|", *named))).withColumn("__part", F.substring("__md5", 1, digits))
    nth = F.row_number().over(Window.partitionBy("__part").orderBy("__md5", *order))
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__size"))
    offset = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", offset.alias("__offset"))
    numbered = rows.withColumn("__nth", nth).join(F.broadcast(offsets), "__part")  # 16 ** digits rows at most
    return numbered.where((F.col("__nth") + F.col("__offset")) % every == 0).drop("__md5", "__part", "__nth", "__offset")


def verified(original: DataFrame, extracted: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status): ok, differs, missing (not extracted) or unexpected."""
    o = original.select(key, F.col(digest).alias("__o"), F.lit(True).alias("__in_o"))
    e = extracted.select(key, F.col(digest).alias("__e"), F.lit(True).alias("__in_e"))
    status = F.when(F.col("__in_e").isNull(), "missing").when(F.col("__in_o").isNull(), "unexpected").when(F.col("__o").eqNullSafe(F.col("__e")), "ok").otherwise("differs")
    return o.join(e, key, "full").select(key, status.alias("status"))


def fsck(current: DataFrame, engrams: DataFrame, ident: str = "path") -> DataFrame:
    """(ident, problem) of live files: no_engram, chunks_missing, chunks_beyond_end; and orphan for engrams of no live file.

    engrams: ident, chunk_no and more; empty files need no engram.
    """
    held = engrams.groupBy(ident).agg(F.countDistinct("chunk_no").alias("__n"), F.max("chunk_no").alias("__last"))
    both = live(current).select(ident, "n_chunks").join(held, ident, "full")
    problem = (
        F.when(F.col("n_chunks").isNull(), "orphan")
        .when(F.col("__n").isNull() & (F.col("n_chunks") > 0), "no_engram")
        .when(F.col("__last") >= F.col("n_chunks"), "chunks_beyond_end")
        .when(F.col("__n") < F.col("n_chunks"), "chunks_missing")
    )
    return both.select(ident, problem.alias("problem")).where("problem is not null")
