"""Writers: engrams with manifests, extracted files, reports in JSON and Prometheus text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODECS = ("zstd", "lz4", "snappy", "gzip", "none")
#: Codec of each compression profile, and its level where it has one.
PROFILE_CODECS = {"kernel": ("zstd", 19), "libraries": ("zstd", 9), "binaries": ("zstd", 6), "config": ("lz4", None), "logs": ("zstd", 3), "runtime": ("none", None), "default": ("zstd", 6)}


def parquet_options(codec: str, level: int | None = None) -> dict[str, str]:
    """Options of a Parquet writer for a codec of ``CODECS``; levels are for zstd only."""
    if codec not in CODECS:
        raise ValueError(f"unknown codec {codec}")
    if level is not None and codec != "zstd":
        raise ValueError(f"{codec} has no levels")
    options = {"compression": codec.replace("lz4", "lz4_raw")}
    return options if level is None else options | {"parquet.compression.codec.zstd.level": str(level)}


def save_engram(trits: DataFrame, manifest: DataFrame, path: str, codec: str = "zstd", dry_run: bool = False, level: int | None = None) -> str:
    """Writes trits ordered by dim, so probes prune row groups, and the manifest as JSON lines.

    A dry run returns the plan and writes nothing.
    """
    options = parquet_options(codec, level)
    ordered = trits.repartitionByRange("dim").sortWithinPartitions("dim")
    if dry_run:
        return ordered._jdf.queryExecution().simpleString()
    ordered.write.mode("overwrite").options(**options).parquet(f"{path}/engram")
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return path


def save_by_profile(rows: DataFrame, profile: str, path: str) -> None:
    """One table for each compression profile, with the profile's codec and level."""
    for name, (codec, level) in PROFILE_CODECS.items():
        rows.where(F.col(profile) == name).drop(profile).write.mode("overwrite").options(**parquet_options(codec, level)).parquet(f"{path}/profile={name}")


def manifest_json(manifest: DataFrame, root: str, created: str) -> DataFrame:
    """One row, one column ``value``: the manifest document with a map of folders and sums over them.

    Sums are made from the folders, so writing the same folder again doesn't count it twice. manifest: directory,
    encoded_at, file_count, original_bytes, encoded_bytes; one entry for each folder, so the document has their number.
    """
    entry = F.struct("encoded_at", "file_count", "original_bytes", "encoded_bytes")
    whole = manifest.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("directory", entry.alias("e"))))).alias("directories"), F.sum("file_count").alias("f"), F.sum("original_bytes").alias("o"), F.sum("encoded_bytes").alias("c"), F.count("*").alias("n"))
    stats = F.struct(F.col("f").alias("total_files"), F.col("o").alias("total_bytes_original"), F.col("c").alias("total_bytes_encoded"), F.col("n").alias("directories_encoded"))
    return whole.select(F.to_json(F.struct(F.lit("1.0").alias("version"), F.lit(created).alias("created"), F.lit(root).alias("root_path"), "directories", stats.alias("stats"))).alias("value"))


def extract_files(files: DataFrame, path: str) -> None:
    """Writes (name, content) rows as a table of whole files, one Parquet row each; see :func:`write_files` for plain files."""
    files.select("name", "content").write.mode("overwrite").parquet(path)


def write_files(files: DataFrame, path: str, name: str = "name", content: str = "content") -> DataFrame:
    """Writes each row as a file below a folder of a store that Spark reaches as a file system; (name, size) of those written.

    For paths that executors mount; elsewhere use :func:`extract_files`.
    """

    def run(batches):
        import os

        import pyarrow as pa

        for batch in batches:
            sizes = []
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = os.path.normpath(os.path.join(path, n.lstrip("/")))
                if not target.startswith(os.path.normpath(path) + os.sep):
                    raise ValueError(f"{n} lies outside the folder")
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(f"{target}.part", "wb") as out:
                    out.write(data or b"")
                os.replace(f"{target}.part", target)  # whole or not at all, also when a task runs again
                sizes.append(len(data or b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["name", "size"])

    return files.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content")).mapInArrow(run, "name string, size bigint")


def telemetry(metrics: DataFrame) -> DataFrame:
    """Each row as a JSON document in ``value``."""
    return metrics.select(F.to_json(F.struct("*")).alias("value"))


def write_prometheus(lines: DataFrame, path: str) -> None:
    """lines: name, line. Samples in text exposition format, ordered by name."""
    lines.orderBy("name", "line").select("line").write.mode("overwrite").text(path)
