"""The folder that driver and executors share, and tables in it that cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; one is set here only for a master in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        set_by_context = context._jsc.sc().getCheckpointDir()
        if set_by_context.isDefined():
            found = set_by_context.get()
        elif context.master == "local" or context.master.startswith("local["):
            found = f"file://{tempfile.mkdtemp(prefix='tritloom-')}"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Tables of :func:`written` that are not removed yet, in order.
_made: list[str] = []


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tritloom/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes tables made by :func:`written` that no later read needs."""
    jvm = spark._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
        if path in _made:
            _made.remove(path)


class Scratch:
    """Within it, tables made by :func:`written` are temporary: they go at the end, but for those that ``keep`` names.

    What is returned lazily from inside must have been written, and kept, before the end.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.kept = spark, set()

    def __enter__(self) -> Scratch:
        self.before = set(_made)
        return self

    def keep(self, path: str) -> None:
        self.kept.add(path)

    def __exit__(self, *_) -> None:
        removed(self.spark, *[x for x in _made if x not in self.before and x not in self.kept])


def spread(df: DataFrame) -> DataFrame:
    """A table that the scan cuts into fewer parts than there are cores is dealt evenly over the cores.

    A table of at least as many files as cores, none of them over twice its share, is evenly cut as it is.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() and not _even(df, cores) else df


#: Bytes of files, about, that a part of :func:`cut` holds at most.
PART = 16 << 20


def cut(df: DataFrame, *columns: str) -> DataFrame:
    """Columns of a table, as by :func:`spread`; a larger table is dealt over parts of about ``PART`` bytes, so a task's share doesn't grow."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = -(-size // PART)
    return df.select(*columns).repartition(parts) if parts > df.sparkSession.sparkContext.defaultParallelism else spread(df).select(*columns)


def _even(df: DataFrame, cores: int) -> bool:
    files = df.inputFiles()
    if len(files) < cores:
        return False
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    folders: dict[str, object] = {}
    for f in files:
        folders.setdefault(f.rsplit("/", 1)[0], at(f).getParent())
    sizes = {x.getPath().toString(): x.getLen() for p in folders.values() for x in p.getFileSystem(conf).listStatus(p)}
    return max(sizes.values()) * cores <= 2 * sum(sizes.values())


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of the session's executors, once an application.

    Workers import the functions they run; wherever they were started, the package need not be on their path.
    """
    context = spark.sparkContext
    package = Path(__file__).parent
    if context.applicationId in _shipped or not package.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="tritloom-")) / "tritloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, str(path.relative_to(package.parent)))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
