"""One-call work on a folder of files: encode it into a saved workspace, give its files back, search it by text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks, sources
from .operators import algebra as A
from .operators import codebook as C
from .operators import similarity as S
from .operators import store as M
from .shared import written


def ingest(spark: SparkSession, folder: str, path: str, codec: str = "zstd", pattern: str | None = None) -> DataFrame:
    """Encodes all files below ``folder``, or those that fit ``pattern``, into ``path``, and returns the manifest.

    A workspace holds the chunk engrams and the manifest (with checksums and the number of trits of each file), the file
    engrams ordered by dim, so that searches read the dims they ask for only, and the corrections that make decoding exact.
    Spark's file reader passes over empty files, so a workspace doesn't hold them.
    """
    return ingest_files(sources.directory(spark, folder, pattern), path, codec)


def ingest_files(files: DataFrame, path: str, codec: str = "zstd", level: int | None = None) -> DataFrame:
    """:func:`ingest` of rows (path, size, content) from anywhere; rows of equal paths are one file each and must not occur."""
    spark = files.sparkSession
    codes = C.bound_codes(spark)
    chunks, _ = written(C.encode_files(files, codes, "path", "content"), "chunks")
    whole, _ = written(A.bundle_many(chunks, ["path"]), "files")
    nnz = whole.groupBy("path").agg(F.count("*").alias("nnz"))
    manifest = M.manifest(files, "path", F.col("size"), codes.chunk).join(files.select("path", F.sha2("content", 256).alias("sha256")), "path").join(nnz, "path", "left")
    C.corrections(C.compared_files(files, codes, "path", "content"), "path").write.mode("overwrite").parquet(f"{path}/corrections")
    S.write_index(whole, f"{path}/files")
    sinks.save_engram(chunks, manifest, path, codec, level=level)
    return sources.load_engram(spark, path)[1]


def extract(spark: SparkSession, path: str, only: DataFrame | None = None) -> DataFrame:
    """(path, content, intact) of every live file of a workspace, or of those whose path ``only`` holds: decoded,
    corrected and held against its checksum."""
    chunks, manifest = sources.load_engram(spark, path)
    kept = M.live(manifest).select("path", "size", "sha256")
    kept = kept.join(only.select("path"), "path", "left_semi") if only is not None else kept
    decoded = C.decode_chunks(chunks.join(kept.select("path"), "path", "left_semi"), C.bound_codebook(spark), "path")
    made = C.reconstruct(decoded, spark.read.parquet(f"{path}/corrections"), kept.select("path", "size"), "path")
    both = kept.join(made, "path", "left").select("path", "sha256", F.unhex(F.coalesce("hex", F.lit(""))).alias("content"))
    return both.select("path", "content", (F.sha2("content", 256) == F.col("sha256")).alias("intact"))


def ingest_progressive(files: DataFrame, path: str) -> list[tuple[int, str, str]]:
    """Encodes files (path, size, content) level by level, the lowest priority first, each profile with its own codec.

    A level and profile whose saved checksums are those of the files is passed over, so a run that was broken off goes on
    where it ended. Returns (priority, profile, saved or kept) in order of work; each has a workspace of its own,
    ``path``/priority/profile. There are at most as many as rows in the two prefix tables.
    """
    spark = files.sparkSession
    planned = M.encoding_plan(files)
    done = []
    for row in planned.groupBy("priority", "profile").count().orderBy("priority", "profile").collect():
        part = planned.where((F.col("priority") == row["priority"]) & (F.col("profile") == row["profile"])).select("path", "size", "content")
        target = f"{path}/{row['priority']}/{row['profile']}"
        kept = _saved(spark, target, part)
        if not kept:
            codec, level = sinks.PROFILE_CODECS[row["profile"]]
            ingest_files(part, target, codec, level)
        done.append((row["priority"], row["profile"], "kept" if kept else "saved"))
    return done


def _saved(spark: SparkSession, path: str, files: DataFrame) -> bool:
    """Whether a whole workspace of just these files lies at ``path``; its manifest is written last, with a mark of success."""
    jvm = spark._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/_SUCCESS")
    if not mark.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(mark):
        return False
    now = files.select("path", F.sha2("content", 256).alias("sha256"))
    return M.verified(now, M.live(spark.read.json(f"{path}/manifest")).select("path", "sha256"), "path", "sha256").where("status <> 'ok'").isEmpty()


def verify_sample(spark: SparkSession, path: str, every: int = 100) -> DataFrame:
    """(path, intact) of each ``every``-th live file in the order of :func:`~tritloom.operators.store.systematic_sample`."""
    chosen = M.systematic_sample(M.live(sources.load_engram(spark, path)[1]), ["path"], every).select("path")
    return extract(spark, path, chosen).select("path", "intact")


def query(spark: SparkSession, path: str, text: str, k: int = 5) -> DataFrame:
    """(rank, path, score): the ``k`` live files nearest to ``text`` by the cosine of their engrams; ties by path.

    Files that share no dim with the text, and a text without bytes, give no rows.
    """
    asked = A.bundle_many(C.encode_files(spark.createDataFrame([(0, text)], "query_id int, text string"), C.bound_codes(spark), "query_id", "text"), ["query_id"])
    wanted = {r["dim"]: r["trit"] for r in asked.collect()}  # at most the dims of one text
    if not wanted:
        return spark.createDataFrame([], "rank int, path string, score double")
    probed = spark.read.parquet(f"{path}/files").where(F.col("dim").isin(list(wanted)))
    dots = probed.join(F.broadcast(asked.select("dim", F.col("trit").alias("q"))), "dim").groupBy("path").agg(F.sum(F.col("trit") * F.col("q")).alias("dot"))
    scored = dots.join(M.live(sources.load_engram(spark, path)[1]).select("path", "nnz"), "path")
    scored = scored.select(F.lit(0).alias("query_id"), "path", F.round(F.col("dot") / F.sqrt((F.col("nnz") * len(wanted)).cast("double")), 6).alias("score"))
    return S.ranked(scored, k, "path").select("rank", "path", "score")
