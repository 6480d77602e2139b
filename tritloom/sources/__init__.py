"""Readers: directories of files, datasets in common formats, saved engrams and the dataset catalog.

Everything is read by Spark's own readers, so any store that Spark reaches will do; formats without a reader come
through ``binaryFile`` and native expressions, or an Arrow function where they need parsing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import content_class, human_size, media_type, path_parts

#: Dataset tiers and the largest size in MB of each.
TIERS = [("small", 100), ("medium", 1_000), ("large", 10_000), ("full", 20_000)]
#: Named datasets, their tier, format and size in MB.
CATALOG = [
    ("wikitext-2", "small", "txt", 13), ("20-newsgroups", "small", "txt", 45), ("cifar-10", "medium", "binary", 170), ("codesearchnet", "medium", "jsonl", 900),
    ("ms-marco", "medium", "tsv", 1000), ("ucf101", "large", "video", 6900), ("wikipedia-subset", "large", "xml", 8000), ("openwebtext", "full", "txt", 13_500), ("imagenet", "full", "binary", 19_000), ("wikipedia", "full", "xml", 19_500),
]


def directory(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, mtime, size, content) of all files below a folder; ``content`` is read only where it is used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return reader.load(path).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")


def directory_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The same as a stream of new files."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    read = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return read.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")


def profile(files: DataFrame) -> DataFrame:
    """One row for each folder: files, bytes, text and binary files, estimated seconds at 10 MiB a second."""
    text = F.expr("decode(content, 'ISO-8859-1')")  # a character a byte, so control bytes show
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    kinds = files.select(folder.alias("directory"), "size", content_class(text).alias("kind"))
    return kinds.groupBy("directory").agg(
        F.count("*").alias("file_count"), F.sum("size").alias("total_bytes"), F.count_if(F.col("kind") == "text").alias("text_files"), F.count_if(F.col("kind") == "binary").alias("binary_files"), (F.floor(F.sum("size") / 10485760.0) + 1).cast("bigint").alias("estimated_encode_seconds")
    )


def tree_profile(files: DataFrame, root: str, text: Column, link: Column | None = None) -> DataFrame:
    """One row for each value of ``root``, with all that lies below it: files, folders, links, bytes and kinds of content.

    files: path, size, ``root`` (a leading part of the path). Folders are those that the paths of files and links pass
    through below the root; links (rows where ``link`` is true) count as links only. Null sizes count as no bytes.
    """
    rows = files.select(F.col(root).alias("directory"), "path", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"), content_class(text).alias("kind"), F.coalesce(link, F.lit(False)).alias("link") if link is not None else F.lit(False).alias("link"))
    parts = path_parts(F.substring(F.col("path"), F.length("directory") + 1, F.length("path")))
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    folders = rows.where(F.size(parts) > 1).select("directory", F.explode(above).alias("folder")).distinct().groupBy("directory").agg(F.count("*").alias("directory_count"))
    file = ~F.col("link")
    total = F.coalesce(F.sum(F.when(file, F.col("size"))), F.lit(0))
    sums = rows.groupBy("directory").agg(
        F.count_if(file).alias("file_count"), F.count_if("link").alias("symlink_count"), total.alias("total_bytes"), F.count_if(file & (F.col("kind") == "text")).alias("text_files"), F.count_if(file & (F.col("kind") == "binary")).alias("binary_files")
    )
    both = sums.join(folders, "directory", "left").withColumn("directory_count", F.coalesce("directory_count", F.lit(0)))
    return both.withColumn("total_size_human", human_size(F.col("total_bytes"))).withColumn("estimated_encode_seconds", (F.floor(F.col("total_bytes") / 10485760.0) + 1).cast("bigint"))


def media(files: DataFrame) -> DataFrame:
    """(path, size, media) by first bytes."""
    return files.select("path", "size", media_type(F.col("content")).alias("media"))


def checked(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Files whose SHA-256 is the expected one (path, sha256); others are left out."""
    return files.withColumn("sha256", F.sha2("content", 256)).join(expected.select("path", "sha256"), ["path", "sha256"], "left_semi")


_html_text = [(r"(?is)<(script|style)\b.*?</\1\s*>", " "), (r"(?s)<!--.*?-->", " "), (r"<[^>]*>", " "), (r"\s+", " ")]


def dataset(spark: SparkSession, path: str, kind: str, schema: str | None = None, row_tag: str = "row") -> DataFrame:
    """Reads txt, md, rst, code, json, jsonl, csv, tsv, xml, parquet, orc, html, pdf or warc."""
    reader = spark.read.schema(schema) if schema else spark.read
    if kind in ("txt", "md", "rst", "code"):
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    if kind == "lines":
        return spark.read.text(path).select(F.col("value").alias("text"))
    if kind in ("json", "jsonl"):
        return reader.option("multiLine", kind == "json").json(path)
    if kind in ("csv", "tsv"):
        return reader.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
    if kind == "xml":
        return reader.option("rowTag", row_tag).xml(path)
    if kind in ("parquet", "orc"):
        return reader.format(kind).load(path)
    if kind == "html":
        text = F.col("value")
        for pattern, by in _html_text:
            text = F.regexp_replace(text, pattern, by)
        return unescaped(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.trim(text).alias("text")), "text")
    if kind == "pdf":
        return pdf_texts(directory(spark, path))
    if kind == "warc":
        return warc_records(directory(spark, path))
    raise ValueError(f"no reader for {kind}")


def pdf_texts(files: DataFrame) -> DataFrame:
    """(path, text) of PDF files: the literal strings of text operators in plain or deflated content streams."""

    def run(batches):
        import re
        import zlib

        import pyarrow as pa

        stream = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
        shown = re.compile(rb"\(((?:[^()\\]|\\.)*)\)\s*(?:Tj|'|\")|\[((?:[^\]\\]|\\.)*)\]\s*TJ", re.S)
        inner = re.compile(rb"\(((?:[^()\\]|\\.)*)\)", re.S)
        for batch in batches:
            out = []
            for data in batch.column(1).to_pylist():
                parts = []
                for body in stream.findall(data or b""):
                    try:
                        body = zlib.decompress(body)
                    except zlib.error:
                        pass  # a stream that isn't deflated
                    for one, many in shown.findall(body):
                        parts.append(one or b"".join(inner.findall(many)))
                out.append(re.sub(rb"\\(.)", rb"\1", b" ".join(parts), flags=re.S).decode("latin-1"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["path", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, text string")


def unescaped(df: DataFrame, text: str) -> DataFrame:
    """``text`` with its HTML character references decoded."""

    def run(batches):
        import html

        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, text, pa.array([None if t is None else html.unescape(t) for t in batch.column(at).to_pylist()], pa.string()))

    return df.mapInArrow(run, df.schema)


def warc_records(files: DataFrame) -> DataFrame:
    """(kind, uri, date, content) of the records of WARC files, plain or gzipped, read by their Content-Length.

    A version line within a payload is payload. A file is read by one task and ends at the first broken record; null and
    empty files give no rows. Contents are read as UTF-8, other bytes as replacement characters.
    """

    def run(batches):
        import gzip

        import pyarrow as pa

        names = ("warc-type", "warc-target-uri", "warc-date")
        for batch in batches:
            for data in batch.column(0).to_pylist():
                data, at = data or b"", 0
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                while (at := data.find(b"WARC/", at)) >= 0:
                    end = data.find(b"\r\n\r\n", at)
                    head = dict(line.split(":", 1) for line in data[at : max(end, at)].decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
                    head = {k.strip().lower(): v.strip() for k, v in head.items()}
                    if end < 0 or not head.get("content-length", "").isdigit():
                        break
                    at = end + 4 + int(head["content-length"])
                    row = [*(head.get(n, "") for n in names), data[end + 4 : at].decode("utf-8", "replace")]
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in row], names=["kind", "uri", "date", "content"])

    return files.select("content").mapInArrow(run, "kind string, uri string, date string, content string")


def catalog(spark: SparkSession, tier: str | None = None) -> DataFrame:
    """(name, tier, format, size_mb) of the known datasets; a tier takes in the smaller ones."""
    known = spark.createDataFrame(CATALOG, "name string, tier string, format string, size_mb int")
    names = [t for t, _ in TIERS]
    return known.where(F.col("tier").isin(names[: names.index(tier) + 1])) if tier else known


def load_engram(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(trits, manifest) of a saved engram."""
    return spark.read.parquet(f"{path}/engram"), spark.read.json(f"{path}/manifest")
