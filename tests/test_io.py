"""Sources, sinks, scalar functions and streams."""

import gzip
import json
import os

from pyspark.sql import functions as F

from tritloom import functions as X
from tritloom import sinks, sources, streaming
from tritloom.operators import store as M

SF = "/root/testdata/sf0.001"


def test_directory_ingest_profile_and_media(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/x.txt").write_bytes(b"hello\nworld")
    (tmp_path / "a/b/y.bin").write_bytes(bytes(range(256)))
    (tmp_path / "a/b/z.png").write_bytes(bytes.fromhex("89504E470D0A1A0A00"))
    files = sources.directory(spark, str(tmp_path))
    assert files.count() == 3
    got = {os.path.basename(r.directory): r for r in sources.profile(files).collect()}
    assert got["a"].text_files == 1 and got["a"].total_bytes == 11 and got["a"].estimated_encode_seconds == 1
    assert got["b"].file_count == 2 and got["b"].binary_files >= 1
    assert {os.path.basename(r.path): r.media for r in sources.media(files).collect()} == {"x.txt": "unknown", "y.bin": "unknown", "z.png": "png"}
    good = files.select("path", F.sha2("content", 256).alias("sha256")).where("path like '%x.txt'")
    assert sources.checked(files, good).count() == 1


def test_dataset_readers(spark, tmp_path):
    (tmp_path / "t.md").write_text("# head\nbody")
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "w.json").write_text('[{"a": 1},\n {"a": 3}]')
    (tmp_path / "c.csv").write_text("a,b\n1,x\n")
    (tmp_path / "c.tsv").write_text("a\tb\n1\tx\n2\ty\n")
    (tmp_path / "x.xml").write_text("<r><row><a>1</a></row><row><a>2</a></row></r>")
    (tmp_path / "h.html").write_text("<html><script>no()</script><p>Yes &amp; no</p></html>")
    (tmp_path / "p.pdf").write_bytes(b"%PDF-1.4\n1 0 obj\n<<>>\nstream\nBT (Hello) Tj [(Wor) -20 (ld)] TJ ET\nendstream\nendobj")
    record = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://e.example/\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "r.warc.gz").write_bytes(gzip.compress((record * 2).encode()))
    inside = "WARC/1.0\r\n\r\nnot a record"
    tricky = f"WARC/1.1\r\nWARC-Type: resource\r\ncontent-length: {len(inside)}\r\n\r\n{inside}\r\n\r\n" + record
    (tmp_path / "s.warc").write_text(tricky + "WARC/1.0\r\nWARC-Type: broken\r\n\r\n", newline="")
    read = lambda name, kind, **kw: sources.dataset(spark, str(tmp_path / name), kind, **kw)
    assert read("t.md", "md").first().text == "# head\nbody"
    assert read("t.md", "lines").count() == 2
    assert read("l.jsonl", "jsonl", schema="a int").agg(F.sum("a")).first()[0] == 3
    assert read("w.json", "json", schema="a int").agg(F.sum("a")).first()[0] == 4
    assert read("c.csv", "csv", schema="a int, b string").first().b == "x" and read("c.tsv", "tsv", schema="a int, b string").count() == 2
    assert read("x.xml", "xml", schema="a int").count() == 2
    assert read("h.html", "html").first().text == "Yes & no"
    assert read("p.pdf", "pdf").first().text == "Hello World"
    got = read("r.warc.gz", "warc").collect()
    assert [(r.kind, r.uri, r.content) for r in got] == [("response", "http://e.example/", "hello")] * 2
    assert [(r.kind, r.uri, r.content) for r in read("s.warc", "warc").collect()] == [("resource", "", inside), ("response", "http://e.example/", "hello")]
    assert read("../" + tmp_path.name + "/c.csv", "csv").columns == ["a", "b"]
    assert sources.catalog(spark, "medium").where("tier = 'large'").count() == 0 and sources.catalog(spark).count() == 10


def test_engram_round_trip_codecs_and_dry_run(spark, tmp_path):
    trits = spark.createDataFrame([(1, 2, 1), (1, 3, -1), (2, 2, 1)], "vec_id bigint, dim int, trit int")
    manifest = M.manifest(spark.createDataFrame([("/etc/x", 9)], "p string, n bigint"), "p", F.col("n"), 8)
    for codec in ("zstd", "lz4", "none"):
        path = sinks.save_engram(trits, manifest, str(tmp_path / codec), codec)
        back, listed = sources.load_engram(spark, path)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, trits.collect()))
        assert listed.first().n_chunks == 2
    assert "Exchange" in sinks.save_engram(trits, manifest, str(tmp_path / "dry"), dry_run=True) and not (tmp_path / "dry").exists()
    rows = trits.withColumn("profile", F.when(F.col("vec_id") == 1, "config").otherwise("logs"))
    sinks.save_by_profile(rows, "profile", str(tmp_path / "by"))
    assert spark.read.parquet(str(tmp_path / "by")).count() == 3


def test_codec_levels_and_tree_profile(spark, tmp_path):
    import pyarrow.parquet as pq
    import pytest

    assert sinks.PROFILE_CODECS["kernel"] == ("zstd", 19) and sinks.PROFILE_CODECS["runtime"] == ("none", None)
    rows = spark.range(20_000).select((F.col("id") * 7919 % 10007).alias("n"), F.md5(F.col("id").cast("string")).alias("h"), F.lit("kernel").alias("profile"))
    size = {}
    for level in (1, 19):
        rows.coalesce(1).write.options(**sinks.parquet_options("zstd", level)).parquet(str(tmp_path / str(level)))
        size[level] = sum(f.stat().st_size for f in (tmp_path / str(level)).glob("*.parquet"))
    assert size[19] < size[1]
    sinks.save_by_profile(rows, "profile", str(tmp_path / "by"))
    assert pq.ParquetFile(next((tmp_path / "by/profile=kernel").glob("*.parquet"))).metadata.row_group(0).column(0).compression == "ZSTD"
    for wrong in (("lz4", 3), ("brotli", None)):
        with pytest.raises(ValueError):
            sinks.parquet_options(*wrong)
    files = spark.createDataFrame([("/r", "/r/a/b/one", 2048, "text", False), ("/r", "/r/a/two", None, "\x00\x01", False), ("/r", "/r/top", 1, "", None), ("/r", "/r/a/c/link", 9, "x", True)], "root string, path string, size bigint, text string, link boolean")
    got = sources.tree_profile(files, "root", F.col("text"), F.col("link")).first().asDict()
    assert got == {"directory": "/r", "file_count": 3, "directory_count": 3, "symlink_count": 1, "total_bytes": 2049, "text_files": 2, "binary_files": 1, "total_size_human": "2.1K", "estimated_encode_seconds": 1}
    assert sources.tree_profile(files.limit(0), "root", F.col("text")).count() == 0


def test_manifest_document_and_reports(spark, tmp_path):
    m = spark.createDataFrame([("/a", "t", 2, 100, 50), ("/b", "t", 1, 10, 0)], "directory string, encoded_at string, file_count bigint, original_bytes bigint, encoded_bytes bigint")
    doc = json.loads(sinks.manifest_json(m, "/", "now").first().value)
    assert doc["stats"] == {"total_files": 3, "total_bytes_original": 110, "total_bytes_encoded": 50, "directories_encoded": 2}
    assert doc["directories"]["/a"]["file_count"] == 2
    files = spark.createDataFrame([("d/one.txt", b"1"), ("two.txt", b"22")], "name string, content binary")
    assert sinks.write_files(files, str(tmp_path / "out")).agg(F.sum("size")).first()[0] == 3
    assert (tmp_path / "out/d/one.txt").read_bytes() == b"1"
    sinks.extract_files(files, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2
    assert json.loads(sinks.telemetry(m).orderBy("value").first().value)["directory"] == "/a"
    lines = spark.createDataFrame([("m", 'a"b\\c', 1.5)], "name string, l string, v double").select("name", X.prometheus_line(F.col("name"), {"l": F.col("l")}, F.col("v")).alias("line"))
    assert lines.first().line == 'm{l="a\\"b\\\\c"} 1.5'
    sinks.write_prometheus(lines, str(tmp_path / "prom"))


def test_scalar_functions(spark):
    sizes = spark.createDataFrame([(5,), (1023,), (1024,), (1536,), (10 * 1024 + 1,), (3 << 30,)], "n bigint")
    assert [r[0] for r in sizes.select(X.human_size(F.col("n"))).collect()] == ["5", "1023", "1.0K", "1.5K", "11K", "3.0G"]
    assert spark.range(1).select(X.traceparent(F.lit("a"), F.lit("b"))).first()[0].startswith("00-0cc175b9c0f1b6a831c399e269772661-")
    e = spark.createDataFrame([("x",), (None,)], "t string").select(X.envelope(F.lit("text"), F.col("t")).alias("e"))
    assert e.where(X.envelope_intact(F.col("e"))).count() == 1


def test_updates(spark):
    current = spark.createDataFrame([("a", 1, False), ("b", 2, False)], "path string, version int, deleted boolean")
    changes = spark.createDataFrame([("a", 1, True), ("b", 1, True), ("c", 0, False)], "path string, expected int, deleted boolean")
    got = {r.path: (r.version, r.deleted) for r in M.applied(current, changes).collect()}
    assert got == {"a": (2, True), "b": (2, False), "c": (1, False)}
    assert [(r.path, r.found) for r in M.rejected(current, changes).collect()] == [("b", 2)]
    trits = spark.createDataFrame([("a", 0, 1), ("b", 0, 1), ("b", 1, -1)], "path string, dim int, trit int")
    flagged = M.removed(current, spark.createDataFrame([("a",)], "path string")).withColumn("size", F.lit(7))
    root, stats = M.compacted(trits, flagged, "path")
    assert {r.dim: r.votes for r in root.collect()} == {0: 1, 1: -1}
    assert tuple(stats.first()) == (1, 1, 7)
    plan = M.encoding_plan(spark.createDataFrame([("/lib/modules/x",), ("/lib/x",), ("/library/x",), ("/home",), ("/",)], "path string")).collect()
    assert [(r.path, r.priority, r.profile) for r in plan] == [("/lib/modules/x", 25, "kernel"), ("/lib/x", 25, "libraries"), ("/", 50, "default"), ("/library/x", 50, "default"), ("/home", 80, "default")]


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    parts = str(tmp_path / "in")
    events.withColumn("ts", F.col("ts").cast("timestamp")).repartition(4).write.parquet(parts)
    schema = spark.read.parquet(parts).schema
    stream = streaming.source(spark, parts, schema, 1)
    run = lambda df, name, mode: streaming.run_available(df, name, str(tmp_path / name), mode)
    batch = spark.read.parquet(parts)
    assert run(streaming.alerts(stream, "value", 90.0), "hot", "append").count() == streaming.alerts(batch, "value", 90.0).count()
    shape = lambda df: sorted((r.start, r.event_type, r.n) for r in df.collect())
    windows = run(streaming.windowed(stream, "ts", "1 hour", None, ["event_type"], "value"), "win", "complete")
    assert shape(windows) == shape(streaming.windowed(batch, "ts", "1 hour", None, ["event_type"], "value"))
    trits = lambda df: df.select("user_id", (F.col("event_id") % 16).cast("int").alias("dim"), F.when(F.col("value") > 50, 1).otherwise(-1).alias("trit"))
    state = run(streaming.bundle_state(trits(stream), ["user_id"]), "state", "complete")
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, streaming.bundle_state(trits(batch), ["user_id"]).collect()))
    texts = spark.createDataFrame([(1, "some text of more than a chunk"), (2, ""), (3, None), (4, "ünï"), (4, "again")], "item_id bigint, text string")
    texts.repartition(3).write.parquet(str(tmp_path / "texts"))
    moving = streaming.source(spark, str(tmp_path / "texts"), texts.schema, 1)
    for name, step in (("encoded", streaming.encode_stream), ("decoded", streaming.decode_stream)):
        streamed = streaming.run_to_table(step(moving, "item_id", "text"), str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-mark"))
        assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, step(texts, "item_id", "text").collect())) and streamed.count() > 0
    seen = []
    query = streaming.subscribe(streaming.alerts(stream, "value", 90.0), lambda df, n: seen.append(df.count()), str(tmp_path / "sub"))
    query.processAllAvailable()
    query.stop()
    assert sum(seen) == streaming.alerts(batch, "value", 90.0).count()


def test_fsck_and_custom_operation(spark):
    import pytest

    from tritloom.operators import algebra as A

    current = spark.createDataFrame([("a", 2, False), ("b", 1, False), ("c", 0, False), ("d", 1, True), ("e", 3, False), ("f", 1, False)], "path string, n_chunks bigint, deleted boolean")
    engrams = spark.createDataFrame([("a", 0), ("a", 1), ("d", 0), ("e", 0), ("f", 0), ("f", 1)], "path string, chunk_no int")
    assert {r.path: r.problem for r in M.fsck(current, engrams).collect()} == {"b": "no_engram", "d": "orphan", "e": "chunks_missing", "f": "chunks_beyond_end"}
    A.register_operation("nand_for_test", lambda x, y: -F.least(x, y))
    a = spark.createDataFrame([(1, 0, 1), (1, 1, -1)], "vec_id bigint, dim int, trit int")
    assert {r.dim: r.trit for r in A.compute(a, a, "nand_for_test", "vec_id", 2).collect()} == {0: -1, 1: 1}
    with pytest.raises(ValueError):
        A.register_operation("and", F.least)


def test_human_size_of_products_over_64_bits(spark, tmp_path):
    from tritloom.plans import QUERIES

    spark.createDataFrame([(1, 1), (9_000_000, 900_000), (300_000, 15_000)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r.human for r in QUERIES["s4_human_size"](spark, str(tmp_path)).collect()}
    assert got == {1: "1", 9_000_000: "64749P", 300_000: "1.2P"}
