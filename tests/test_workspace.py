"""Folders in, the same files out, and searches over what was saved."""

from tritloom import workspace


def test_ingest_extract_and_query(spark, tmp_path):
    source = tmp_path / "in"
    (source / "deep").mkdir(parents=True)
    (source / "empty").write_bytes(b"")  # Spark's reader passes over it
    held = {"a.txt": b"the quick brown fox jumps over the lazy dog", "deep/b.txt": b"a different text about ternary vectors", "c.bin": bytes(range(256)) * 3}
    for name, content in held.items():
        (source / name).write_bytes(content)
    saved = str(tmp_path / "out")
    manifest = {r.path.rsplit("/in/", 1)[1]: r for r in workspace.ingest(spark, str(source), saved).collect()}
    assert {name: r.size for name, r in manifest.items()} == {name: len(x) for name, x in held.items()} and manifest["c.bin"].n_chunks == 96
    back = {r.path.rsplit("/in/", 1)[1]: (bytes(r.content), r.intact) for r in workspace.extract(spark, saved).collect()}
    assert back == {name: (content, True) for name, content in held.items()}
    found = workspace.query(spark, saved, held["deep/b.txt"].decode(), 2)
    assert "In(dim" in found._jdf.queryExecution().toString() or "dim IN" in found._jdf.queryExecution().toString()
    best = found.orderBy("rank").first()
    assert best.path.endswith("deep/b.txt") and best.score == 1.0
    assert workspace.query(spark, saved, "").count() == 0


def test_progressive_run_goes_on_where_it_ended(spark, tmp_path):
    held = {"/var/log/a": b"late", "/usr/share/b": b"first", "/etc/c": b"config", "/etc/d": b"more config", "/srv/e": b"default"}
    files = spark.createDataFrame([(p, len(x), bytearray(x)) for p, x in held.items()], "path string, size bigint, content binary")
    saved = str(tmp_path / "levels")
    levels = [(10, "default"), (30, "config"), (50, "default"), (90, "logs")]
    assert workspace.ingest_progressive(files.where("path not like '/var%'"), saved) == [(*x, "saved") for x in levels[:3]]
    changed = files.selectExpr("path", "size", "if(path = '/etc/c', cast('CONFIG' as binary), content) as content")
    assert workspace.ingest_progressive(changed, saved) == [(10, "default", "kept"), (30, "config", "saved"), (50, "default", "kept"), (90, "logs", "saved")]
    back = {r.path: bytes(r.content) for p, q in levels for r in workspace.extract(spark, f"{saved}/{p}/{q}").where("intact").collect()}
    assert back == held | {"/etc/c": b"CONFIG"}
    assert workspace.verify_sample(spark, f"{saved}/30/config", 2).count() == 1
    assert workspace.ingest_progressive(files.limit(0), saved) == []
