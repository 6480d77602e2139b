"""Registered queries of sources, sinks, workspaces and streams that write tables, each with SQL for a second engine."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import functions as X
from .. import sinks, sources, streaming, workspace
from ..operators import algebra as A
from ..operators import codebook as C
from ..operators import similarity as S
from ..operators import store as M
from ..shared import removed, shared_dir, written
from .store_queries import _PATHS, FILES, document_files, part_paths
from .store_queries import ORACLE_SQL as STORE_SQL
from .vector_queries import ORACLE_SQL as VECTOR_SQL
from .vector_queries import T, labelled, table, trits

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def scratch(spark) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tritloom/saved-{uuid.uuid4().hex}"


def table_stream(spark, sf_dir, name):
    """A table as a stream; a pattern, as a stream of one file can't have the file itself as its base folder."""
    return streaming.source(spark, f"{sf_dir}/{name}.parque[t]", table(spark, sf_dir, name).schema)


def human_sql(size: str) -> str:
    cases = []
    for k, unit in reversed(list(enumerate("KMGTP", 1))):
        scaled = f"{size} / {1024**k}.0"
        cases.append(f"WHEN {size} >= {1024**k} THEN CASE WHEN ceil({scaled} * 10) < 100 THEN printf('%.1f{unit}', ceil({scaled} * 10) / 10) ELSE printf('%d{unit}', CAST(ceil({scaled}) AS BIGINT)) END")
    return f"CASE {' '.join(cases)} ELSE CAST({size} AS VARCHAR) END"


@query("s4_human_size", f"SELECT o_orderkey, {human_sql('n')} AS human FROM (SELECT o_orderkey, o_orderkey * o_orderkey * o_custkey AS n FROM orders)")
def _(spark, sf_dir):
    key, customer = (F.col(c).cast("decimal(19,0)") for c in ("o_orderkey", "o_custkey"))  # the product may pass 64 bits
    return table(spark, sf_dir, "orders").select("o_orderkey", X.human_size(key * key * customer).alias("human"))


_TREE = f"""WITH {FILES}, f AS (SELECT '/' || coalesce(source, 'none') AS directory, coalesce(lang, 'none') AS folder, size, coalesce(lang = 'fr', false) AS link,
len(regexp_replace(coalesce(text, ''), '[^\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) <= 0.05 * len(coalesce(text, '')) AS is_text FROM files),
g AS (SELECT directory, count(*) FILTER (NOT link) AS file_count, count(DISTINCT folder) AS directory_count, count(*) FILTER (link) AS symlink_count, CAST(coalesce(sum(size) FILTER (NOT link), 0) AS BIGINT) AS total_bytes,
count(*) FILTER (NOT link AND is_text) AS text_files, count(*) FILTER (NOT link AND NOT is_text) AS binary_files FROM f GROUP BY directory)
SELECT *, {human_sql('total_bytes')} AS total_size_human, CAST(floor(total_bytes / 10485760.0) + 1 AS BIGINT) AS estimated_encode_seconds FROM g"""


@query("s4_tree_profile", _TREE)
def _(spark, sf_dir):
    """Documents as a tree of sources and languages; those in French stand for links."""
    files = document_files(spark, sf_dir).withColumn("root", F.concat(F.lit("/"), F.coalesce("source", F.lit("none"))))
    return sources.tree_profile(files, "root", F.coalesce("text", F.lit("")), F.col("lang") == "fr")


_MAGIC = {0: "89504E470D0A1A0A", 1: "FFD8FF", 2: "52494646000000005741564520", 3: "255044462D", 4: "1F8B", 5: "4F676753"}
_HEADED = "SELECT p_partkey, CASE p_size % 7 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _MAGIC.items()) + " ELSE '' END || hex(encode(p_name)) AS h FROM part"


@query("s9b_media_types", f"SELECT p_partkey, CASE WHEN starts_with(h, '89504E470D0A1A0A') THEN 'png' WHEN starts_with(h, 'FFD8FF') THEN 'jpeg' WHEN substr(h, 17, 8) = '57415645' THEN 'wav' WHEN starts_with(h, '255044462D') THEN 'pdf' WHEN starts_with(h, '1F8B') THEN 'gzip' WHEN starts_with(h, '4F676753') THEN 'ogg' ELSE 'unknown' END AS media FROM ({_HEADED})")
def _(spark, sf_dir):
    """Part names behind the first bytes of six kinds of file."""
    head = F.lit("")
    for k, magic in _MAGIC.items():
        head = F.when(F.col("p_size") % 7 == k, magic).otherwise(head)
    content = F.unhex(F.concat(head, F.hex(F.encode("p_name", "UTF-8"))))
    return table(spark, sf_dir, "part").select("p_partkey", X.media_type(content).alias("media"))


@query("s9d_catalog", "SELECT name, t.tier, size_mb, CAST(100 AS BIGINT) * size_mb // n AS share FROM (VALUES " + ", ".join(f"('{n}', '{t}', {m})" for n, t, _, m in sources.CATALOG if t in ("small", "medium")) + ") AS t(name, tier, size_mb), (SELECT count(*) AS n FROM region)")
def _(spark, sf_dir):
    """Datasets up to the medium tier, with their size for each of the given regions."""
    regions = table(spark, sf_dir, "region").count()
    return sources.catalog(spark, "medium").select("name", "tier", "size_mb", F.expr(f"100 * cast(size_mb as bigint) div {regions}").alias("share"))


@query("s21_telemetry", """SELECT '{"user_id":' || user_id || ',"event_type":"' || event_type || '","n":' || count(*) || '}' AS value FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY user_id, event_type""")
def _(spark, sf_dir):
    counted = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND event_type IS NOT NULL").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return sinks.telemetry(counted)


_HELD = f"""WITH {FILES}, q AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id), m AS (SELECT path, doc_id, CAST(ceil(size / 512.0) AS BIGINT) AS n_chunks, coalesce(toxic = 1, false) AS deleted, quality FROM files LEFT JOIN q USING (doc_id)),
e AS (SELECT path, chunk_no FROM (SELECT path, quality, unnest(range(n_chunks)) AS chunk_no FROM m) WHERE NOT coalesce(quality = 0, false) OR chunk_no > 0), h AS (SELECT path, count(*) AS n, max(chunk_no) AS last FROM e GROUP BY path)
SELECT * FROM (SELECT path, CASE WHEN m.path IS NULL THEN 'orphan' WHEN n IS NULL AND n_chunks > 0 THEN 'no_engram' WHEN last >= n_chunks THEN 'chunks_beyond_end' WHEN n < n_chunks THEN 'chunks_missing' END AS problem FROM (SELECT * FROM m WHERE NOT deleted) m FULL JOIN h USING (path)) WHERE problem IS NOT NULL"""


@query("x10_fsck", _HELD)
def _(spark, sf_dir):
    """A store whose documents of quality 0 lost their first chunk, and whose toxic ones are removed."""
    q = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    files = document_files(spark, sf_dir).join(q, "doc_id", "left")
    n = F.ceil(F.col("size") / 512)
    held = files.where("size > 0").select("path", "quality", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("chunk_no"))
    held = held.where(~F.coalesce(F.col("quality") == 0, F.lit(False)) | (F.col("chunk_no") > 0))
    current = files.select("path", n.alias("n_chunks"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("deleted"))
    return M.fsck(current, held)


@query("p11_dry_run", f"WITH {_PATHS}, pl AS ({STORE_SQL['w11_encoding_plan']}) SELECT path, priority, profile, p_size AS mtime FROM pl JOIN part ON p_partkey = CAST(string_split(path, '/')[-1] AS BIGINT) WHERE NOT coalesce(p_retailprice > 1000 AND 25 > p_size, false)")
def _(spark, sf_dir):
    """What a run would encode, and how, without encoding: files older than their engram are passed over."""
    part = table(spark, sf_dir, "part")
    key = F.element_at(F.split("path", "/"), -1).cast("bigint").alias("p_partkey")
    files = part_paths(spark, sf_dir).select("path", key).join(part.select("p_partkey", "p_size", "p_retailprice"), "p_partkey")
    engrams = files.where("p_retailprice > 1000").select("path", F.lit(25).alias("mtime"))
    return M.encoding_plan(M.stale(files.select("path", F.col("p_size").alias("mtime")), engrams)).select("path", "priority", "profile", "mtime")


@query("v27_custom_operation", f"WITH {T}, a AS (SELECT * FROM trits WHERE dim < 48), b AS (SELECT * FROM trits WHERE dim >= 16) SELECT vec_id, dim, CAST(coalesce(a.trit, -b.trit) AS INTEGER) AS trit FROM a FULL JOIN b USING (vec_id, dim)")
def _(spark, sf_dir):
    """An operation of the caller's own: the first vector's trit, or the second's negation where it has none."""
    if "first_or_opposite" not in A.OPERATIONS:
        A.register_operation("first_or_opposite", lambda a, b: F.when(a != 0, a).otherwise(-b))
    t = trits(spark, sf_dir)
    return A.compute(t.where("dim < 48"), t.where("dim >= 16"), "first_or_opposite", "vec_id", 64)


@query("s8_pruned_index", f"WITH {T} SELECT vec_id, dim, trit FROM trits WHERE dim IN (3, 17, 40)")
def _(spark, sf_dir):
    """Postings of three dims from a saved index; other row groups are not read."""
    path = scratch(spark)
    S.write_index(trits(spark, sf_dir), path)
    found, _ = written(spark.read.parquet(path).where(F.col("dim").isin(3, 17, 40)), "postings")
    removed(spark, path)
    return found


@query("s5_engram_round_trip", VECTOR_SQL["v11_encode_chunks"])
def _(spark, sf_dir):
    """Chunk engrams as they come back from a saved engram."""
    b = table(spark, sf_dir, "benchmark")
    path = sinks.save_engram(C.encode_files(b, C.bound_codes(spark), "item_id", "text"), M.manifest(b, "item_id", F.octet_length("text"), C.CHUNK), scratch(spark), level=6)
    found, _ = written(sources.load_engram(spark, path)[0], "engrams")
    removed(spark, path)
    return found


@query("s13_codec_profiles", f"SELECT profile, count(*) AS n FROM ({STORE_SQL['s14_profile_prefix_join']}) GROUP BY profile")
def _(spark, sf_dir):
    """Files by profile, counted from tables that were written with each profile's codec and level."""
    path = scratch(spark)
    sinks.save_by_profile(M.longest_prefix(part_paths(spark, sf_dir), M.profiles(spark), "path", "prefix", "profile", M.DEFAULT_PROFILE), "profile", path)
    found, _ = written(spark.read.schema("path string, profile string").parquet(path).groupBy("profile").agg(F.count("*").alias("n")), "profiles")
    removed(spark, path)
    return found


@query("s2_ingest_extract", "SELECT '/b/' || item_id AS path, sha256(text) AS sha256, true AS intact FROM benchmark WHERE len(text) > 0")
def _(spark, sf_dir):
    """Texts encoded into a workspace and given back from it."""
    path, raw = scratch(spark), F.col("text").cast("binary")
    files = table(spark, sf_dir, "benchmark").where(F.octet_length("text") > 0).select(F.concat(F.lit("/b/"), F.col("item_id").cast("string")).alias("path"), F.octet_length("text").alias("size"), raw.alias("content"))
    workspace.ingest_files(files, path)
    found, _ = written(workspace.extract(spark, path).select("path", F.sha2("content", 256).alias("sha256"), "intact"), "extracted")
    removed(spark, path)
    return found


@query("t4_encode_stream", VECTOR_SQL["v11_encode_chunks"])
def _(spark, sf_dir):
    """Chunk engrams of a stream of texts."""
    stream = table_stream(spark, sf_dir, "benchmark")
    mark = scratch(spark)
    found = streaming.run_to_table(streaming.encode_stream(stream, "item_id", "text"), scratch(spark), mark)
    removed(spark, mark)
    return found


@query("t2_stream_windows", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n FROM events WHERE value >= 50 GROUP BY 1, 2")
def _(spark, sf_dir):
    """Hourly counts of alerts: a stream finds the alerts, windows count what it wrote."""
    stream = table_stream(spark, sf_dir, "events")
    mark = scratch(spark)
    hot = streaming.run_to_table(streaming.alerts(stream, "value", 50.0), scratch(spark), mark)
    removed(spark, mark)
    w = streaming.windowed(hot.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", None, ["event_type"], "value")
    return w.select(F.unix_micros("start").alias("start_us"), "event_type", "n")
