"""Registered queries of the store, content analysis, reports and events, each with SQL for a second engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as X
from ..operators import aggregate as G
from ..operators import algebra as A
from ..operators import entropy as E
from ..operators import store as M
from ..shared import cut, spread
from .vector_queries import D, T, P, labelled, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def document_files(spark, sf_dir) -> DataFrame:
    """Documents as files: path, text, size."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "doc_id", "text", "source", "lang", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size"))


FILES = "files AS (SELECT '/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id AS path, doc_id, text, source, lang, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM documents)"


@query("s10_manifest", f"WITH {FILES} SELECT path, size, 4096 AS chunk_size, CAST(ceil(size / 4096.0) AS BIGINT) AS n_chunks, false AS deleted, 1 AS version FROM files")
def manifest(spark, sf_dir):
    return M.manifest(document_files(spark, sf_dir), "path", F.col("size"), 4096)


@query("s4_directory_profile", f"WITH {FILES} SELECT source AS directory, count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_bytes, count(*) FILTER (len(regexp_replace(coalesce(text, ''), '[^\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) <= 0.05 * len(coalesce(text, ''))) AS text_files, CAST(floor(sum(size) / 10485760.0) AS BIGINT) + 1 AS estimated_encode_seconds FROM files GROUP BY source")
def _(spark, sf_dir):
    f = document_files(spark, sf_dir)
    text = F.count_if(X.content_class(F.coalesce("text", F.lit(""))) == "text")
    return f.groupBy(F.col("source").alias("directory")).agg(F.count("*").alias("file_count"), F.sum("size").alias("total_bytes"), text.alias("text_files"), (F.floor(F.sum("size") / 10485760.0) + 1).cast("bigint").alias("estimated_encode_seconds"))


@query("s11_manifest_upsert", f"WITH {FILES}, gone AS (SELECT path FROM files JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 0) USING (doc_id)) SELECT path, size, CASE WHEN path IN (SELECT path FROM gone) THEN 2 ELSE 1 END AS version, path IN (SELECT path FROM gone) AS deleted FROM files")
def _(spark, sf_dir):
    m = manifest(spark, sf_dir)
    bad = document_files(spark, sf_dir).join(table(spark, sf_dir, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_semi").select("path")
    changes = m.join(bad, "path", "left_semi").withColumn("version", F.lit(2)).withColumn("deleted", F.lit(True))
    return M.upserted(m, changes).select("path", "size", "version", "deleted")


@query("p6_soft_delete_live", f"WITH {FILES} SELECT path, size FROM files WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def _(spark, sf_dir):
    bad = document_files(spark, sf_dir).join(table(spark, sf_dir, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_semi").select("path")
    return M.live(M.removed(manifest(spark, sf_dir), bad)).select("path", "size")


@query("x9_version_check", f"WITH {FILES}, c AS (SELECT path, CASE WHEN quality = 0 THEN 0 ELSE 1 END AS expected FROM files JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)) SELECT f.path, CASE WHEN c.expected = 1 THEN 2 ELSE 1 END AS version, coalesce(c.expected = 1, false) AS deleted FROM files f LEFT JOIN c USING (path)")
def _(spark, sf_dir):
    q = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("q"))
    m = manifest(spark, sf_dir)
    marked = document_files(spark, sf_dir).join(q, "doc_id").select("path", F.when(F.col("q") == 0, 0).otherwise(1).alias("expected"))
    changes = m.join(marked, "path").withColumn("deleted", F.lit(True))
    return M.applied(m, changes).select("path", "version", "deleted")


@query("x4_compact_root", f"WITH {T} SELECT dim, CAST(sum(trit) AS BIGINT) AS votes FROM trits WHERE label <> 0 GROUP BY dim")
def _(spark, sf_dir):
    t = labelled(spark, sf_dir)
    current = t.select("vec_id", "label").distinct().select("vec_id", (F.col("label") == 0).alias("deleted"), F.lit(0).cast("bigint").alias("size"))
    return M.compacted(t.select("vec_id", "dim", "trit"), current, "vec_id")[0]


@query("x1_x3_incremental_root", f"WITH {T} SELECT dim, CAST(sum(CASE WHEN label = 1 THEN -trit ELSE trit END) AS BIGINT) AS votes FROM trits WHERE label <> 0 GROUP BY dim")
def _(spark, sf_dir):
    """Adds all, takes label 0 out, and replaces label 1 by its negation."""
    t = labelled(spark, sf_dir)
    root = A.votes(t, [])
    out = A.unbundle(root, t.where("label <= 1"), [])
    again = t.where("label = 1").select("dim", (-F.col("trit")).cast("bigint").alias("votes"))
    changed = out.unionByName(again).groupBy("dim").agg(F.sum("votes").cast("bigint").alias("votes"))
    left = t.where("label <> 0").select("dim").distinct()
    return changed.join(left, "dim", "left_semi")


@query("x8_verify", f"WITH {FILES}, e AS (SELECT path, CASE WHEN lang = 'de' THEN upper(text) ELSE text END AS text FROM files WHERE source <> 'src1') SELECT f.path, CASE WHEN e.path IS NULL THEN 'missing' WHEN sha256(f.text) = sha256(e.text) THEN 'ok' ELSE 'differs' END AS status FROM files f LEFT JOIN e USING (path)")
def _(spark, sf_dir):
    f = document_files(spark, sf_dir)
    original = f.select("path", X.checksum(F.col("text")).alias("sha"))
    extracted = f.where("source <> 'src1'").select("path", X.checksum(F.when(F.col("lang") == "de", F.upper("text")).otherwise(F.col("text"))).alias("sha"))
    return M.verified(original, extracted, "path", "sha")


@query("j7_missing_engrams", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id")


_PATHS = "paths AS (SELECT DISTINCT '/' || CASE WHEN p_size % 5 = 0 THEN 'usr/lib' WHEN p_size % 5 = 1 THEN 'lib/modules' WHEN p_size % 5 = 2 THEN 'var/log' WHEN p_size % 5 = 3 THEN 'library' ELSE 'etc' END || '/' || p_brand || '/' || p_partkey AS path FROM part)"


def part_paths(spark, sf_dir) -> DataFrame:
    head = F.element_at(F.array(*map(F.lit, ("usr/lib", "lib/modules", "var/log", "library", "etc"))), (F.col("p_size") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("/"), head, F.lit("/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("path")).distinct()


def _prefix_sql(rows: list[tuple], value: str, default: str) -> str:
    return f"SELECT path, coalesce((SELECT arg_max(v, len(p)) FROM (VALUES {', '.join(f'({p!r}, {v!r})' for p, v in rows)}) AS t(p, v) WHERE paths.path = p OR starts_with(paths.path, p || '/')), {default}) AS {value} FROM paths"


@query("p4_priority_prefix_join", f"WITH {_PATHS}, r AS ({_prefix_sql(M.PRIORITIES, 'priority', '50')}) SELECT path, CAST(priority AS INTEGER) AS priority FROM r")
def _(spark, sf_dir):
    return M.longest_prefix(part_paths(spark, sf_dir), M.priorities(spark), "path", "prefix", "priority", M.DEFAULT_PRIORITY)


_DEFAULT = "'default'"


@query("s14_profile_prefix_join", f"WITH {_PATHS} {_prefix_sql(M.PROFILES, 'profile', _DEFAULT)}")
def _(spark, sf_dir):
    return M.longest_prefix(part_paths(spark, sf_dir), M.profiles(spark), "path", "prefix", "profile", M.DEFAULT_PROFILE)


@query("w11_encoding_plan", f"WITH {_PATHS}, a AS ({_prefix_sql(M.PRIORITIES, 'priority', '50')}), b AS ({_prefix_sql(M.PROFILES, 'profile', _DEFAULT)}) SELECT path, CAST(priority AS INTEGER) AS priority, profile FROM a JOIN b USING (path)")
def _(spark, sf_dir):
    return M.encoding_plan(part_paths(spark, sf_dir))


_TIMES = "src AS (SELECT user_id, max(ts) FILTER (event_type <> 'click') AS mtime FROM events GROUP BY user_id), eng AS (SELECT user_id, max(ts) AS et FROM events WHERE event_type = 'click' GROUP BY user_id)"


@query("p3_up_to_date_skip", f"WITH {_TIMES} SELECT src.user_id, epoch_us(mtime) AS mtime_us FROM src LEFT JOIN eng USING (user_id) WHERE mtime IS NOT NULL AND (et IS NULL OR et <= mtime)")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    src = e.where("event_type <> 'click'").groupBy("user_id").agg(F.max("ts").alias("mtime"))
    eng = e.where("event_type = 'click'").groupBy("user_id").agg(F.max("ts").alias("mtime"))
    return M.stale(src, eng, "user_id").select("user_id", F.unix_micros(F.col("mtime").cast("timestamp")).alias("mtime_us"))


@query("p5_systematic_sample", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS nth FROM documents) WHERE nth % 100 = 0")
def _(spark, sf_dir):
    return M.systematic_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"], 100)


@query("j9_path_shift", f"WITH {FILES} SELECT path, CAST(CAST('0x' || substr(md5(path), 1, 8) AS BIGINT) % 10000 AS INTEGER) AS shift FROM files")
def _(spark, sf_dir):
    return document_files(spark, sf_dir).select("path", X.md5_int(F.col("path"), 10_000).alias("shift"))


@query("s9c_checksums", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.checksum(F.col("text")).alias("sha256"), F.md5("text").alias("md5"))


_BC = "bytes AS (SELECT doc_id, byte{1} FROM (SELECT doc_id, unnest(regexp_extract_all(h, '..')) AS byte, unnest(range(len(h) // 2)) AS i FROM (SELECT doc_id, hex(encode(text)) AS h FROM {0}))), bc AS (SELECT doc_id, byte{2}, count(*) AS n FROM bytes GROUP BY ALL)"
_ENT = "ent AS (SELECT doc_id{0}, CAST(sum(n) AS BIGINT) AS n_bytes, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM bc GROUP BY ALL)"


@query("v28_entropy", f"WITH {_BC.format('documents', '', '')}, {_ENT.format('')} SELECT doc_id, n_bytes, entropy FROM ent")
def _(spark, sf_dir):
    return E.entropy(E.byte_counts(spread(table(spark, sf_dir, "documents")), "doc_id", "text"), ["doc_id"])


_X = "(entropy / 8 - 0.3) / (0.8 - 0.3)"
_DIM = "CAST(CASE WHEN entropy / 8 <= 0.3 THEN 10000 WHEN entropy / 8 >= 0.8 THEN 250000 ELSE round(10000 + {0} * 240000) END AS BIGINT)"


@query("v29_adaptive_dimension", f"WITH {_BC.format('documents', '', '')}, {_ENT.format('')} SELECT doc_id, {_DIM.format(_X)} AS linear, {_DIM.format(f'log2(1 + {_X})')} AS logarithmic, {_DIM.format(f'floor({_X} * 4) / 4')} AS stepped FROM ent")
def _(spark, sf_dir):
    e = E.entropy(E.byte_counts(spread(table(spark, sf_dir, "documents")), "doc_id", "text"), ["doc_id"])
    share = F.col("entropy") / 8
    return e.select("doc_id", *[E.select_dimension(share, c).alias(c) for c in ("linear", "logarithmic", "stepped")])


@query("v30_outlier_regions", f"WITH {_BC.format('documents', ', CAST(i // 64 AS INTEGER) AS block', ', block')}, {_ENT.format(', block')}, g AS (SELECT doc_id, block, block - row_number() OVER (PARTITION BY doc_id ORDER BY block) AS g FROM ent WHERE entropy >= 4.3) SELECT doc_id, min(block) AS first_block, max(block) AS last_block FROM g GROUP BY doc_id, g")
def _(spark, sf_dir):
    return E.outlier_regions_of(table(spark, sf_dir, "documents"), "doc_id", "text", 64, 4.3)


@query("v19_ngrams", "SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM (SELECT list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM documents)) GROUP BY gram HAVING count(*) >= 5")
def _(spark, sf_dir):
    return E.ngram_counts(cut(table(spark, sf_dir, "documents"), "text"), "text", 2, 5)


@query("a8_compression_ratio", f"WITH {FILES}, s AS (SELECT source, CAST(sum(size) AS BIGINT) AS original, CAST(sum(CASE WHEN lang = 'en' THEN size // 3 ELSE 0 END) AS BIGINT) AS encoded FROM files GROUP BY source) SELECT source, CASE WHEN encoded = 0 OR original = 0 THEN 'N/A' ELSE CAST(encoded * 10000 // original // 100 AS VARCHAR) || '.' || lpad(CAST(encoded * 10000 // original % 100 AS VARCHAR), 2, '0') END AS ratio FROM s")
def _(spark, sf_dir):
    s = document_files(spark, sf_dir).groupBy("source").agg(F.sum("size").alias("o"), F.sum(F.when(F.col("lang") == "en", F.expr("size div 3")).otherwise(0)).alias("e"))
    return s.select("source", G.compression_ratio(F.col("e"), F.col("o")).alias("ratio"))


@query("a9_directory_rollup", f"WITH {FILES} SELECT source, lang, CASE WHEN grouping(source) = 1 THEN 0 WHEN grouping(lang) = 1 THEN 1 ELSE 2 END::BIGINT AS n_grouped, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY ROLLUP (source, lang)")
def _(spark, sf_dir):
    return G.directory_rollup(document_files(spark, sf_dir), ["source", "lang"], "size")


@query("a10_percentiles", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stddev, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def _(spark, sf_dir):
    return G.distribution(table(spark, sf_dir, "events"), ["event_type"], "value")


@query("a10_histogram", "SELECT CAST(CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 11 ELSE floor(value / 10) + 1 END AS BIGINT) AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def _(spark, sf_dir):
    return G.histogram(table(spark, sf_dir, "events"), "value", 0.0, 100.0, 10)


@query("a11_counters_gauges", "SELECT user_id, event_type, count(*) AS counter, arg_max(value, struct_pack(t := ts, v := value)) AS gauge, max(value) AS peak FROM events GROUP BY user_id, event_type")
def _(spark, sf_dir):
    return G.counters(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", "ts")


@query("a12_order_statistics", "SELECT o_orderpriority, count(o_totalprice) AS n, round(avg(o_totalprice), 6) AS mean, round(stddev_pop(o_totalprice), 6) AS stddev, round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(quantile_cont(o_totalprice, 0.95), 6) AS p95, round(quantile_cont(o_totalprice, 0.99), 6) AS p99 FROM orders GROUP BY o_orderpriority")
def _(spark, sf_dir):
    return G.distribution(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")


@query("a1_bundle_lineitem", "SELECT l_suppkey, CAST((l_partkey * 7 + l_linenumber) % 64 AS INTEGER) AS dim, CAST(sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) AS BIGINT) AS votes FROM lineitem GROUP BY ALL")
def _(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % D).cast("int").alias("dim"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("trit"))
    return A.votes(li, ["l_suppkey"])


@query("t3_threshold_alerts", "SELECT event_id, user_id, value FROM events WHERE value >= 90")
def _(spark, sf_dir):
    from ..streaming import alerts

    return alerts(table(spark, sf_dir, "events"), "value", 90.0).select("event_id", "user_id", "value")


@query("t6_tumbling_window", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    from ..streaming import windowed

    w = windowed(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", None, ["event_type"], "value")
    return w.select(F.unix_micros("start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


@query("t6_sliding_window", "SELECT epoch_us(time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE) AS start_us, count(*) AS n FROM events, range(2) AS r(k) GROUP BY 1")
def _(spark, sf_dir):
    from ..streaming import windowed

    w = windowed(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "30 minutes", [], "value")
    return w.select(F.unix_micros("start").alias("start_us"), "n")


@query("t6_session_window", "WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM o) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, sid")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


@query("t5_bundle_state", f"WITH {T}, {P} SELECT label, dim, votes FROM votes")
def _(spark, sf_dir):
    from ..streaming import bundle_state

    return bundle_state(labelled(spark, sf_dir), ["label"])


@query("s20_prometheus", "SELECT 'events_total{type=\"' || event_type || '\",user=\"' || user_id || '\"} ' || count(*) AS line FROM events GROUP BY event_type, user_id")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return c.select(X.prometheus_line(F.lit("events_total"), {"type": F.col("event_type"), "user": F.col("user_id")}, F.col("n")).alias("line"))


@query("s16_json_roundtrip", "SELECT doc_id, text, n_chars FROM documents")
def _(spark, sf_dir):
    j = table(spark, sf_dir, "documents").select(F.to_json(F.struct("doc_id", "text", "n_chars"), {"ignoreNullFields": "false"}).alias("j"))
    return j.select(F.from_json("j", "doc_id bigint, text string, n_chars bigint").alias("r")).select("r.*")


@query("s15_envelope", "SELECT doc_id, 'text' AS kind, CAST(strlen(text) AS BIGINT) AS length, sha256(text) AS sha256, true AS intact FROM documents")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "documents").select("doc_id", X.envelope(F.lit("text"), F.col("text")).alias("e"))
    return e.select("doc_id", "e.kind", "e.length", "e.sha256", X.envelope_intact(F.col("e")).alias("intact"))


@query("u7_traceparent", "SELECT event_id, '00-' || md5(CAST(user_id AS VARCHAR)) || '-' || substr(md5(CAST(event_id AS VARCHAR)), 1, 16) || '-01' AS traceparent FROM events")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.traceparent(F.col("user_id"), F.col("event_id")).alias("traceparent"))


@query("p8_content_class", "SELECT doc_id, CASE WHEN len(regexp_replace(coalesce(text, ''), '[^\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) <= 0.05 * len(coalesce(text, '')) THEN 'text' ELSE 'binary' END AS content_class FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.content_class(F.coalesce("text", F.lit(""))).alias("content_class"))


@query("x6_path_components", "SELECT page_id, CAST(i AS INTEGER) AS level, parts[i + 1] AS part FROM (SELECT page_id, parts, unnest(range(len(parts))) AS i FROM (SELECT page_id, list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: x <> '') AS parts FROM pages))")
def _(spark, sf_dir):
    parts = X.path_parts(F.regexp_replace("url", "^[a-z]+://", ""))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(parts).alias("level", "part"))


@query("p10_info", f"WITH {FILES} SELECT lang, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(max(size) AS BIGINT) AS largest FROM files GROUP BY lang")
def _(spark, sf_dir):
    return document_files(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))
