"""SimHash near-duplicates by deletion-variant signatures.

A document's fingerprint has 64 bits; a bit is one if it is set in over half of the hashes (XXH64, seed 42) of the
document's word shingles. Fingerprints that differ in at most ``bits`` bits are linked; a document's component
is named by the smallest id that links reach.

Finding links. Identical fingerprints are merged before anything else, so copies cost nothing later. A fingerprint
is cut into ``bits // 2 + 1`` segments, fewer than the ``bits + 1`` that exact segments need: by the pigeonhole
principle, some segment of a linked pair differs in at most one bit. Every segment is indexed once for each of its
bits, with that bit as a wildcard: 64 keys for a fingerprint. Two fingerprints whose segments differ in at most one
bit meet in a bucket of equal keys, where the full distance is verified.

Within a bucket no list of pairs is made. The bucket is searched breadth-first: a reached fingerprint is compared
with those not yet reached only, and the bucket gives one link from each reached fingerprint to the smallest of its
group. A dense group of n near copies so costs about n comparisons and gives n - 1 links, and no link between
different groups is lost. A bucket of over ``most`` fingerprints is not searched in one task: its members go on to
another round, keyed by the bucket and by one-wildcard segments of the bits that the bucket has not fixed yet. Two
fingerprints that are linked and meet in a bucket differ in at most ``bits`` of those too, so they meet again. There are
``again`` such rounds; each multiplies the members of large buckets by the bits that are left (43, then 28), and the last
searches what it holds: with 45 bits fixed, a bucket can't have over 2 ** 22 distinct fingerprints, of 32 MB.

Links become components by alternating contraction (every node points to its smallest neighbour, larger neighbours
are handed down) to the fixed point, with minima taken by map-side aggregation and each round written to the shared
folder; neither links nor components come to the driver, only counts. Where many rows look up one hub or root, the
looked-up table is broadcast if it is counted to be small, else both sides are salted.

Defined results: a null, empty or wordless text has fingerprint zero and is linked like any other; fewer words than
a shingle are one shingle; rows with equal ids each get their row; a row with a null id takes part, and a component
of such rows alone has a null name. An empty table gives an empty result; other columns are not looked at, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, map_rows, removed, ship, table, written

SHINGLE, BITS, SEED = 4, 4, 42
#: Fingerprints of a bucket that are searched in one task.
MOST = 20_000
#: Further rounds for buckets of more.
AGAIN = 2
#: Tables of at most so many rows of two numbers are broadcast; keys of larger ones are salted.
BROADCAST, SALTS = 200_000, 16
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a whole text; bytes.split() parts words at exactly 09-0D and 20."""
    found = text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []
    if not found:
        return 0
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    n = max(1, len(found) - shingle + 1)
    if n == 1:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum([len(x) + 1 for x in found])
        starts = [0, *ends[: n - 1].tolist()]
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    votes = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 65536):
        part = np.array(hashes[k : k + 65536], dtype=">u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def _step(shingle: int):
    def step(batch: pa.RecordBatch) -> dict:
        marks = [fingerprint(x, shingle) for x in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "mark": np.array(marks, dtype=np.uint64).view(np.int64)}

    return step


def _hashed_step(shingle: int):
    def step(batch: pa.RecordBatch) -> dict:
        return _step(shingle)(batch) | {"h": batch.column(2)}

    return step


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and mark: the fingerprint's 64 bits as a signed long."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_rows(docs, ["doc_id", "text"], _step, "doc_id bigint, mark bigint", shingle)


def segments(bits: int, of: range | list[int] = range(64)) -> list[list[int]]:
    """The positions of ``of`` in ``bits // 2 + 1`` runs of nearly equal length."""
    n, places = bits // 2 + 1, list(of)
    return [places[k * len(places) // n : (k + 1) * len(places) // n] for k in range(n)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _variants(bits: int, left: int = (1 << 64) - 1) -> list[tuple[int, int, int, int]]:
    """For each segment of the bits ``left`` and each of its bits as a wildcard: both, the mask of the segment's other
    bits, and the bits that are left then; masks as signed longs."""
    runs = segments(bits, [b for b in range(64) if left >> b & 1])
    mask = lambda run: sum(1 << b for b in run)
    return [(k, wild, _signed(mask(run) - (1 << wild)), _signed(left & ~mask(run))) for k, run in enumerate(runs) for wild in run]


def _groups(marks: np.ndarray, bits: int) -> np.ndarray:
    """For distinct, sorted fingerprints: the index of the first of each one's group of linked fingerprints."""
    first = np.arange(len(marks))
    left = np.arange(len(marks))
    while len(left):
        root, left = left[0], left[1:]
        frontier = [root]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(marks[left] ^ marks[at]) <= bits
            reached = left[near]
            if len(reached):
                first[reached] = root
                frontier.extend(reached.tolist())
                left = left[~near]
    return first


LINKS = "key bigint, left bigint, a bigint, b bigint"
_links_schema = pa.schema([(x, pa.int64()) for x in ("key", "left", "a", "b")])


def _batch(key, left, a: np.ndarray, b: np.ndarray | None = None) -> pa.RecordBatch:
    full = lambda x: pa.array(np.full(len(a), x, np.int64))
    return pa.RecordBatch.from_arrays([full(key), full(left), pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64())], schema=_links_schema)


def _bucket_links(bits: int, most: int):
    """Rows sorted by (key, mark) to links (a > b); those of too large a bucket come back as they are, b null.

    A bucket of the last round, with 0 for the bits left, is searched whatever its size.
    """

    def searched(parts):
        marks = np.unique(np.concatenate(parts))
        first = _groups(marks.view(np.uint64), bits)
        linked = np.flatnonzero(first != np.arange(len(marks)))
        return marks[linked], marks[first[linked]]

    def run(batches):
        held: list[np.ndarray] = []
        held_key, count, over = None, 0, False
        found_a: list[np.ndarray] = []
        found_b: list[np.ndarray] = []

        def close():
            if count > 1 and not over:
                a, b = searched(held)
                found_a.append(a)
                found_b.append(b)

        for batch in batches:
            key, left, mark = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            bounds = np.concatenate(([0], cuts, [len(key)]))
            sizes = np.diff(bounds)
            for i in np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == len(sizes) - 1)) if len(key) else ():
                lo, hi = bounds[i], bounds[i + 1]
                if key[lo] != held_key:
                    close()
                    held, held_key, count, over = [], key[lo], 0, False
                count += hi - lo
                if count > most and left[lo]:
                    for part in held:
                        yield _batch(held_key, left[lo], part)
                    over, held = True, []
                    yield _batch(held_key, left[lo], mark[lo:hi])
                else:
                    held.append(mark[lo:hi].copy())
            if sum(map(len, found_a)) > 50_000:
                yield _batch(0, 0, np.concatenate(found_a), np.concatenate(found_b))
                found_a, found_b = [], []
        close()
        if found_a:
            yield _batch(0, 0, np.concatenate(found_a), np.concatenate(found_b))

    return run


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix (additions and multiplications wrap)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keyed_again(bits: int, last: bool):
    """Members of too large buckets (key, left, mark) to the keys of the next round, on the bits that are left."""

    def run(batches):
        for batch in batches:
            key, left, mark = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            for rest in np.unique(left).tolist():
                at = left == rest
                of, marks = key[at].view(np.uint64), mark[at]
                for k, wild, mask, now_left in _variants(bits, rest & (1 << 64) - 1):
                    salt = np.uint64((k << 8 | wild) + 1)
                    new = _mixed(_mixed(of + salt) ^ (marks & np.int64(mask)).view(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), pa.array(np.full(len(new), 0 if last else now_left, np.int64)), pa.array(marks)], names=["key", "left", "mark"])

    return run


def _in_buckets(keyed: DataFrame, bits: int, most: int) -> DataFrame:
    """keyed: key, left, mark."""
    dealt = keyed.repartition("key").sortWithinPartitions("key", "mark")
    return dealt.mapInArrow(_bucket_links(bits, most), LINKS)


def links(marks: DataFrame, *, bits: int = BITS, most: int = MOST, again: int = AGAIN) -> DataFrame:
    """Links (a, b), b < a, that join exactly the distinct fingerprints of ``marks`` (column mark) at ``bits`` or fewer."""
    ship(marks.sparkSession)
    keys = F.array(*[F.struct(F.xxhash64(F.lit(k), F.lit(wild), F.col("mark").bitwiseAND(F.lit(mask))).alias("key"), F.lit(left if again else 0).alias("left")) for k, wild, mask, left in _variants(bits)])
    keyed = marks.select(F.explode(keys).alias("x"), "mark").select("x.key", "x.left", "mark")
    done = None
    for to_go in range(again, -1, -1):
        found, _ = written(_in_buckets(keyed, bits, most), "links")
        new = found.where("b is not null").select("a", "b")
        done = new if done is None else done.unionByName(new)
        over = found.where("b is null").select("key", "left", F.col("a").alias("mark"))
        if not to_go or not over.limit(1).count():
            break
        keyed = over.mapInArrow(_keyed_again(bits, to_go == 1), "key bigint, left bigint, mark bigint")
    return done.distinct()


def looked_up(rows: DataFrame, key: str, values: DataFrame, of: str, *, broadcast: int = BROADCAST, salts: int = SALTS) -> DataFrame:
    """``rows`` joined with ``values``, which has one row for each ``of``, on key = of; any key may be in most rows."""
    values, _ = written(values, "values")
    if values.count() <= broadcast:
        return rows.join(F.broadcast(values), F.col(key) == F.col(of))
    each = values.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("__s", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    return salted.join(each, (F.col(key) == F.col(of)) & (F.col("__s") == F.col("__salt"))).drop("__s", "__salt")


def components(edges: DataFrame, *, broadcast: int = BROADCAST) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reached. Null-free longs.

    Each round hands a node's larger neighbours to the smallest (large star), then its smaller ones (small star),
    until nothing moves: then the edges are a forest of stars.
    """
    spark = edges.sparkSession
    edges, path = written(edges.where("a > b"), "edges")
    before = None
    while True:
        with Scratch(spark) as scratch:
            both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
            large, _ = written(looked_up(edges, "b", least, "n", broadcast=broadcast).select("a", F.col("m").alias("b")).distinct(), "edges")
            down = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
            small = looked_up(large, "a", down, "n", broadcast=broadcast).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            new, new_path = written(small.select("e.a", "e.b").where("a > b").distinct(), "edges")
            scratch.keep(new_path)
        removed(spark, path)
        edges, path = new, new_path
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == (now["n"], now["h"]):
            break
        before = (now["n"], now["h"])
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def classes(marks: DataFrame, *, bits: int = BITS, most: int = MOST, broadcast: int = BROADCAST) -> DataFrame:
    """(mark, root) of those of ``marks`` (distinct fingerprints, column mark) that are linked to another: the smallest
    fingerprint of the component. What is made on the way is removed."""
    spark = marks.sparkSession
    with Scratch(spark) as scratch:
        found, path = written(components(links(marks, bits=bits, most=most), broadcast=broadcast).withColumnsRenamed({"node": "mark"}), "classes")
        scratch.keep(path)
    return found


def _of_class(named: DataFrame, rooted: DataFrame, value: str, broadcast: int) -> DataFrame:
    """named: mark, ``value``; the smallest ``value`` of each fingerprint's component as ``least``."""
    mine = rooted.withColumnRenamed("mark", "__mark")
    linked = named.join(mine, F.col("mark") == F.col("__mark"))
    least = linked.groupBy(F.col("root").alias("__root")).agg(F.min(value).alias("least"))
    many = looked_up(mine, "root", least, "__root", broadcast=broadcast).select("__mark", "least")
    return named.join(many, F.col("mark") == F.col("__mark"), "left").select("mark", F.coalesce("least", value).alias("least"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = BITS, most: int = MOST, broadcast: int = BROADCAST) -> DataFrame:
    """Per document: doc_id, mark (fingerprint as a signed long), component_id."""
    marks, _ = written(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle), "marks")
    named = marks.groupBy("mark").agg(F.min("doc_id").alias("id"))
    rooted = classes(named.select("mark"), bits=bits, most=most, broadcast=broadcast)
    by_mark = _of_class(named, rooted, "id", broadcast).withColumnsRenamed({"mark": "__m", "least": "component_id"})
    return looked_up(marks, "mark", by_mark, "__m", broadcast=broadcast).select("doc_id", "mark", "component_id")


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = BITS, most: int = MOST, broadcast: int = BROADCAST) -> DataFrame:
    """The rows of ``docs``, whole, of which one stays of each component: that of the smallest id, nulls last; of rows
    with equal ids that of the smallest text hash, and of equal texts that of the smallest hash of all columns."""
    spark = docs.sparkSession
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.lit(1), F.col(text)).alias("h"))
    with Scratch(spark) as scratch:
        marks, _ = written(map_rows(keyed, ["doc_id", "text", "h"], _hashed_step, "doc_id bigint, h bigint, mark bigint", shingle), "marks")
        first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "h")
        named = marks.groupBy("mark").agg(F.min(first).alias("first"))
        rooted = classes(named.select("mark"), bits=bits, most=most, broadcast=broadcast)
        kept = _of_class(named, rooted, "first", broadcast).select(F.col("least.id").alias("__id"), F.col("least.h").alias("__h")).distinct()
        kept, path = written(kept, "kept")
        scratch.keep(path)
    mine = docs.withColumn("__own", F.xxhash64(F.lit(1), F.col(text)))
    mine = mine.join(kept, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__h")), "left_semi")
    nth = F.row_number().over(Window.partitionBy(doc_id, "__own").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))
    return mine.withColumn("__nth", nth).where("__nth = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def op9(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")
