"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are the runs ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text whose A-Z are lower-cased. A pattern is
a window of ``window`` consecutive words of a benchmark item; an item of fewer words is one shorter pattern.
For every pattern length there is a block-shift table (a block is two adjacent words): a block that no pattern
holds lets the scan jump over ``length - 1`` words, so most positions of a clean text are never looked at. Where
the shift is zero, the block is the suffix of some patterns; the suffix bucket, split again by the patterns'
first block, names them and a direct comparison of all words confirms.

Benchmark words are numbered, blocks are pairs of numbers, and a pattern is a place in the numbered benchmark, so the
tables take about 50 bytes for each byte of benchmark text. The benchmark is a stated set: repeated items are merged,
its text is summed, cut into blocks of at most ``block_bytes`` (so tables of about 200 MB in each worker) and each
block is broadcast in a pass of its own over the documents. A pass adds to the row it reads, so there is no
shuffle at any size; passes of one query run side by side in a task, each with its own tables, so benchmarks of
many blocks are better searched by one call for each part of them.

Defined results: a null or empty text has no words and no hit; an item whose text is null, or without words, is
never found; rows of the benchmark without an id still mark words but have no name in ``items``; repeated ids
count once; repeated documents each get their row; an empty benchmark marks nothing and empty documents give an empty
result; other columns are not looked at by :func:`find_items` and kept by :func:`clean`.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_right
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, pieces, ship, table

WINDOW = 10
BLOCK = 2
BLOCK_BYTES = 4 << 20
SCHEMA = "doc_id bigint, n_words bigint, spans array<struct<start:int,end:int>>, items array<string>"

#: Bytes to bytes: A-Z become a-z, 0-9 and a-z and all above 0x7F stay, the rest become a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


class WuManber:
    """Patterns of one length: shift table, and buckets of the patterns' places by the suffix block."""

    def __init__(self, length: int) -> None:
        self.length, self.size = length, min(BLOCK, length)
        self.numbers: dict[bytes, int] = {}
        self.stream = array("i")  # the numbered words of all items, one item after another
        self.items: list[str | None] = []
        self.firsts: list[int] = []  # where each item begins
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, array] = {}

    def add(self, found: list[bytes], item: str | None) -> None:
        """All windows of an item's words."""
        length, size, shift, buckets, numbers = self.length, self.size, self.shift, self.buckets, self.numbers
        first = len(self.stream)
        self.items.append(item)
        self.firsts.append(first)
        at = [numbers.setdefault(w, len(numbers)) for w in found]
        self.stream.extend(at)
        blocks = [a << 32 | b for a, b in pairwise(at)] if size == 2 else at
        for k, block in enumerate(blocks):  # the block ends at word k + size; a window of words ends at length or later
            least = max(0, length - size - k)
            if shift.get(block, length) > least:
                shift[block] = least
            if not least:
                if block not in buckets:
                    buckets[block] = array("i")
                buckets[block].append(first + k + size - length)

    def scan(self, text: list[bytes]):
        """Yields (start, items) of every occurrence."""
        length, size, shift, buckets, stream = self.length, self.size, self.shift, self.buckets, self.stream
        number = self.numbers.get
        at = array("i", [number(w, -1) for w in text])
        most, end, n = length - size + 1, length, len(at)
        two = size == 2
        while end <= n:
            b = at[end - 1]
            if b < 0:  # no pattern holds this word
                end += length
                continue
            a = at[end - 2] if two else 0
            block = (a << 32 | b if two else b) if a >= 0 else -1
            jump = shift.get(block, most)
            if not jump:
                start = end - length
                first, window = at[start], at[start:end]
                items = {self.items[bisect_right(self.firsts, p) - 1] for p in buckets[block] if stream[p] == first and stream[p : p + length] == window}
                if items:
                    yield start, items
                jump = 1
            end += jump


def matchers(items: list[tuple], window: int = WINDOW) -> list[WuManber]:
    by_length: dict[int, WuManber] = {}
    for item, text in items:
        found = words(text)
        length = min(window, len(found))
        if length:
            by_length.setdefault(length, WuManber(length)).add(found, None if item is None else str(item))
    return list(by_length.values())


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


_BUILT: dict = {}


def _built(shared, window: int, key: str) -> list[WuManber]:
    """key names the broadcast set, so that a reused worker builds its tables once."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = matchers(shared.value, window)
    return _BUILT[key]


def _step(shared, window: int, key: str, carry: bool):
    found_by = _built(shared, window, key)

    def step(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"n_words": [], "spans": [], "items": []}
        columns = [batch.column(k).to_pylist() for k in range(1, batch.num_columns)]
        for text, *before in zip(*columns, strict=True):
            text_words = words(text)
            spans = [(x["start"], x["end"]) for x in before[0]] if before else []
            items = set(before[1]) if before else set()
            for matcher in found_by:
                for start, named in matcher.scan(text_words):
                    spans.append((start, start + matcher.length))
                    items |= named
            out["n_words"].append(len(text_words))
            out["spans"].append([{"start": a, "end": b} for a, b in merged(spans)])
            out["items"].append(sorted(items - {None}))
        kept = {"text": batch.column(1)} if carry else {}
        return {"doc_id": batch.column(0)} | kept | out

    return step


def _blocks(items: DataFrame, item_id: str, item_text: str, window: int, block_bytes: int):
    """Yields (broadcast rows, key, whether it is the last) for each block of the benchmark."""
    items = items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("words")).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("n")).first()["n"]
    blocks = -(-2 * total // block_bytes) if total > block_bytes else 1
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("id", "words"), F.lit(blocks)) == k) if blocks > 1 else items
        rows = [(r["id"], r["words"]) for r in part.collect()]  # a block of a stated set, of bounded size
        key = hashlib.sha256(repr((window, rows)).encode()).hexdigest()
        yield items.sparkSession.sparkContext.broadcast(rows), key, k == blocks - 1


def find_items(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, spans of hit words (start, end; merged), items (sorted ids as strings)."""
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    columns = ["doc_id", "text"]
    for shared, key, last in _blocks(items, item_id, item_text, window, block_bytes):
        schema = SCHEMA if last else SCHEMA.replace("bigint,", "bigint, text string,", 1)
        found = map_rows(found, columns, _step, schema, shared, window, key, not last)
        columns = ["doc_id", "text", "spans", "items"]
    return found


def clean(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, whole, in which no benchmark passage occurs."""
    at, schema = docs.columns.index(text), docs.schema
    ship(docs.sparkSession)

    def without(shared, key):
        def run(batches):
            found_by = _built(shared, window, key)
            for batch in batches:
                for piece in pieces(batch):
                    all_words = map(words, piece.column(at).to_pylist())
                    yield piece.filter(pa.array([not any(True for m in found_by for _ in m.scan(w)) for w in all_words], pa.bool_()))

        return run

    for shared, key, _ in _blocks(items, item_id, item_text, window, block_bytes):
        docs = docs.mapInArrow(without(shared, key), schema)
    return docs


def report(found: DataFrame) -> DataFrame:
    """Counts and digest of :func:`find_items`."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + (s["end"] - s["start"]))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op10(spark, sf_dir: str) -> DataFrame:
    return report(find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


_FOLDED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _FOLDED + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS.format("text")}, []::VARCHAR[]) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least({WINDOW}, len(w)) AS n
      FROM (SELECT item_id, coalesce({_WORDS.format("text")}, []::VARCHAR[]) AS w FROM benchmark)),
p AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS pat
      FROM (SELECT item, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM b WHERE n > 0)),
lens AS (SELECT DISTINCT n FROM p),
dw AS (SELECT rid, n, k, array_to_string(w[k:k + n - 1], ' ') AS pat
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT DISTINCT rid, dw.n, k, item FROM dw JOIN p ON dw.n = p.n AND dw.pat = p.pat),
pos AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS x FROM (SELECT DISTINCT rid, n, k FROM hits)) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT rid, item FROM hits WHERE item IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
