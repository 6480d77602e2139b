"""Deterministic sparse vectors from MD5, and position-aware encoding of bytes.

``dim`` of draw k of vector (kind, id) is the first 8 hexadecimal digits of md5('kind|id|k') modulo ``dims``, its trit
is +1 for even k and -1 for odd k; of draws that meet in one dim the lowest k wins. Any engine with MD5 gives the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..shared import ship

DIMS, DRAWS, CHUNK = 10_000, 200, 8
#: name, dims, density
PRESETS = [("small", 1_000, 0.02), ("medium", 10_000, 0.01), ("large", 100_000, 0.005), ("huge", 1_000_000, 0.001)]


def drawn_dim(kind: Column, ident: Column, k: Column, dims: int) -> Column:
    digest = F.md5(F.concat_ws("|", kind, ident.cast("string"), k.cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % dims).cast("int")


def random_vectors(ids: DataFrame, kind: str, ident: str, dims: int = DIMS, draws: int = DRAWS) -> DataFrame:
    """One vector for each distinct id of ``ids``: (ident, dim, trit). The draws of a vector are made, and those that meet
    in one dim settled, in its own row; only the ids are shuffled."""
    drawn = F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda k: drawn_dim(F.lit(kind), F.col(ident), k, dims))
    rows = ids.select(ident).distinct().select(ident, drawn.alias("__d"))
    rows = rows.select(ident, "__d", F.explode(F.array_distinct("__d")).alias("dim"))
    return rows.select(ident, "dim", F.when(F.array_position("__d", F.col("dim")) % 2 == 1, 1).otherwise(-1).cast("int").alias("trit"))


def codebook(spark: SparkSession, kind: str, size: int, dims: int = DIMS, draws: int = DRAWS) -> DataFrame:
    """(id, dim, trit) for ids 0 to size - 1."""
    return random_vectors(spark.range(size).select(F.col("id").cast("int").alias("id")), kind, "id", dims, draws)


def bound_codebook(spark: SparkSession, chunk: int = CHUNK, dims: int = DIMS, draws: int = DRAWS) -> DataFrame:
    """(pos, byte, dim, trit): position vectors bound with byte vectors; about draws**2 / dims rows for each pair."""
    positions = codebook(spark, "pos", chunk, dims, draws).withColumnRenamed("id", "pos")
    values = codebook(spark, "byte", 256, dims, draws).select(F.col("id").alias("byte"), "dim", F.col("trit").alias("b"))
    return positions.join(values, "dim").select("pos", "byte", "dim", (F.col("trit") * F.col("b")).cast("int").alias("trit"))


def byte_rows(files: DataFrame, ident: str, data: str, chunk: int = CHUNK) -> DataFrame:
    """(ident, chunk_no, pos, byte) of every byte; strings are taken as UTF-8."""
    pairs = F.regexp_extract_all(F.hex(F.col(data).cast("binary")), F.lit(".."), F.lit(0))
    rows = files.select(ident, F.posexplode(pairs).alias("__i", "__b"))
    byte = F.conv("__b", 16, 10).cast("int")
    return rows.select(ident, F.floor(F.col("__i") / chunk).cast("int").alias("chunk_no"), (F.col("__i") % chunk).cast("int").alias("pos"), byte.alias("byte"))


def encode_chunks(rows: DataFrame, bound: DataFrame, ident: str) -> DataFrame:
    """Chunk engrams (ident, chunk_no, dim, trit). The bound codebook has a fixed size, so it is broadcast."""
    joined = rows.join(F.broadcast(bound), ["pos", "byte"])
    counted = joined.groupBy(ident, "chunk_no", "dim").agg(F.sum("trit").alias("v"))
    return counted.where("v <> 0").select(ident, "chunk_no", "dim", F.signum("v").cast("int").alias("trit"))


def decode_chunks(engrams: DataFrame, bound: DataFrame, ident: str) -> DataFrame:
    """Nearest byte of each place of each chunk: (ident, chunk_no, pos, decoded, score); ties to the lowest byte.

    Unbinding every position and comparing with every byte vector is one join with the bound codebook.
    """
    codes = bound.select("dim", "pos", "byte", F.col("trit").alias("b"))
    scores = engrams.join(F.broadcast(codes), "dim").groupBy(ident, "chunk_no", "pos", "byte").agg(F.sum(F.col("trit") * F.col("b")).alias("s"))
    best = scores.groupBy(ident, "chunk_no", "pos").agg(F.max(F.struct(F.col("s"), (-F.col("byte")).alias("n"))).alias("m"))
    return best.select(ident, "chunk_no", "pos", (-F.col("m.n")).cast("int").alias("decoded"), F.col("m.s").cast("bigint").alias("score"))


class BoundCodes:
    """The bound codebook as arrays: entries ordered by (pos, byte), and by dim."""

    def __init__(self, rows: list[tuple[int, int, int, int]], chunk: int) -> None:
        self.chunk = chunk
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
        self.code, self.dim, self.trit = table[:, 0] * 256 + table[:, 1], table[:, 2], table[:, 3]
        self.first = np.searchsorted(self.code, np.arange(chunk * 256 + 1))
        by_dim = np.argsort(self.dim, kind="stable")
        self.dims = int(self.dim.max(initial=-1)) + 1
        self.code_by_dim, self.trit_by_dim = self.code[by_dim], self.trit[by_dim]
        self.first_by_dim = np.searchsorted(self.dim[by_dim], np.arange(self.dims + 1))

    def encode(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chunk_no, dim, trit) of all chunks: signs of the sums of their bytes' vectors; zeros are left out."""
        raw = np.frombuffer(data, np.uint8).astype(np.int64)
        at = np.arange(len(raw))
        code = at % self.chunk * 256 + raw
        entry, size = _ranges(self.first, code)
        key = np.repeat(at // self.chunk * self.dims, size) + self.dim[entry]
        found, sums = _sums(key, self.trit[entry])
        found, sums = found[sums != 0], np.sign(sums[sums != 0])
        return found // self.dims, found % self.dims, sums

    def decode(self, chunk_no: np.ndarray, dim: np.ndarray, trit: np.ndarray) -> tuple[np.ndarray, ...]:
        """(chunk_no, pos, byte, score): the nearest byte of each place, ties to the lowest; places no code of which
        shares a dim with the chunk are left out."""
        known = dim < self.dims
        chunk_no, dim, trit = chunk_no[known], dim[known], trit[known]
        entry, size = _ranges(self.first_by_dim, dim)
        key = np.repeat(chunk_no, size) * (self.chunk * 256) + self.code_by_dim[entry]
        found, score = _sums(key, np.repeat(trit, size) * self.trit_by_dim[entry])
        place = found // 256
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(found) else np.zeros(0, np.int64)
        best = np.maximum.reduceat(score * 256 + 255 - found % 256, first) if len(first) else first
        place = place[first]
        return place // self.chunk, place % self.chunk, 255 - best % 256, best // 256


def _sums(key: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys in order, each once, and the sums of their signs (-1 or 1): one sort of plain numbers."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = key * 2 + (sign > 0)
    both = np.sort(both.astype(np.int32) if both.max() < 1 << 31 else both)
    key = both >> 1
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first].astype(np.int64), np.add.reduceat((both & 1).astype(np.int64) * 2 - 1, first)


def _ranges(first: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All entries first[x], ..., first[x + 1] - 1 for each x of ``of``, and how many each has."""
    size = first[of + 1] - first[of]
    ends = np.cumsum(size)
    return np.repeat(first[of] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0), size


def bound_codes(spark: SparkSession, chunk: int = CHUNK, dims: int = DIMS, draws: int = DRAWS) -> BoundCodes:
    """The bound codebook has a fixed size (about chunk * 256 * draws**2 / dims rows), so it comes to the driver."""
    rows = bound_codebook(spark, chunk, dims, draws).select("pos", "byte", "dim", "trit").collect()
    return BoundCodes([tuple(r) for r in rows], chunk)


#: Bytes of a row that are worked on at once.
PIECE = 1 << 16


def _by_pieces(files: DataFrame, ident: str, data: str, codes: BoundCodes, names: list[str], work) -> DataFrame:
    """``work(codes, bytes)`` gives columns of long, chunk_no first, for pieces of whole chunks of each row."""
    schema = T.StructType([T.StructField(ident, files.schema[ident].dataType), *[T.StructField(x, T.LongType() if x == "score" else T.IntegerType()) for x in names]])
    ship(files.sparkSession)
    arrow, shared = to_arrow_schema(schema), files.sparkSession.sparkContext.broadcast(codes)
    piece = PIECE // codes.chunk * codes.chunk

    def run(batches):
        for batch in batches:
            for k, raw in enumerate(batch.column(1).to_pylist()):
                for at in range(0, len(raw or b""), piece):
                    columns = list(work(shared.value, raw[at : at + piece]))
                    columns[0] = columns[0] + at // shared.value.chunk
                    n = len(columns[0])
                    own = batch.column(0).take(pa.array(np.full(n, k)))
                    arrays = [own, *[pa.array(c, mask=c < 0 if name == "decoded" else None).cast(f.type) for c, name, f in zip(columns, names, list(arrow)[1:], strict=True)]]
                    yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return files.select(ident, F.col(data).cast("binary").alias("__data")).mapInArrow(run, schema)


def encode_files(files: DataFrame, codes: BoundCodes, ident: str, data: str) -> DataFrame:
    """Chunk engrams (ident, chunk_no, dim, trit) of each row's bytes, without any shuffle.

    Rows with equal ids are encoded one by one; null and empty data give no chunk; strings are taken as UTF-8.
    """
    return _by_pieces(files, ident, data, codes, ["chunk_no", "dim", "trit"], lambda codes, raw: codes.encode(raw))


def decode_files(files: DataFrame, codes: BoundCodes, ident: str, data: str) -> DataFrame:
    """What :func:`decode_chunks` makes of :func:`encode_files`, in one step: (ident, chunk_no, pos, decoded, score)."""
    return _by_pieces(files, ident, data, codes, ["chunk_no", "pos", "decoded", "score"], lambda codes, raw: codes.decode(*codes.encode(raw)))


def compared_files(files: DataFrame, codes: BoundCodes, ident: str, data: str) -> DataFrame:
    """(ident, chunk_no, pos, byte, decoded) of every byte, as :func:`compared`, in one step."""
    return _by_pieces(files, ident, data, codes, ["chunk_no", "pos", "byte", "decoded"], _compare)


def _compare(codes: BoundCodes, raw: bytes) -> tuple[np.ndarray, ...]:
    """chunk_no, pos, byte and decoded byte (-1: none) of every byte."""
    original = np.frombuffer(raw, np.uint8).astype(np.int64)
    at = np.arange(len(original))
    decoded = np.full(len(original), -1)
    chunk_no, pos, byte, _ = codes.decode(*codes.encode(raw))
    place = chunk_no * codes.chunk + pos
    inside = place < len(original)
    decoded[place[inside]] = byte[inside]
    return at // codes.chunk, at % codes.chunk, original, decoded


def _totals(files: DataFrame, ident: str, data: str, codes: BoundCodes, names: list[str], work) -> DataFrame:
    """(ident, names...) as longs: what ``work(codes, bytes, first chunk)`` gives for pieces of whole chunks of each row."""
    schema = T.StructType([T.StructField(ident, files.schema[ident].dataType), *[T.StructField(x, T.LongType()) for x in names]])
    ship(files.sparkSession)
    arrow, shared = to_arrow_schema(schema), files.sparkSession.sparkContext.broadcast(codes)
    piece = PIECE // codes.chunk * codes.chunk

    def run(batches):
        for batch in batches:
            of, rows = [], []
            for k, raw in enumerate(batch.column(1).to_pylist()):
                for at in range(0, len(raw or b""), piece):
                    rows += (new := work(shared.value, raw[at : at + piece], at // shared.value.chunk))
                    of += [k] * len(new)
            if rows:
                columns = [pa.array([int(r[c]) for r in rows], pa.int64()) for c in range(len(names))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)).cast(arrow.field(0).type), *columns], schema=arrow)

    return files.select(ident, F.col(data).cast("binary").alias("__data")).mapInArrow(run, schema)


def _engram_totals(codes: BoundCodes, raw: bytes, first: int) -> list[tuple]:
    """A row for each run of chunks that have trits: first and last chunk; the first row holds the piece's trits and checksum."""
    chunk_no, dim, trit = codes.encode(raw)
    if not len(trit):
        return []
    chunk_no = chunk_no + first
    held = chunk_no[np.r_[True, chunk_no[1:] != chunk_no[:-1]]]
    starts = np.flatnonzero(np.r_[True, np.diff(held) > 1])
    ends = np.r_[starts[1:], len(held)] - 1
    total = len(trit), int((trit * (dim + 1) * (chunk_no % 1000 + 1)).sum())
    return [(held[a], held[b], *(total if not n else (0, 0))) for n, (a, b) in enumerate(zip(starts, ends, strict=True))]


def engram_totals(files: DataFrame, codes: BoundCodes, ident: str, data: str) -> DataFrame:
    """(ident, n_chunks, nnz, checksum) of the engrams of :func:`encode_files`, which stay in the task that makes them.

    n_chunks: distinct chunks with a trit, over all rows of an id; checksum: the sum of
    trit * (dim + 1) * (chunk_no % 1000 + 1). Ids without trits give no row.
    """
    runs = _totals(files, ident, data, codes, ["first", "last", "nnz", "checksum"], _engram_totals)
    per = runs.groupBy(ident).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"), F.sum("nnz").alias("nnz"), F.sum("checksum").alias("checksum"))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("upto"))
    joined = F.aggregate("runs", start, lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["last"] - F.greatest(r["first"] - 1, s["upto"]))).alias("n"), F.greatest(s["upto"], r["last"]).alias("upto")))
    return per.select(ident, joined["n"].alias("n_chunks"), "nnz", "checksum")


def _accuracy_totals(codes: BoundCodes, raw: bytes, first: int) -> list[tuple]:
    _, _, byte, decoded = _compare(codes, raw)
    return [(len(byte), (byte == decoded).sum(), ((byte - np.maximum(decoded, 0)) ** 2).sum())]


def accuracy_totals(files: DataFrame, codes: BoundCodes, ident: str, data: str) -> DataFrame:
    """(ident, n_bytes, n_right, off): the bytes of :func:`compared_files` counted in the task that decodes them; off is the
    sum of squared differences, with 0 for a byte that no code came back for."""
    pieces = _totals(files, ident, data, codes, ["n_bytes", "n_right", "off"], _accuracy_totals)
    return pieces.groupBy(ident).agg(*[F.sum(x).alias(x) for x in ("n_bytes", "n_right", "off")])


def compared(rows: DataFrame, decoded: DataFrame, ident: str) -> DataFrame:
    """Every original byte beside what decoding gave (null where no code came back)."""
    return rows.join(decoded, [ident, "chunk_no", "pos"], "left").select(ident, "chunk_no", "pos", "byte", "decoded")


def corrections(compared_rows: DataFrame, ident: str) -> DataFrame:
    """The bytes that decoding gets wrong: (ident, chunk_no, pos, byte)."""
    return compared_rows.where(~F.col("byte").eqNullSafe(F.col("decoded"))).select(ident, "chunk_no", "pos", "byte")


def correction_kinds(compared_rows: DataFrame, ident: str) -> DataFrame:
    """Per chunk: n_bytes, errors and the kind of correction to store.

    The rules are tried in this order. Errors are clustered when their span is at most twice their number.
    """
    wrong = ~F.col("byte").eqNullSafe(F.col("decoded"))
    per = compared_rows.groupBy(ident, "chunk_no").agg(F.count("*").alias("n_bytes"), F.count_if(wrong).alias("errors"), F.min(F.when(wrong, F.col("pos"))).alias("lo"), F.max(F.when(wrong, F.col("pos"))).alias("hi"))
    clustered = (F.col("hi") - F.col("lo") + 1) <= 2 * F.col("errors")
    kind = (
        F.when(F.col("errors") == 0, "none")
        .when((F.col("errors") < 10) & ~clustered, "bit_flips")
        .when((F.col("errors") < 50) & clustered, "block_replace")
        .when(F.col("errors") / F.col("n_bytes") > 0.3, "verbatim")
        .otherwise("trit_flips")
    )
    return per.select(ident, "chunk_no", "n_bytes", "errors", kind.alias("kind"))


def reconstruct(decoded: DataFrame, fixes: DataFrame, sizes: DataFrame, ident: str, chunk: int = CHUNK) -> DataFrame:
    """Files (ident, hex) from decoded chunks and corrections; ``sizes`` (ident, size) is the manifest's.

    Bytes are joined into chunks first, keyed by file and chunk, and chunks into files then.
    """
    fixed = fixes.select(ident, "chunk_no", "pos", F.col("byte").alias("right"))
    places = decoded.select(ident, "chunk_no", "pos", "decoded").join(fixed, [ident, "chunk_no", "pos"], "full")
    at = F.col("chunk_no").cast("bigint") * chunk + F.col("pos")
    byte = F.lpad(F.hex(F.coalesce("right", "decoded").cast("bigint")), 2, "0")
    placed = places.select(ident, "chunk_no", "pos", at.alias("at"), byte.alias("b")).join(sizes, ident).where("at < size")
    joined = lambda place, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, text))), lambda x: x[text]), "")
    chunks = placed.groupBy(ident, "chunk_no").agg(joined("pos", "b").alias("c"))
    return chunks.groupBy(ident).agg(joined("chunk_no", "c").alias("hex"))
