"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def human_size(size: Column) -> Column:
    """Bytes in powers of 1024 with one decimal below ten, rounded up, as 1023, 1.0K, 12M; whole numbers of any type."""
    units = ["", "K", "M", "G", "T", "P"]
    out = size.cast("string")
    for k in range(1, len(units)):
        scaled = size.cast("double") / 1024**k
        small = F.format_string("%.1f%s", F.ceil(scaled * 10) / 10, F.lit(units[k]))
        large = F.concat(F.ceil(scaled).cast("string"), F.lit(units[k]))
        out = F.when(size >= 1024**k, F.when(F.ceil(scaled * 10) < 100, small).otherwise(large)).otherwise(out)
    return out


def traceparent(trace: Column, span: Column) -> Column:
    """W3C trace context of two keys, by MD5."""
    return F.format_string("00-%s-%s-01", F.md5(trace.cast("string")), F.substring(F.md5(span.cast("string")), 1, 16))


def checksum(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)


def md5_int(value: Column, modulus: int) -> Column:
    """First 8 hexadecimal digits of the MD5, modulo ``modulus``: the shift of a path."""
    return (F.conv(F.substring(F.md5(value.cast("string")), 1, 8), 16, 10).cast("bigint") % modulus).cast("int")


def printable_share(text: Column) -> Column:
    """Share of characters that are not control characters other than tab and line ends; 1 for empty text."""
    control = F.length(F.regexp_replace(text, r"[^\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))
    return F.when(F.length(text) > 0, 1 - control / F.length(text)).otherwise(1.0)


def content_class(text: Column, least: float = 0.95) -> Column:
    return F.when(printable_share(text) >= least, "text").otherwise("binary")


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


#: First bytes of media files in hexadecimal, with the offset of the bytes.
MAGIC = [
    ("png", 0, "89504E470D0A1A0A"), ("jpeg", 0, "FFD8FF"), ("gif", 0, "47494638"), ("bmp", 0, "424D"), ("tiff", 0, "49492A00"), ("tiff", 0, "4D4D002A"),
    ("webp", 8, "57454250"), ("wav", 8, "57415645"), ("avi", 8, "41564920"), ("mp4", 4, "66747970"), ("mkv", 0, "1A45DFA3"), ("mp3", 0, "494433"), ("mp3", 0, "FFFB"),
    ("flac", 0, "664C6143"), ("ogg", 0, "4F676753"), ("pdf", 0, "255044462D"), ("gzip", 0, "1F8B"), ("zip", 0, "504B0304"), ("zstd", 0, "28B52FFD"),
]


def media_type(content: Column) -> Column:
    """Kind of file by its first bytes, or 'unknown'; only 16 bytes are looked at."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.lit(None).cast("string")
    for name, at, magic in reversed(MAGIC):
        out = F.when(F.substring(head, 2 * at + 1, len(magic)) == magic, name).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


def prometheus_line(name: Column, labels: dict[str, Column], value: Column) -> Column:
    """One sample in the text exposition format; quotes, backslashes and line ends in label values are escaped."""
    escaped = {k: F.regexp_replace(F.regexp_replace(v.cast("string"), r'([\\"])', r"\\$1"), "\n", r"\\n") for k, v in labels.items()}
    inside = F.concat_ws(",", *[F.concat(F.lit(f'{k}="'), v, F.lit('"')) for k, v in escaped.items()])
    return F.concat(name, F.lit("{"), inside, F.lit("} "), value.cast("string"))


def envelope(kind: Column, payload: Column) -> Column:
    """A payload with its kind, length and digest."""
    raw = payload.cast("binary")
    return F.struct(kind.alias("kind"), F.octet_length(raw).cast("bigint").alias("length"), F.sha2(raw, 256).alias("sha256"), raw.alias("payload"))


def envelope_intact(e: Column) -> Column:
    return (F.octet_length(e["payload"]) == e["length"]) & (F.sha2(e["payload"], 256) == e["sha256"])
