"""Byte-level BPE by longest matches and backtracking.

Bytes are mapped to Latin-1 characters, so that a pyahocorasick automaton can hold the vocabulary. A piece of
text (one match of the pre-tokenising pattern) is encoded from left to right: the automaton gives the longest
token at the current place; it is taken if BPE would keep the border between it and the token before it, else
the next shorter prefix token is tried, else the last token is taken back. A place once found to lead nowhere is
never entered again, so the work is linear in the piece. Whether two adjacent tokens are compatible depends on
the two alone and is memoised. The result equals that of applying the merges in rank order.

Defined results: a null text is an empty text and has no ids; repeated rows each get their row.
"""

from __future__ import annotations

import base64
import re
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, table

#: Pieces no longer than this are remembered: the last so many new ones and those used since, at most twice as many.
CACHED_CHARS, CACHED_PIECES = 48, 250_000
ENCODED = "doc_id bigint, n_tokens bigint, ids binary"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class BytePairCoder:
    """Encodes and decodes with the merge ranks of a vocabulary that holds all single bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.find, self.find_fast, self.odd = ranks, regex.compile(pattern).findall, *fast_pattern(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.compatible: dict[int, bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self._learn(token, rank)
        self.shorter: dict[int, int] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, token: bytes, rank: int) -> None:
        """The two tokens whose merge makes this one: the only split that survives the merges below its rank."""
        self.parts[rank] = (rank, rank)
        if len(token) == 1:
            return
        ranks = self.ranks
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None and left < rank and right < rank and self._keeps(left, right):
                self.parts[rank] = (left, right)
                self.joined[left, right] = rank
                return

    def _keeps(self, left: int, right: int) -> bool:
        """Whether BPE over the bytes of both leaves the border between them where it is.

        Both tokens are taken apart in the reverse order of their merges. At each stage the pair of tokens that
        touch at the border must not have a merge that would have come before the merges already undone.
        """
        parts, joined = self.parts, self.joined
        limit = 1 << 62
        while True:
            if joined.get((left, right), limit) < limit:
                return False
            undo_left = left > right
            for _ in range(2):
                whole = left if undo_left else right
                inner = parts[whole][1] if undo_left else parts[whole][0]
                if inner != whole:
                    break
                undo_left = not undo_left
            else:
                return True
            # A merge over the border of the same rank as one to its right comes first, for it is further left.
            limit = whole if undo_left else whole + 1
            if undo_left:
                left = inner
            else:
                right = inner

    def _fits(self, left: int, right: int) -> bool:
        if len(self.compatible) > 300_000:
            self.compatible.clear()
        known = self.compatible[left << 32 | right] = self._keeps(left, right)
        return known

    def _next_shorter(self, rank: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        known = self.shorter.get(rank)
        if known is None:
            token = self.tokens[rank]
            known = next((r for n in range(len(token) - 1, 0, -1) if (r := self.ranks.get(token[:n])) is not None), -1)
            self.shorter[rank] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text, lengths, compatible, fits, shorter = piece.decode("latin-1"), self.lengths, self.compatible.get, self._fits, self.shorter.get
        longest, n = self.automaton.iter_long, len(piece)
        out: list[int] = []
        at, last, token = 0, -1, -1
        for end, token in longest(text):  # the longest tokens one after another, while they fit
            if last >= 0 and not (known := compatible(last << 32 | token)) and (known is not None or not fits(last, token)):
                break
            out.append(token)
            at, last = end + 1, token
        else:
            return out
        dead = bytearray(n + 1)
        while True:
            end = at + lengths[token]
            if not dead[end]:
                if last < 0 or (known := compatible(last << 32 | token)) or known is None and fits(last, token):
                    out.append(token)
                    if end == n:
                        return out
                    at, last, token = end, token, next(longest(text, end))[1]
                    continue
            if (less := shorter(token)) is None:
                less = self._next_shorter(token)
            while less < 0:
                dead[at] = 1
                out.pop()
                at -= lengths[last]
                less = self._next_shorter(last)
                last = out[-1] if out else -1
            token = less

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        found = (self.find_fast if self.find_fast and not self.odd(text) else self.find)(text)
        get, out = self.pieces.get, []
        for piece in found:
            out.append(get(piece) or self._new(piece))
        return b"".join(out)

    def _new(self, piece: str) -> bytes:
        ids = self.pieces.get(piece) or self.older.get(piece)
        if ids is None:
            ids = packed(self.encode_piece(piece.encode("utf-8", "surrogatepass")))
        if len(piece) <= CACHED_CHARS:
            if len(self.pieces) >= CACHED_PIECES:
                self.older, self.pieces = self.pieces, {}
            self.pieces[piece] = ids
        return ids

    def decode(self, ids: bytes | None) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[x] for x in unpacked(ids or b"")])


def packed(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes() if len(ids) > 64 else struct.pack(f"<{len(ids)}I", *ids)


def unpacked(ids: bytes) -> list[int]:
    return np.frombuffer(ids, dtype="<u4").tolist()


def fast_pattern(pattern: str):
    """The pattern for the standard library's faster engine, and a search for characters that it classes otherwise.

    Both are None if the pattern uses more than letters, numbers and white space. The characters are found by
    asking both engines about every code point up to U+FFFF, and all above count, so texts without them split alike.
    """
    same = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
    if "\\p" in same or "\\w" in pattern:
        return None, None
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    odd: set[str] = set()
    for theirs, ours in ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s")):
        odd |= set(regex.findall(theirs, every)) ^ set(re.findall(ours, every))
    codes = sorted(map(ord, odd)) + [0x10000]
    ranges, first = [], codes[0]
    for a, b in zip(codes, codes[1:], strict=False):
        if b != a + 1:
            ranges.append(f"\\u{first:04x}-\\u{a:04x}")
            first = b
    return re.compile(same).findall, re.compile(f"[{''.join(ranges)}\\U00010000-\\U0010ffff]").search


_CODERS: dict[tuple[str, str], BytePairCoder] = {}


def coder(path: str, pattern: str) -> BytePairCoder:
    """One coder for each vocabulary and process; the vocabulary file is installed on every machine."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = BytePairCoder(load_ranks(path), pattern)
    return _CODERS[path, pattern]


def _encode_step(path: str, pattern: str):
    encode = coder(path, pattern).encode

    def step(batch: pa.RecordBatch) -> dict:
        ids = [encode(x) for x in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "n_tokens": [len(x) // 4 for x in ids], "ids": ids}

    return step


def _decode_step(path: str, pattern: str):
    decode = coder(path, pattern).decode

    def step(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "n_tokens": batch.column(1), "ids": batch.column(2), "decoded": [decode(x) for x in batch.column(2).to_pylist()]}

    return step


def both_ways(path: str, pattern: str):
    """Step for whole rows with a text: all columns, n_tokens, __ids and __decoded."""
    both = coder(path, pattern)

    def step(batch: pa.RecordBatch) -> dict:
        ids = [both.encode(x) for x in batch.column("text").to_pylist()]
        own = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        return own | {"n_tokens": [len(x) // 4 for x in ids], "__ids": ids, "__decoded": [both.decode(x) for x in ids]}

    return step


def encode(docs: DataFrame, path: str, pattern: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers, as token shards hold them)."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_rows(docs, ["doc_id", "text"], _encode_step, ENCODED, path, pattern)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """What :func:`encode` returned, with ``decoded``: the bytes that the ids stand for."""
    return map_rows(encoded, ["doc_id", "n_tokens", "ids"], _decode_step, f"{ENCODED}, decoded binary", path, pattern)


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op2(spark, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary()
    coded = decode(encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
