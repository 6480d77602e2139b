"""Chat formatting into budgeted windows.

A conversation's turns are rendered one after another as ``### role: text </turn>`` and a line end. Inside texts a
backslash is doubled and the control strings ``###`` and ``</turn>`` get one before them; inside roles colons are
escaped too. Both are undone exactly on reading, so no text can end a turn.

Windows are spans of whole turns. Tokens are those of the byte-level BPE vocabulary, counted for each rendered turn. They are summed from the start of the buffered turns; a bisection in these
prefix sums gives the longest span that fits the budget beside the system turn, which every window repeats, and up to
``history`` turns before the span, which later windows repeat as far as a quarter of the budget allows. Each turn is new
in exactly one window. The loss mask covers the texts of assistant turns where they are new; repeated targets are
masked out. A turn longer than the budget has a window of its own and stays whole.

A conversation is read in order from a sorted partition and held only as far as a few budgets of turns; long
conversations never come together in memory. A conversation's windows are one task's stream, since each span begins where
the one before it ended (and the digests of :func:`read_back` are sequential as well).

Defined results: a system turn of the budget or more is repeated all the same, so its windows exceed the budget and hold
one new turn each; an empty table gives an empty result; other columns are not looked at; a null text or role is empty; turns are ordered by turn, then role, then text, nulls first, so ties
and repeated rows stay in a fixed order; rows with a null conv_id form one conversation of their own.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import coder, vocabulary
from .common import ship, table

BUDGET, HISTORY = 1024, 2
TURN, COLON, END = "### ", ": ", " </turn>\n"
WINDOWS = "conv_id bigint, window_no int, n_repeated int, n_new int, n_tokens bigint, text string, loss array<struct<start:int,end:int>>"

_escaped = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text) if "\\" in text else text


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace(":", "\\c").replace("</turn>", "\\</turn>")


def unescape_role(role: str) -> str:
    return _escaped.sub(lambda m: ":" if m[1] == "c" else m[1], role) if "\\" in role else role


def parse(window: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end of the escaped text in code points."""
    out, at = [], 0
    while at < len(window):
        colon = window.index(COLON, at + len(TURN))
        end = window.index(END, colon + len(COLON) - 1)
        start = colon + len(COLON)
        out.append((unescape_role(window[at + len(TURN) : colon]), unescape(window[start:end]), start, max(start, end)))
        at = end + len(END)
    return out


class _Conversation:
    """Turns come in; windows go out."""

    def __init__(self, budget: int, history: int, encode) -> None:
        """``encode`` gives four bytes for each token of a text."""
        self.budget, self.history, self.encode = budget, history, encode
        self.system: tuple | None = None
        self.before: list[tuple] = []
        self.turns: list[tuple] = []
        self.held = 0
        self.number = self.seen = 0

    def add(self, role: str, text: str):
        head = TURN + escape_role(role) + COLON
        body = escape(text)
        tokens = len(self.encode(head + body + END)) // 4
        turn = (head, body, tokens, role == "assistant", self.seen == 0 and role == "system")
        self.seen += 1
        self.turns.append(turn)
        self.held += tokens
        if self.held > 4 * self.budget:
            yield from self.windows(False)

    def windows(self, ended: bool):
        while self.turns and (ended or self.held > self.budget):
            sums = [0]
            for turn in self.turns:
                sums.append(sums[-1] + turn[2])
            fixed = self.system[2] if self.system else 0
            repeated: list[tuple] = []
            for turn in reversed(self.before[-self.history :] if self.history else []):
                if turn[2] > self.budget // 4 - sum(x[2] for x in repeated):
                    break
                repeated.insert(0, turn)
            room = self.budget - fixed - sum(x[2] for x in repeated)
            n = bisect_right(sums, room) - 1
            if not n and repeated:  # the next turn matters more than history
                repeated = []
                n = bisect_right(sums, self.budget - fixed) - 1
            n = max(1, n)
            new, self.turns = self.turns[:n], self.turns[n:]
            self.held -= sums[n]
            again = ([self.system] if self.system else []) + repeated
            parts, loss, at = [], [], 0
            for k, (head, body, _, target, _) in enumerate(again + new):
                if target and k >= len(again):
                    loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
                parts.append(head + body + END)
                at += len(parts[-1])
            yield (self.number, len(again), len(new), sum(x[2] for x in again + new), "".join(parts), loss)
            self.number += 1
            if new[0][4]:
                self.system = new[0]
            self.before = [x for x in self.before + new if not x[4]][-self.history :] if self.history else []


def _format(budget: int, history: int, path: str, pattern: str):
    schema = pa.schema([("conv_id", pa.int64()), ("window_no", pa.int32()), ("n_repeated", pa.int32()), ("n_new", pa.int32()), ("n_tokens", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def run(batches):
        key, conv, rows, size = None, None, [], 0
        encode = coder(path, pattern).encode

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                out = []
                if conv is None or conv_id != key:
                    if conv is not None:
                        out += [(key, *x) for x in conv.windows(True)]
                    key, conv = conv_id, _Conversation(budget, history, encode)
                out += [(key, *x) for x in conv.add(role or "", text or "")]
                rows += out
                size += sum(len(x[5]) for x in out)
                if size > 1 << 20:
                    yield batch_of(rows)
                    rows, size = [], 0
        if conv is not None:
            rows += [(key, *x) for x in conv.windows(True)]
        if rows:
            yield batch_of(rows)

    return run


def windows(conversations: DataFrame, *, budget: int = BUDGET, history: int = HISTORY, tokens: tuple[str, str] | None = None) -> DataFrame:
    """conversations: conv_id, turn, role, text. Windows of a conversation follow one another in one partition.

    ``tokens`` are path and pattern of a vocabulary. A row is a window: its text, how many turns it repeats and how many are new, and the spans of the loss mask.
    """
    ship(conversations.sparkSession)
    turns = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return turns.select("conv_id", "role", "text").mapInArrow(_format(budget, history, *(tokens or vocabulary())), WINDOWS)


REPORT = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint"


def _read_back():
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])

    def run(batches):
        key, state, rows = None, None, []

        def done():
            n, turns, loss_n, loss, chars, n_windows = state
            return {"conv_id": key, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": loss_n, "loss_sha256": loss.hexdigest(), "formatted_chars": chars, "n_windows": n_windows}

        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != key:
                    if state is not None:
                        rows.append(done())
                    key, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                text = row["text"]
                for role, said, _, _ in parse(text)[row["n_repeated"] :]:
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in row["loss"]:
                    target = unescape(text[span["start"] : span["end"]])
                    state[2] += len(target)
                    state[3].update(target.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
                state[5] += 1
            if len(rows) >= 5000:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if state is not None:
            rows.append(done())
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, read from its windows in order; see :func:`windows`."""
    ship(formatted.sparkSession)
    return formatted.mapInArrow(_read_back(), REPORT)


def op8(spark, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(windows(conversations.unionByName(extra)))
