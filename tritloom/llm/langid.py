"""Language identification: averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

A text is lower-cased; its features are, for every word (run of letters) between ``<`` and ``>``, the byte n-grams of
2 to 4 bytes and the word itself, hashed (rolling and multiplicative, and CRC-32) into ``BUCKETS`` rows of an embedding
matrix. The mean of a text's
feature rows goes through a linear layer and a softmax. Both matrices are trained by stochastic gradient descent in
numpy on a bounded sample: at most ``PER_LANGUAGE`` labelled texts of each language, picked by a hash of id and text; what
comes to the driver for each is its bucket counts, of at most ``BUCKETS`` entries. A fifth of the sample is kept out of
training to fit a temperature for the scores and the rejection bound: the score that all but ``REJECTED`` of its
rightly classified texts reach, at most ``MOST_BOUND``.

Scoring is linear, so a word's features are summed once into its logits and kept in a bounded cache; every text is
scored whole.

Defined results: a text that is null or has no letter is ``und`` with score 0 and rejected; labels that are null or
texts without letters teach nothing; with no label at all, every text is ``und``. Ties go to the first label in order.
Rows with equal or null ids are drawn by their texts, and copies of one row count once. An empty table gives an empty
result; columns of the input that are not named are not looked at.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, pieces, ship, table

BITS, WIDTH, EPOCHS, RATE = 15, 16, 6, 0.5
BUCKETS = 1 << BITS
PER_LANGUAGE = 400
REJECTED, MOST_BOUND = 0.001, 0.5
CACHED = 150_000
SCHEMA = "doc_id bigint, lang_pred string, score double, rejected boolean"

find_words = re.compile(r"[^\W\d_]+").findall


def has_letter(found: list[str]) -> bool:
    """Runs may consist of letter-like numbers alone."""
    return bool(found) and (found[0].isalpha() or any(c.isalpha() for w in found for c in w))


def buckets_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all features of some words, and the index of the word that each is of."""
    raw = [b"<" + w.encode("utf-8", "surrogatepass") + b">" for w in words]
    sizes = np.array([len(x) for x in raw])
    total, every = int(sizes.sum()), np.arange(len(raw))
    owner = np.repeat(every, sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(total)  # bytes to the end of the word
    code = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    found, of, rolled = [], [], code
    for n in (2, 3, 4):
        rolled = rolled[:-1] * np.uint64(257) + code[n - 1 :]
        inside = left[: total - n + 1] >= n
        mixed = (rolled[inside] * np.uint64(8) + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        found.append((mixed >> np.uint64(64 - BITS)).astype(np.int64))
        of.append(owner[: total - n + 1][inside])
    found.append(np.array([zlib.crc32(x) & BUCKETS - 1 for x in raw], dtype=np.int64))
    return np.concatenate(found), np.concatenate([*of, every])


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that a text fills, and how often."""
    found = find_words(text.lower()) if text else []
    if not has_letter(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words: dict[str, int] = {}
    for w in found:
        words[w] = words.get(w, 0) + 1
    total = np.zeros(BUCKETS, np.int64)
    every = list(words.items())
    for k in range(0, len(every), 20_000):
        part = every[k : k + 20_000]
        at, owner = buckets_of([w for w, _ in part])
        total += np.bincount(at, np.array([n for _, n in part])[owner], BUCKETS).astype(np.int64)
    at = np.flatnonzero(total)
    return at, total[at]


class Model:
    def __init__(self, labels: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, bound: float) -> None:
        self.labels, self.table, self.bias, self.temperature, self.bound = labels, table, bias, temperature, bound


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(sample: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """sample: (label, buckets, counts); its order does not matter to who trains and who calibrates."""
    labels = sorted({x[0] for x in sample})
    k = len(labels)
    if not k:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    out, bias = rng.normal(0, 0.1, (WIDTH, k)), np.zeros(k)
    of = {x: i for i, x in enumerate(labels)}
    fit = [x for i, x in enumerate(sample) if i % 5] or sample
    kept = [x for i, x in enumerate(sample) if not i % 5]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(fit)):
            label, at, n = fit[i]
            share = n / n.sum()
            rows = emb[at]
            mean = share @ rows
            wrong = softmax(mean @ out + bias)
            wrong[of[label]] -= 1
            emb[at] = rows - rate * 20 * np.outer(share, out @ wrong)
            out -= rate * np.outer(mean, wrong)
            bias -= rate * 0.1 * wrong
    logits_of = emb @ out
    logits = np.array([(n / n.sum()) @ logits_of[at] + bias for _, at, n in kept] or np.zeros((0, k)))
    right = np.array([of[x[0]] for x in kept], dtype=int)
    temperature = 1.0
    if len(kept) > 20:
        grid = np.geomspace(0.05, 20, 60)
        rows = np.arange(len(right))
        temperature = float(min(grid, key=lambda t: -np.log(softmax(logits / t)[rows, right] + 1e-12).mean()))
    bound = 0.0
    if len(kept):
        scores = softmax(logits / temperature)
        good = scores.max(axis=1)[scores.argmax(axis=1) == right]
        bound = float(min(MOST_BOUND, np.quantile(good, REJECTED))) if len(good) else 0.0
    return Model(labels, logits_of.astype(np.float32), bias, temperature, bound)


class Scorer:
    """Scores texts with the logits of words in a bounded cache."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.known: dict[str, int] = {}
        self.sums = np.zeros((CACHED, len(model.bias) + 1))

    def _learn(self, words: list[str]) -> None:
        at, owner = buckets_of(words)
        first, n = len(self.known), len(words)
        for k in range(len(self.model.bias)):
            self.sums[first : first + n, k] = np.bincount(owner, self.model.table[at, k], n)
        self.sums[first : first + n, -1] = np.bincount(owner, minlength=n)
        self.known.update(zip(words, range(first, first + n), strict=True))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        model, found = self.model, find_words(text.lower()) if text else []
        if not model.labels or not has_letter(found):
            return "und", 0.0, True
        total = np.zeros(len(model.bias) + 1)
        for k in range(0, len(found), 50_000):
            part = found[k : k + 50_000]
            if len(self.known) + len(part) > CACHED:
                self.known.clear()
            known = self.known
            if new := set(part).difference(known):
                self._learn(sorted(new))
            rows = [known[w] for w in part]
            total += self.sums[rows].sum(axis=0)
        scores = softmax((total[:-1] / total[-1] + model.bias) / model.temperature)
        best = int(scores.argmax())
        return model.labels[best], float(scores[best]), bool(scores[best] < model.bound)


def _counts_step():
    def step(batch: pa.RecordBatch) -> dict:
        found = [counted(x) for x in batch.column(1).to_pylist()]
        return {"id": batch.column(2), "label": batch.column(0), "at": [a.astype("<i4").tobytes() for a, _ in found], "n": [n.astype("<i4").tobytes() for _, n in found]}

    return step


def sample_of(docs: DataFrame, *, text: str = "text", label: str = "lang", doc_id: str = "doc_id", where=None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """At most ``per_language`` rows (label, text, id) of each label: those of the smallest hashes of id and text."""
    rows = docs.select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"), F.col(doc_id).cast("string").alias("id"), (F.lit(True) if where is None else where).alias("ok"))
    mark = F.xxhash64(F.lit("sample"), "id", "text")
    rows = rows.where("ok and label is not null").select("label", "text", "id", mark.alias("mark"), F.pmod(mark, F.lit(1_000_000)).alias("draw"))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # languages, not rows
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(1_000_000 * min(1.0, 1.5 * per_language / n)))]) if sizes else F.create_map(F.lit(""), F.lit(0))
    # About half as many again are drawn and the first of them stay; the window's limit works before its shuffle too.
    near = rows.where(F.col("draw") < share[F.col("label")]).dropDuplicates(["label", "id", "mark"])
    nth = F.row_number().over(Window.partitionBy("label").orderBy("mark", "id"))
    return near.withColumn("nth", nth).where(F.col("nth") <= per_language).select("label", "text", "id")


def fit(docs: DataFrame, **options) -> Model:
    """Trains on :func:`sample_of` the rows of ``docs`` that ``where`` admits and whose label is not null."""
    found = map_rows(sample_of(docs, **options), ["label", "text", "id"], _counts_step, "id string, label string, at binary, n binary").collect()
    sample = sorted((r["id"] or "", r["label"], bytes(r["at"]), bytes(r["n"])) for r in found if r["at"])
    return train([(lab, np.frombuffer(at, "<i4"), np.frombuffer(n, "<i4")) for _, lab, at, n in sample])


def _score_step(shared):
    scorer = Scorer(shared.value)

    def step(batch: pa.RecordBatch) -> dict:
        found = [scorer(x) for x in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "rejected": [x[2] for x in found]}

    return step


def predict(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, lang_pred, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_rows(docs, ["doc_id", "text"], _score_step, SCHEMA, shared)


def accepted(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, whose language is not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    ship(docs.sparkSession)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for piece in pieces(batch):
                yield piece.filter(pa.array([not scorer(x)[2] for x in piece.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, where=~held_out())
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
