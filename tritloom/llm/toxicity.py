"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes, distance-weighted votes.

Fitting. At most about ``EXAMPLES`` labelled texts, drawn by hashes of the id and then of id and text, are the examples;
that bound is on examples alone. Every term of an example is in the vocabulary, and the document frequencies of all of
them are counted over all documents in one pass. An example is its vector of (1 + ln tf) * idf * relevance at length one.
``relevance`` is 1 for most terms; for a term whose shares in the two labels differ by a z-score over ``Z`` it is
``(|z| / Z) ** POWER``. Without it a text's many rare words drown the few that matter (see the README for figures). Shares
are counted over groups of examples with the same smallest term hash, so copies aren't many witnesses. Terms that no
example holds can't add to a cosine's dot product and have no weight.

Search. Examples are numbered in the order of their weightiest terms, so that alike ones share blocks of ``BLOCK``. The
index holds for each term its postings, and for each block of them the largest weight. For a text, the sums of query
weight times block maximum bound every block's scores; the ``FIRST`` blocks of the best bounds are worked out exactly, then,
in one pass, all others whose bound is not below the k-th score. The ``K`` nearest are thus exact; ties go to the smaller
document id.

Score. The votes of the neighbours, weighted by cosine, are calibrated by a monotone fit to the examples' own votes, each
worked out without the example itself and its near copies (cosines of ``COPY`` or more). Evidence is the neighbours'
ids and cosines.

Defined results: null and empty texts, and texts that share no term with an example, have no neighbour and get the share
of label 1 among the examples; rows with equal ids each get their row; repeated rows of ``labels`` count once, with the
larger label; identical examples count once; equal cosines go to the smaller id; without examples of both labels every
score is the share of label 1, or 0. An empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, pieces, ship, spread, table, written
from .langid import held_out

EXAMPLES, Z, POWER, K, BLOCK, FIRST, COPY = 3000, 3.0, 3, 15, 64, 16, 0.95
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def term_counts(text: str | None) -> dict[bytes, int]:
    found: dict[bytes, int] = {}
    for t in terms(text):
        found[t] = found.get(t, 0) + 1
    return found


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], ..., first[0] + size[0] - 1, first[1], ... in one array."""
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class BlockMaxIndex:
    """Postings of unit vectors by term, with block maxima.

    ``vectors`` are (terms, weights) with terms as numbers below ``n_terms``, in ascending order.
    """

    def __init__(self, vectors: list[tuple], ids: list[int], labels: list[int], n_terms: int) -> None:
        heavy = [tuple(t[np.lexsort((t, -w))[:8]].tolist()) for t, w in vectors]
        order = sorted(range(len(vectors)), key=lambda i: (heavy[i], ids[i]))
        self.ids = np.array([ids[i] for i in order], dtype=np.int64)
        self.labels = np.array([labels[i] for i in order], dtype=np.float64)
        self.place = np.empty(len(order), dtype=np.int64)
        self.place[order] = np.arange(len(order))
        self.blocks = -(-len(order) // BLOCK)
        sizes = [len(vectors[i][0]) for i in order]
        term = np.concatenate([vectors[i][0] for i in order] or [np.zeros(0, np.int64)]).astype(np.int64)
        weight = np.concatenate([vectors[i][1] for i in order] or [np.zeros(0)])
        at = np.repeat(np.arange(len(order)), sizes)
        by_term = np.argsort(term, kind="stable")  # places stay in order within a term
        term, self.at, self.weight = term[by_term], at[by_term], weight[by_term]
        block = self.at // BLOCK
        new = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else np.zeros(0, np.int64)
        self.first = np.r_[new, len(term)]  # of each (term, block): its first posting
        self.block = block[new]
        self.most = np.maximum.reduceat(self.weight, new) if len(new) else np.zeros(0)
        self.of_term = np.searchsorted(term[new], np.arange(n_terms + 1))  # of each term: its first (term, block)

    def nearest(self, at_terms: np.ndarray, weights: np.ndarray, k: int = K, without: int = -1, below: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
        """Places of the k nearest with positive cosine, and the cosines.

        ``without`` is a place to leave out; so are cosines of ``below`` or more.
        """
        first = self.of_term[at_terms]
        size = self.of_term[at_terms + 1] - first
        entry, weight = _ranges(first, size), np.repeat(weights, size)
        block = self.block.take(entry)
        bound = np.bincount(block, weight * self.most.take(entry), self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        start, count = self.first.take(entry), self.first.take(entry + 1)
        count -= start
        cosines, places, least = np.zeros(0), np.zeros(0, np.int64), 0.0
        for chosen in (order[:FIRST], order[FIRST:]):
            chosen = chosen[bound[chosen] >= least - 1e-9]
            if not len(chosen):
                break
            marked = np.zeros(self.blocks, bool)
            marked[chosen] = True
            mine = np.flatnonzero(marked.take(block))
            n = count.take(mine)
            posting = _ranges(start.take(mine), n)
            value = np.repeat(weight.take(mine), n)
            value *= self.weight.take(posting)
            scores = np.bincount(self.at.take(posting), value, len(self.ids))
            new = np.flatnonzero(scores > least - 1e-9) if least else np.flatnonzero(scores)
            found = np.round(scores[new], 12)
            fine = (found > 0) & (found < below) & (new != without)
            cosines, places = np.concatenate((cosines, found[fine])), np.concatenate((places, new[fine]))
            if len(places) > k:
                best = np.flatnonzero(cosines >= np.partition(cosines, -k)[-k])
                cosines, places = cosines[best], places[best]
            top = np.lexsort((self.ids[places], -cosines))[:k]
            cosines, places = cosines[top], places[top]
            least = cosines[-1] if len(places) == k else 0.0
        return places, cosines


class Model:
    def __init__(self, of: dict[bytes, int], weight: np.ndarray, index: BlockMaxIndex | None, base: float, knots: tuple[list, list]) -> None:
        self.of, self.weight, self.index, self.base, self.knots = of, weight, index, base, knots

    def vector(self, counts: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        at = np.array([self.of.get(t, -1) for t in counts], dtype=np.int64)
        often = np.array(list(counts.values()), dtype=np.float64)
        order = np.argsort(at)[np.count_nonzero(at < 0) :]
        at = at[order]
        weights = (1 + np.log(often[order])) * self.weight[at]
        return at, weights / (math.sqrt(float(weights @ weights)) or 1.0)

    def vote(self, counts: dict[bytes, int], without: int = -1, below: float = math.inf) -> tuple[float | None, np.ndarray, np.ndarray]:
        """Share of label 1 among the neighbours by cosine (none: None), their places and cosines."""
        places, cosines = self.index.nearest(*self.vector(counts), without=without, below=below) if self.index and counts else (np.zeros(0, int),) * 2
        return (float(cosines @ self.index.labels[places] / cosines.sum()) if len(places) else None), places, cosines

    def __call__(self, text: str | None) -> tuple[float, list, list]:
        vote, places, cosines = self.vote(term_counts(text))
        if vote is None:
            return self.base, [], []
        return min(1.0, max(0.0, float(np.interp(vote, *self.knots)))), self.index.ids[places].tolist(), cosines.tolist()


def monotone(x: np.ndarray, y: np.ndarray) -> tuple[list, list]:
    """Isotonic fit by pooling adjacent violators; each pool is drawn to one half by one case of either label."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        if pools and pools[-1][0] / pools[-1][2] == a:
            pools[-1] = [pools[-1][0] + a, pools[-1][1] + b, pools[-1][2] + 1]
        else:
            pools.append([a, b, 1.0])
        while len(pools) > 1 and (pools[-2][1] / pools[-2][2] > pools[-1][1] / pools[-1][2] or pools[-1][2] < 20 and len(pools) > 1 and pools[-2][2] < 20):
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last, strict=True)]
    return [p[0] / p[2] for p in pools], [(p[1] + 1) / (p[2] + 2) for p in pools]


def relevance(examples: list[dict[bytes, int]], labels: list[int], of: dict[bytes, int]) -> np.ndarray:
    """Of each term: (|z| / Z) ** POWER, 1 at least, from its shares in groups of either label."""
    groups = {(min(map(zlib.crc32, x)), label): x for x, label in zip(examples, labels, strict=True) if x}
    size = [max(1, sum(label == k for _, label in groups)) for k in (0, 1)]
    found = np.zeros((2, len(of)))
    for (_, label), x in groups.items():
        found[label, [of[t] for t in x]] += 1
    p = np.minimum(found.sum(axis=0) / sum(size), 1.0)
    z = (found[1] / size[1] - found[0] / size[0]) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / size[0] + 1 / size[1]))
    return np.maximum(1.0, np.abs(z) / Z) ** POWER


def _example_step():
    def step(batch: pa.RecordBatch) -> dict:
        found = [term_counts(x) for x in batch.column(2).to_pylist()]
        return {"doc_id": batch.column(0), "label": batch.column(1), "terms": [b" ".join(x) for x in found], "n": [np.array(list(x.values()), "<i4").tobytes() for x in found]}

    return step


def _frequencies(shared):
    """One task's document frequencies by number of the term, and its rows under -1."""
    schema = pa.schema([("t", pa.int32()), ("n", pa.int64())])

    def run(batches):
        of, rows = shared.value, 0
        found = np.zeros(len(of), dtype=np.int64)
        for batch in batches:
            for piece in pieces(batch):
                rows += piece.num_rows
                for text in piece.column(0).to_pylist():
                    found[[of[t] for t in set(terms(text)) if t in of]] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[rows, found[at]])], schema=schema)

    return run


def examples_of(docs: DataFrame, labels: DataFrame, *, where=None, examples: int = EXAMPLES) -> DataFrame:
    """About ``examples`` rows (doc_id, label, text) at most, as a table in the shared folder."""
    fine = "doc_id is not null and toxic is not null"
    labels = labels.where(fine) if where is None else labels.where(where).where(fine)
    labels = labels.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("label"))
    draw = lambda n, *by: F.pmod(F.xxhash64(F.lit("example"), *by), F.lit(1_000_000)) < int(1_000_000 * examples / n)
    n = labels.count()
    if n > examples:
        labels = labels.where(draw(n, "doc_id"))
    picked = F.broadcast(labels.withColumnRenamed("doc_id", "__id"))  # about ``examples`` rows of two numbers
    found = docs.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("__id"))
    found = found.groupBy("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("m")).agg(F.max("label").alias("label"), F.first("text").alias("text"))
    sample = spread(written(found, "examples")[0])
    n = sample.count()
    return (sample.where(draw(n, "doc_id", "m")) if n > 2 * examples else sample).select("doc_id", "label", "text")


def fit(docs: DataFrame, labels: DataFrame, *, where=None, examples: int = EXAMPLES) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. ``where`` admits rows of labels to learn from."""
    sample = examples_of(docs, labels, where=where, examples=examples).select(F.col("doc_id").cast("bigint").alias("doc_id"), "label", "text")
    rows = map_rows(sample, ["doc_id", "label", "text"], _example_step, "doc_id bigint, label int, terms binary, n binary").collect()
    rows = sorted(((r["doc_id"], r["label"], dict(zip(bytes(r["terms"]).split(), np.frombuffer(r["n"], "<i4").tolist(), strict=True))) for r in rows), key=lambda r: (r[0], r[1], sorted(r[2].items())))
    ids, marks, counts = ([r[k] for r in rows] for k in range(3))
    base = sum(marks) / len(marks) if marks else 0.0
    of = {t: k for k, t in enumerate(sorted(set().union(*counts)))}
    if not of or not 0 < base < 1:
        return Model({}, np.zeros(0), None, base, ([0.0, 1.0], [0.0, 1.0]))
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(of)  # the terms of the examples
    found = docs.select("text").mapInArrow(_frequencies(shared), "t int, n bigint").groupBy("t").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(len(of) + 1)
    df[[r["t"] for r in found]] = [r["n"] for r in found]  # the rows come last, under -1
    idf = np.log((1 + df[-1]) / (1 + df[:-1]))
    model = Model(of, idf * relevance(counts, marks, of), None, base, ([0.0, 1.0], [0.0, 1.0]))
    model.index = BlockMaxIndex([model.vector(x) for x in counts], ids, marks, len(of))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    votes = map_rows(sample.select("label", "text"), ["label", "text"], _vote_step, "label int, vote double", shared).where("vote is not null").collect()
    if votes:
        votes = sorted((r["vote"], r["label"]) for r in votes)
        model.knots = monotone(np.array([v for v, _ in votes]), np.array([y for _, y in votes]))
    return model


def _vote_step(shared):
    model = shared.value

    def step(batch: pa.RecordBatch) -> dict:
        return {"label": batch.column(0), "vote": [model.vote(term_counts(x), below=COPY)[0] for x in batch.column(1).to_pylist()]}

    return step


def _score_step(shared):
    model = shared.value

    def step(batch: pa.RecordBatch) -> dict:
        found = [model(x) for x in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "score": [x[0] for x in found], "neighbours": [x[1] for x in found], "cosines": [x[2] for x in found]}

    return step


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, score, neighbours (ids of the nearest examples), cosines."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the vectors of at most about ``EXAMPLES`` texts
    return map_rows(docs.select("doc_id", "text"), ["doc_id", "text"], _score_step, "doc_id bigint, score double, neighbours array<bigint>, cosines array<double>", shared)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), where=~held_out())
    found = score(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours")
