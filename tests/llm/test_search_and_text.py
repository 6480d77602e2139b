"""Top-k search, byte-level BPE, license scans and decontamination: against brute force, edge cases included."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tritloom.llm import bpe, decontam, licenses, queries, topk

from ..oracle import SF, same, tables


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    same(spark, tables(), queries.QUERIES[name], queries.ORACLE_SQL[name])


# ---- top-k


def brute_topk(rows, k=20):
    out = []
    for q, v in rows:
        if q is None or q % 20 or v is None:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i is not None and w is not None and i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_topk_with_ties_copies_nulls_and_lengths(spark):
    R = random.Random(4)
    rows = [(i, [R.randint(-3, 3) for _ in range(6)]) for i in range(90)]
    rows += [(100 + i, [1, 1, 1, 1, 1, 1]) for i in range(50)] + [(200, [0] * 6), (220, [5]), (221, [2]), (240, []), (241, []), (None, [1] * 6), (260, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<bigint>")
    for block in (7, 16384):
        got = topk.top_k(df, df.where("vec_id % 20 = 0"), block=block, per_pass=3)
        assert sorted(map(tuple, got.collect())) == brute_topk(rows)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_topk_quantises_and_drops_broken_vectors(spark):
    rows = [(0, [0.5, -0.01]), (1, [float("nan"), 1.0]), (2, None), (3, [None, 1.0]), (4, [float("inf"), 0.0]), (20, [1.0, 1.0])]
    q = topk.quantised(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("v", F.lit(1)))
    assert sorted((r.vec_id, list(r.v)) for r in q.collect()) == [(0, [32, -1]), (20, [64, 64])]


def test_threshold_search_stops_early():
    R = np.random.default_rng(0)
    rows = np.zeros((4000, 4))
    rows[:, 0] = R.integers(0, 1000, 4000)
    rows[:, 1:] = R.integers(0, 3, (4000, 3))
    block = topk.SortedBlock(np.arange(4000), rows)
    score, ids = block.search(np.array([9.0, 1.0, 0.0, 0.0]), -1, np.zeros(0), np.zeros(0, np.int64), 5)
    full = rows @ np.array([9.0, 1.0, 0.0, 0.0])
    want = np.lexsort((np.arange(4000), -full))[:5]
    assert ids.tolist() == want.tolist() and score.tolist() == full[want].tolist()


# ---- BPE


@pytest.fixture(scope="module")
def coder():
    return bpe.coder(*bpe.vocabulary())


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abcdeinrst ABC'’.,\n\t09²Ⅷ_é漢\x1c\u0085", max_size=80)))
def test_bpe_equals_library_and_round_trips(coder, library, text):
    ids = coder.encode(text)
    assert bpe.unpacked(ids) == library.encode_ordinary(text)
    assert coder.decode(ids) == text.encode("utf-8", "surrogatepass")


def test_bpe_every_token_and_long_runs(coder, library):
    for rank in range(0, 50256, 7):
        text = coder.tokens[rank].decode("utf-8", "ignore")
        assert bpe.unpacked(coder.encode(text)) == library.encode_ordinary(text)
    for text in ("a" * 5000, "ab" * 3000, " " * 4000, "é" * 2000, "<|endoftext|>"):
        assert bpe.unpacked(coder.encode(text)) == library.encode_ordinary(text)


def test_bpe_other_vocabulary(library):
    path, pattern = bpe.vocabulary("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    mine = bpe.BytePairCoder(ranks, pattern)
    for text in ("Été à la plage, ørsted naïve 中文字符 Привет", "the quick brown fox", "\n\n  x"):
        assert bpe.unpacked(mine.encode(text)) == other.encode_ordinary(text)


def test_bpe_query_edge_rows(spark, library):
    texts = [None, "", "hello  world\n", "hello  world\n", "x" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "a")], "doc_id bigint, text string").withColumn("n_tokens", F.lit("clash"))
    coded = bpe.decode(bpe.encode(docs, *bpe.vocabulary()), *bpe.vocabulary()).collect()
    for r in coded:
        text = ("a" if r.doc_id is None else texts[r.doc_id]) or ""
        assert bpe.unpacked(bytes(r.ids)) == library.encode_ordinary(text) and bytes(r.decoded).decode() == text and r.n_tokens == len(r.ids) // 4
    assert bpe.encode(docs.limit(0), *bpe.vocabulary()).count() == 0


def test_bpe_query_against_library(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in bpe.op2(spark, SF).collect():
        ids = np.array(library.encode_ordinary(texts[r.doc_id]), dtype="<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


# ---- licenses


def test_license_scan_edges(spark):
    mit = dict(licenses.TEMPLATES)["mit"]
    words = mit.split()
    texts = ["", None, "no license here", "x Released under the MIT License.", mit, "ünder " * 3000 + mit.upper() + " tail" * 3000, " ".join(words[: len(words) // 2]), " ".join(words[3:]), "Licensed under the Apache License Version 2.0!"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3])], "doc_id bigint, text string").withColumn("license_id", F.lit(1))
    got = {(r.doc_id, r.license_id): r for r in licenses.scan(docs, licenses.templates(spark), licenses.cover_words([t for _, t in licenses.TEMPLATES])).collect()}
    assert set(got) == {(3, "mit-line"), (4, "mit"), (5, "mit"), (7, "mit"), (8, "apache-2.0-line")}
    assert got[4, "mit"].containment == 1 and got[5, "mit"].containment == 1 and got[7, "mit"].containment < 1
    assert licenses.scan(docs.limit(0), licenses.templates(spark), ["license"]).count() == 0



def test_license_scan_with_a_folder_of_whole_texts(spark, tmp_path):
    import random

    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("ter", "war", "lib", "grant", "copy") for b in ("ms", "ranty", "erty", "or", "ing", "able", "ed")]
    full = {name: " ".join(rng.choice(words) for _ in range(n)) for name, n in (("long", 1500), ("short", 40), ("tiny", 3))}
    for name, text in full.items():
        (tmp_path / f"{name}.txt").write_text(text.replace(" ", "\n ", 7))
    known, cover = licenses.templates_in(spark, str(tmp_path))
    assert {r.license_id for r in known.collect()} == set(full)
    cut = full["long"].split()
    texts = ["intro text " + full["long"].upper() + " the end", " ".join(cut[150:]), " ".join(cut[:700]), full["short"], full["tiny"], None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r.doc_id, r.license_id): r.containment for r in licenses.scan(docs, known, cover).collect()}

    def shingles(text):
        w = licenses.template_words(text)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = {(d, n): len(shingles(t) & shingles(f)) / len(shingles(f)) for d, t in enumerate(texts) if t for n, f in full.items() if shingles(f)}
    assert set(got) == {k for k, v in want.items() if v >= licenses.CONTAINED} == {(0, "long"), (1, "long"), (3, "short")}
    assert all(abs(got[k] - want[k]) < 1e-6 for k in got)


def test_cover_words_bound_the_containment():
    texts = [t for _, t in licenses.TEMPLATES]
    cover = set(licenses.cover_words(texts))
    for text in texts:
        w = licenses.template_words(text)
        sh = [set(w[i : i + 5]) for i in range(len(w) - 4)]
        assert sum(not (x & cover) for x in sh) < licenses.CONTAINED * len(sh)


# ---- decontamination


def brute_hits(text, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words, hit, named = pattern.findall(low(text)), set(), set()
    for item, body in items:
        w = pattern.findall(low(body))
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            for at in range(len(words) - n + 1):
                if words[at : at + n] == w[k : k + n]:
                    hit |= set(range(at, at + n))
                    if item is not None:
                        named.add(str(item))
    named = sorted(named)
    return len(words), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)


def test_decontamination_against_brute_force(spark):
    R = random.Random(2)
    word = lambda: R.choice(["a", "b", "Ab", "ç", "d2"])
    items = [(i, " ".join(word() for _ in range(R.choice([1, 3, 9, 10, 11, 25])))) for i in range(8)]
    items += [(3, "a b"), (None, "ç ç d2"), (50, None), (51, ""), (52, "--")]
    texts = [" ".join(word() for _ in range(R.randint(0, 120))) for _ in range(60)] + [None, "", "a", "x" * 50_000]
    texts += [f"pre {items[5][1].upper()}, post" for _ in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("spans", F.lit(0))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = {i: brute_hits(t, items) for i, t in enumerate(texts)}
    for size in (1 << 24, 300):  # one pass, and several
        got = decontam.report(decontam.find_items(docs, bench, block_bytes=size)).collect()
        assert len(got) == len(texts) and {r.doc_id: tuple(r)[1:] for r in got} == want
        kept = decontam.clean(docs, bench, block_bytes=size)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if not w[4]}
    assert decontam.find_items(docs, bench.limit(0)).where("size(items) > 0").count() == 0
    assert decontam.find_items(docs.limit(0), bench).count() == 0
