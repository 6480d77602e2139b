"""Invariants of the algebra, and equality of its representations."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tritloom.operators import algebra as A
from tritloom.operators import codebook as C
from tritloom.operators import similarity as S

D = 40


def frame(spark, vectors):
    rows = [(k, d, t) for k, v in vectors.items() for d, t in v.items() if t]
    return spark.createDataFrame(rows, "vec_id bigint, dim int, trit int")


def back(df):
    out = {}
    for r in df.collect():
        assert r.dim not in out.setdefault(r.vec_id, {})
        out[r.vec_id][r.dim] = r.trit
    return out


def vectors(seed, n=6):
    R = random.Random(seed)
    return {k: {d: R.choice([-1, 1]) for d in range(D) if R.random() < 0.4} for k in range(n)}


def test_bind_is_its_own_inverse_on_the_support(spark):
    a, b = vectors(1), vectors(2)
    fa, fb = frame(spark, a), frame(spark, b)
    bound = A.bind(fa, fb, ["vec_id"], ["vec_id"])
    again = back(A.unbind(bound, fb, ["vec_id"], ["vec_id"]))
    for k in a:
        assert again.get(k, {}) == {d: t for d, t in a[k].items() if d in b[k]}


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10**6))
def test_bundle_permute_thin(spark, seed):
    a, b = vectors(seed), vectors(seed + 1)
    fa, fb = frame(spark, a), frame(spark, b)
    got = back(A.bundle(fa, fb, ["vec_id"]))
    for k in a:
        sums = {d: a[k].get(d, 0) + b[k].get(d, 0) for d in range(D)}
        assert got.get(k, {}) == {d: (s > 0) - (s < 0) for d, s in sums.items() if s}
    assert back(A.permute(A.permute(fa, 7, D), -7, D)) == {k: v for k, v in a.items() if v}
    both = fa.unionByName(fb)
    counted = A.votes(both, ["vec_id"])
    assert all(len(v) <= 5 for v in back(A.thin(counted, ["vec_id"], 5).withColumn("trit", F.col("votes"))).values())
    assert back(A.signed(A.unbundle(counted, fb, ["vec_id"]))) == {k: v for k, v in a.items() if v}
    assert A.conflicts(fa, ["vec_id"]).count() == 0
    assert A.conflicts(A.resolved(both, ["vec_id"]), ["vec_id"]).count() == 0


def test_ternary_tables_are_exhaustive(spark):
    table = {"add": lambda x, y: (x + y > 0) - (x + y < 0), "sub": lambda x, y: (x - y > 0) - (x - y < 0), "and": min, "or": max, "xor": lambda x, y: -x * y}
    pairs = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1)]
    a, b = frame(spark, {1: {i: x for i, (x, _) in enumerate(pairs)}}), frame(spark, {1: {i: y for i, (_, y) in enumerate(pairs)}})
    for name, f in table.items():
        got = back(A.compute(a, b, name, "vec_id", 9)).get(1, {})
        assert got == {i: f(x, y) for i, (x, y) in enumerate(pairs) if f(x, y)}


def test_packed_metrics_equal_plain_ones(spark):
    v = vectors(5, 8) | {90: {}}
    packed = S.pack(frame(spark, v), "vec_id", D)
    assert back(S.unpack(packed, "vec_id")) == {k: x for k, x in v.items() if x}
    p = packed.select("vec_id", F.col("pos").alias("apos"), F.col("neg").alias("aneg"))
    q = packed.select(F.col("vec_id").alias("other"), F.col("pos").alias("bpos"), F.col("neg").alias("bneg"))
    for r in S.pair_metrics(p.join(q), ["vec_id", "other"], D).collect():
        a, b = v[r.vec_id], v[r.other]
        x, y = [a.get(d, 0) for d in range(D)], [b.get(d, 0) for d in range(D)]
        assert r.dot == sum(i * j for i, j in zip(x, y, strict=True))
        assert r.hamming == sum(i != j for i, j in zip(x, y, strict=True))
        assert abs(r.cosine - r.dot / (len(a) * len(b)) ** 0.5) < 1e-6
        assert abs(r.jaccard - sum(i == j != 0 for i, j in zip(x, y, strict=True)) / len(a.keys() | b.keys())) < 1e-6
        assert r.vec_id != r.other or r.cosine == 1.0


def test_codebook_is_deterministic_and_nearly_orthogonal(spark):
    book = C.codebook(spark, "byte", 20, 10_000, 200)
    one = {(r.id, r.dim): r.trit for r in book.collect()}
    assert one == {(r.id, r.dim): r.trit for r in C.codebook(spark, "byte", 20, 10_000, 200).collect()}
    assert len(one) == book.count()
    dots = book.join(book.withColumnRenamed("id", "o").withColumnRenamed("trit", "u"), "dim").where("id < o").groupBy("id", "o").agg(F.sum(F.col("trit") * F.col("u")).alias("d"))
    assert dots.agg(F.max(F.abs("d"))).first()[0] < 30


def test_encode_decode_accuracy_band_and_exact_extract(spark):
    R = random.Random(9)
    files = [(k, bytes(R.randrange(256) for _ in range(n))) for k, n in enumerate((0, 1, 7, 8, 9, 400))] + [(6, "Ünïcødé — ≠".encode())]
    df = spark.createDataFrame(files, "item_id bigint, data binary")
    bound = C.bound_codebook(spark).cache()
    rows = C.byte_rows(df, "item_id", "data")
    decoded = C.decode_chunks(C.encode_chunks(rows, bound, "item_id"), bound, "item_id")
    cmp = C.compared(rows, decoded, "item_id").cache()
    right, n = cmp.where("byte = decoded").count(), cmp.count()
    assert 0.85 <= right / n <= 0.99
    sizes = df.select("item_id", F.octet_length("data").alias("size"))
    got = {r.item_id: bytes.fromhex(r.hex) for r in C.reconstruct(decoded, C.corrections(cmp, "item_id"), sizes, "item_id").collect()}
    assert got == {k: v for k, v in files if v}


def test_empty_inputs(spark):
    empty = frame(spark, {0: {}}).limit(0)
    assert A.bundle(empty, empty, ["vec_id"]).count() == 0 and A.votes(empty, []).count() == 0
    p = S.pack(empty, "vec_id", D)
    assert p.count() == 0
    assert S.exact_search(p, p.select(F.col("vec_id").alias("query_id"), F.col("pos").alias("qpos"), F.col("neg").alias("qneg")), D, 5).count() == 0


def test_bundle_arrays_adds_repeated_keys_and_groups_without_arrays(spark):
    rows = [(1, [0.5, -0.5, 0.0, 1.0], 0), (1, [0.5, 0.5, -1.0, None], 1), (2, None, 0), (3, [0.2, -0.9], None), (4, [], 7), (None, [0.9], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    members = spark.createDataFrame([(0, 0, -1), (0, 3, 1), (0, 5, 1), (1, 2, 1)], "label int, dim int, trit int")
    mine = df.select("vec_id", "label").join(members, "label")
    want = sorted(map(tuple, A.bundle(A.from_arrays(df, "vec_id", "embedding", 0.1), mine, ["vec_id"]).collect()), key=str)
    got = A.bundle_arrays(df, "vec_id", "embedding", "label", members, 0.1)
    assert sorted(map(tuple, got.collect()), key=str) == want and got.columns == ["vec_id", "dim", "trit"]
    # What is grouped are keys, not dims of keys.
    import re

    assert not re.search(r"Aggregate \[vec_id#\d+L?, dim", got._jdf.queryExecution().optimizedPlan().toString())


def test_random_vectors_group_ids_only(spark):
    from tritloom.operators import codebook as C

    v = C.random_vectors(spark.createDataFrame([(1,), (2,), (2,), (None,)], "id int"), "t", "id", 16, 20)
    got = {}
    for r in v.collect():
        assert got.setdefault((r.id, r.dim), r.trit) == r.trit
    import hashlib

    want = {}
    for i in (1, 2, None):
        for k in range(20):
            d = int(hashlib.md5("|".join(["t", *([str(i)] if i else []), str(k)]).encode()).hexdigest()[:8], 16) % 16
            want.setdefault((i, d), 1 if k % 2 == 0 else -1)
    assert got == want and v.count() == len(want)
    plan = v._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "min(" not in plan
