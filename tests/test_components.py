"""Classes of shared signatures against plain Python."""

from tritloom.operators import similarity as S


def test_signature_components_are_whole(spark):
    buckets = [(0, "p", (1, 9)), (1, "q", (2, 9)), (2, "r", (2, 7)), (3, "s", (7, 2)), (0, "t", (5,)), (1, "u", (20, 21)), (0, "v", (21, 22)), (2, "w", (22, 23))]
    signed = spark.createDataFrame([(v, b, s) for b, s, members in buckets for v in members], "vec_id bigint, band int, signature string")
    got = {(r.vec_id, r.class_id, r.n_links) for r in S.signature_components(signed, "vec_id").collect()}
    assert got == {(1, 1, 1), (9, 1, 2), (2, 1, 2), (7, 1, 1), (5, 5, 0), (20, 20, 1), (21, 20, 2), (22, 20, 2), (23, 20, 1)}
    assert S.signature_components(signed.limit(0), "vec_id").count() == 0


def test_spread_leaves_even_files_alone(spark, tmp_path):
    """A table that is in enough even files already is not shuffled; one file is dealt out."""
    from tritloom.shared import spread

    df = spark.range(8000)
    dealt = lambda path: "Repartition" in spread(spark.read.parquet(path))._jdf.queryExecution().optimizedPlan().toString()
    df.repartition(8).write.parquet(f"{tmp_path}/even")
    df.coalesce(1).write.parquet(f"{tmp_path}/one")
    df.repartition(8).where("id % 50 = 0").unionByName(df.coalesce(1)).write.parquet(f"{tmp_path}/uneven")
    assert [dealt(f"{tmp_path}/{x}") for x in ("even", "one", "uneven")] == [False, True, True]


def test_partners_of_a_large_bucket_are_counted_without_pairs(spark):
    import random

    R = random.Random(4)
    rows = [(v, b, f"s{R.randrange(3)}" if v % 9 else f"own{v}") for v in range(80) for b in range(4)]
    signed = spark.createDataFrame(rows, "vec_id bigint, band int, signature string")
    of = {}
    for v, b, s in rows:
        of.setdefault((b, s), set()).add(v)
    got = {r.vec_id: r.n_links for r in S.signature_components(signed, "vec_id").collect()}
    assert got == {v: len(set().union(*(m for m in of.values() if v in m))) - 1 for v in range(80)}
    big = signed.select("vec_id").distinct().selectExpr("vec_id", "0 as band", "'s' as signature")
    out = S.signature_components(big, "vec_id")
    assert {r.n_links for r in out.collect()} == {79}
    assert "partner" not in out._jdf.queryExecution().optimizedPlan().toString()
