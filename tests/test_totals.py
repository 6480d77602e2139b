"""Totals made in the task against the rows they stand for: repeated and null ids, empty and long rows, several pieces."""

import random

import pytest
from pyspark.sql import functions as F

from tritloom.operators import codebook as C
from tritloom.operators import entropy as E


@pytest.fixture(scope="module")
def files(spark):
    R = random.Random(2)
    word = lambda n: "".join(R.choice("abcdefghé ßxyz\n0123") for _ in range(n))
    rows = [(k % 9 if k % 9 else None, word(R.choice((1, 7, 40, 900)))) for k in range(30)] + [(3, None), (20, ""), (21, None), (3, "aaaa" * 90), (22, "a" * 300 + word(300) + "b" * 300)]
    return spark.createDataFrame(rows, "id bigint, text string").repartition(3)


@pytest.mark.parametrize("kept", [1 << 26, 100])
def test_outlier_regions_of(files, monkeypatch, kept):
    monkeypatch.setattr(E, "PIECE", 64)
    monkeypatch.setattr(E, "KEPT", kept)
    for threshold in (2.0, 3.5):
        want = E.outlier_regions(E.entropy(E.byte_counts(files, "id", "text", 16), ["id", "block"]), "id", threshold)
        got = E.outlier_regions_of(files, "id", "text", 16, threshold)
        assert got.columns == want.columns and got.schema["first_block"].dataType == want.schema["first_block"].dataType
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()  # no row a count is shuffled


def test_engram_and_accuracy_totals(spark, files, monkeypatch):
    monkeypatch.setattr(C, "PIECE", 64)
    codes = C.bound_codes(spark, dims=300, draws=12)
    check = (F.col("trit") * (F.col("dim") + 1)).cast("bigint") * (F.col("chunk_no") % 1000 + 1)
    want = C.encode_files(files, codes, "id", "text").groupBy("id").agg(F.countDistinct("chunk_no").alias("n_chunks"), F.count("*").alias("nnz"), F.sum(check).alias("checksum"))
    got = C.engram_totals(files, codes, "id", "text")
    assert sorted(map(str, got.select("id", "n_chunks", "nnz", "checksum").collect())) == sorted(map(str, want.collect()))
    off = F.col("byte") - F.coalesce("decoded", F.lit(0))
    want = C.compared_files(files, codes, "id", "text").groupBy("id").agg(F.count("*").alias("n_bytes"), F.count_if(F.col("byte") == F.col("decoded")).alias("n_right"), F.sum(off * off).alias("off"))
    assert sorted(map(str, C.accuracy_totals(files, codes, "id", "text").collect())) == sorted(map(str, want.collect()))


def test_decode_as_joined(spark, files):
    """Best bytes of arrays against the joins of the long form, ties and missing places included."""
    bound = C.bound_codebook(spark, dims=300, draws=12)
    some = files.where("id > 3 and id < 6").groupBy("id").agg(F.max("text").alias("text"))
    engrams = C.encode_chunks(C.byte_rows(some, "id", "text"), bound, "id")
    want = C.decode_chunks(engrams, bound, "id")
    got = C.decode_files(some, C.bound_codes(spark, dims=300, draws=12), "id", "text")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
