"""Every registered query of the vector engine: against SQL where it has any, else that it runs."""

import pytest

from tritloom.plans import ORACLE_SQL, QUERIES

from .oracle import SF, same, tables


@pytest.fixture(scope="module")
def con():
    return tables()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    same(spark, con, QUERIES[name], ORACLE_SQL[name])


def test_systematic_sample(spark):
    from pyspark.sql import functions as F

    from tritloom.operators.store import systematic_sample

    df = spark.range(1000).withColumn("x", F.col("id") % 7)
    got = systematic_sample(df, ["id"], 100)
    assert got.columns == ["id", "x"] and got.count() == 10
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in systematic_sample(df.repartition(3), ["id"], 100).collect())
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in systematic_sample(df, ["id"], 100, digits=1).collect())
    assert systematic_sample(df.limit(0), ["id"], 100).count() == 0
    nulls = df.withColumn("k", F.when(F.col("x") > 0, F.col("x"))).select("k")
    assert systematic_sample(nulls, ["k"], 10).count() == 100


def test_resonator_recovers_most_factors(spark):
    rows = QUERIES["w9_resonator_factors"](spark, SF).collect()
    assert len(rows) == 150 and sum(r.segment_right for r in rows) > 120


def test_principal_basis_is_orthonormal(spark):
    import numpy as np

    rows = QUERIES["v18_principal_basis"](spark, SF).collect()
    basis = np.zeros((8, 64))
    for r in rows:
        basis[r.id, r.dim] = r.weight
    assert np.allclose(basis @ basis.T, np.eye(8), atol=1e-6)


def test_entry_runs():
    import __spark_entry__ as e

    assert set(ORACLE_SQL) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())
