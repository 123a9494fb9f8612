"""Features of pairs within libraries by matrices, against the declared plan and against Spark's plan of the labelled pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy import cohorts, plans
from colloquy.domain import statement
from colloquy.plans import procedures

VECTORS = "vec_id long, library_id long, recording_id long, embedding array<double>, reliable boolean"


def voices(spark):
    """Two libraries, one with odd vectors: null, empty, zero, of another length, with a null, NaN."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 6)) + rng.normal(size=(5, 6))[np.arange(90) % 5] * 1.5
    rows = [(i, i // 60, int(i % 4), [float(v) for v in r], i % 11 != 0) for i, r in enumerate(x)]
    odd = [None, [], [0.0] * 6, [1.0, 2.0], [1.0, None, 0.0, 0.0, 0.0, 1.0]]
    return spark.createDataFrame([*rows, *[(200 + i, 1, i % 4, v, True) for i, v in enumerate(odd)]], VECTORS)


@pytest.mark.parametrize("side", [4, 33, 1000])
def test_features_are_those_of_the_plan(spark, side):
    v = voices(spark)
    want = {(r.a, r.b): (r.cosine, r.z) for r in plans.run(spark, {"vectors": v}, "REC-01").collect()}
    rows = cohorts.packed(v.where("reliable").drop("reliable"))
    got = cohorts.pairs(cohorts.deviations(rows, side), side).collect()
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == set(want)
    assert all(abs(r.c - want[r.a, r.b][0]) < 1e-6 and abs(r.z - want[r.a, r.b][1]) < 1e-4 for r in got)


def test_labelled_pairs_are_joined_to_their_own_features(spark, sf_dir):
    """The features of the labelled pairs are those that all pairs have, without a row for each of all pairs."""
    z = {(r.a, r.b): (r.cosine, r.z) for r in plans.run(spark, sf_dir, "REC-01").collect()}
    gold = statement(spark, sf_dir, "SELECT a, b FROM gold_pairs WHERE verdict <> 'unsure' AND role = 'development'").collect()
    got = {(r.a, r.b): (r.cosine, r.z) for r in procedures.labelled(spark, sf_dir).collect()}
    assert got == {(r.a, r.b): z[min(r.a, r.b), max(r.a, r.b)] for r in gold if (min(r.a, r.b), max(r.a, r.b)) in z} and got


def test_gold_pairs_meet_within_their_library_alone(spark, sf_dir):
    """The join has two keys, the place and the library, so it doesn't grow with the square of the speakers."""
    plan = statement(spark, sf_dir, "SELECT * FROM gold_pairs").select(F.col("a"))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line and "- 1)" in line]
    assert joins and all("substring" in line for line in joins)
    keys = statement(spark, sf_dir, "SELECT * FROM gold_pairs")._jdf.queryExecution().executedPlan().toString()
    assert any("substring(" in line and "Join [" in line for line in keys.splitlines())
