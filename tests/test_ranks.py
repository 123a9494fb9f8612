import math
import random

import pytest

from colloquy.ranks import nearest_rank


def want(values, share):
    return sorted(values)[max(1, math.ceil(share * len(values) - 1e-9)) - 1]


@pytest.mark.parametrize("share", [0.95, 0.5, 0.0, 1.0])
def test_ranks_of_groups(spark, share):
    rng = random.Random(5)
    groups = {"many": [rng.gauss(0, 1e3) for _ in range(5000)], "ties": [3.0] * 400 + [rng.choice([1.0, 2.0, 3.0, 9.0]) for _ in range(300)], "one": [7.5], "two": [1.0, 2.0], "far": [-1e308, 1e308, 0.0, 5e-324, -5e-324, 1.0], "equal": [4.0] * 99, None: [1.0, 2.0, 3.0], "twenty": [float(i) for i in range(20)], "powers": [10.0**e for e in range(-12, 13, 2)]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("many", None), ("many", float("nan")), ("none", None)]
    rng.shuffle(rows)
    got = {r.g: r.x for r in nearest_rank(spark.createDataFrame(rows, "g string, x double"), "x", share, ["g"], buckets=256).collect()}
    assert got == {g: want(xs, share) for g, xs in groups.items()}


def test_whole_tables_and_whole_numbers(spark):
    ids = [2**62 + i for i in range(100)] + [-(2**62), 5, 5, 5]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    for share in (0.1, 0.5, 0.95):
        assert nearest_rank(df, "id", share).collect() == [(want(ids, share),)]
    assert nearest_rank(df.limit(0), "id", 0.5).count() == 0
