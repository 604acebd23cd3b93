"""Running totals and weighted joins against plain computations."""

import random

from pyspark.sql import functions as F

from quillon.operators import scan


def test_running_totals_of_a_hot_group(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None, "c"]), i, rng.randrange(10)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(5)
    got = {r.i: (r.n, r.s) for r in scan.running(df, ["g"], [F.desc("i")], {"n": F.lit(1), "s": F.col("v")}, keep=["i"]).collect()}
    seen, want = {}, {}
    for g, i, v in sorted(rows, key=lambda r: -r[1]):
        n, s = seen.get(g, (0, 0))
        seen[g] = want[i] = n + 1, s + v
    assert got == want


def test_running_totals_of_nothing(spark):
    assert scan.running(spark.createDataFrame([], "g string, i int"), ["g"], ["i"], {"n": F.lit(1)}).count() == 0


def test_join_with_hot_and_cold_keys(spark):
    rows = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(3000)] + [(None, 5)], "k int, x int")
    table = spark.createDataFrame([(k, f"t{k}", 1000 if k == 0 else 1) for k in range(5)], "k int, t string, n int")
    for how in ("inner", "left"):
        got = sorted(map(repr, scan.joined(rows, table, ["k"], "n", 3000, how).collect()))
        assert got == sorted(map(repr, rows.join(table.drop("n"), "k", how).collect()))
