"""Ordered scans against plain windows, with a key that holds most rows."""

import pytest
from pyspark.sql import Window as W, functions as F

from engram.operators import ordered as o


@pytest.fixture(scope="module", autouse=True)
def many_runs(spark):
    """Small runs would be merged into one, which would leave the carry between runs untested."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, "true")


@pytest.fixture(scope="module")
def skewed(spark, many_runs):
    rows = [(("hot" if i % 10 else f"k{i % 7}") if i % 50 else None, i, (i * 37) % 11 if i % 3 else None) for i in range(4000)]
    return spark.createDataFrame(rows, "k STRING, i LONG, v LONG").repartition(5)


def test_prefixes_equal_plain_windows(skewed):
    got = o.ordered_scan(
        skewed, ["k"], ["i"],
        {"prev": o.lag("v"), "n": o.rows_before(), "s": o.sum_before("v"), "m": o.max_before("v"), "l": o.last_before("v")},
    )
    w = W.partitionBy("k").orderBy("i")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    want = skewed.select(
        "k", "i", "v", F.lag("v").over(w).alias("prev"), (F.row_number().over(w) - 1).cast("long").alias("n"), F.sum("v").over(before).alias("s"),
        F.max("v").over(before).alias("m"), F.last("v", ignorenulls=True).over(before).alias("l"),
    )
    key = lambda r: r["i"]
    assert sorted(got.select(want.columns).collect(), key=key) == sorted(want.collect(), key=key)


def test_texts_stay_out_of_the_sort(spark, skewed):
    """Whole rows come back, rows that agree in keys and order and fully equal ones included."""
    wide = skewed.withColumn("text", F.concat(F.lit("t"), F.col("i"))).unionByName(
        spark.createDataFrame([("hot", 5, 7, "other"), ("hot", 5, 7, "other"), (None, 50, None, "x")], "k STRING, i LONG, v LONG, text STRING"))
    got = o.ordered_scan(wide, ["k"], ["i"], {"n": o.rows_before(), "s": o.sum_before("v")}, carry=[])
    assert sorted(map(repr, got.drop("n", "s").collect())) == sorted(map(repr, wide.collect()))
    numbers = sorted(r.n for r in got.filter("k = 'hot'").collect())
    assert numbers == list(range(len(numbers)))
    same = o.ordered_scan(skewed, ["k"], ["i"], {"s": o.sum_before("v")}).select("i", "s")
    text = skewed.withColumn("text", F.lit("x"))
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, o.ordered_scan(text, ["k"], ["i"], {"s": o.sum_before("v")}, carry=[]).select("i", "s").collect()))


def test_rows_move_once(skewed):
    """No exchange behind the sorted runs: what follows the checkpoint is a broadcast of one row per run."""
    out = o.ordered_scan(skewed, ["k"], ["i"], {"s": o.sum_before("v"), "p": o.lag("v")})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(_run" not in plan and "Window" in plan
    rows, carry = plan.split("BroadcastExchange", 1)
    assert "Exchange" not in rows and "Window" not in rows
    assert "_head" in carry.split("Window", 1)[1]


def test_other_types(spark, many_runs):
    """Reals, times, structs and dates; sums of reals are those of the key alone."""
    rows = [(i % 3, i, None if i % 4 == 0 else i / 7 + (1e15 if i % 3 == 1 else 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "k INT, i INT, x DOUBLE").withColumns({
        "t": F.timestamp_seconds(F.col("i") * 37 % 100), "d": F.date_add(F.lit("2020-01-01"), F.col("i") % 9), "p": F.when(F.col("i") % 5 == 0, F.struct("i", "x"))})
    got = o.ordered_scan(df.repartition(4), ["k"], ["i"], {"s": o.sum_before("x"), "m": o.max_before("t"), "y": o.lag("d"), "l": o.last_before("p")})
    w = W.partitionBy("k").orderBy("i")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    want = df.select(*df.columns, F.sum("x").over(before).alias("s"), F.max("t").over(before).alias("m"), F.lag("d").over(w).alias("y"), F.last("p", ignorenulls=True).over(before).alias("l"))
    a, b = ({r.i: r for r in x.collect()} for x in (got, want))
    assert all(a[i][c] == b[i][c] for i in a for c in ("m", "y", "l"))
    assert all((a[i].s is None) == (b[i].s is None) and (a[i].s is None or abs(a[i].s - b[i].s) <= 1e-12 * abs(b[i].s)) for i in a)


def test_empty_scan(skewed):
    assert o.ordered_scan(skewed.limit(0), ["k"], ["i"], {"s": o.sum_before("v")}).count() == 0


def test_global_scan(skewed):
    got = o.ordinals(skewed.select("i"), ["i"]).orderBy("i").collect()
    assert [r["ordinal"] for r in got] == list(range(4000))


def test_hot_key_is_spread_over_runs(skewed):
    runs = o.sorted_runs(skewed, ["k", "i"]).filter("k = 'hot'").groupBy("_run").count().collect()
    assert len(runs) > 1


def test_last_n_pairs(skewed):
    got = o.last_n_pairs(skewed.filter("k IS NOT NULL"), ["k"], ["i"], 4, ["i"])
    rn = F.row_number().over(W.partitionBy("k").orderBy("i"))
    r = skewed.filter("k IS NOT NULL").withColumn("rn", rn)
    want = r.alias("a").join(r.alias("b"), F.expr("a.k = b.k AND a.rn - b.rn BETWEEN 1 AND 4")).select("a.i", F.col("b.i").alias("prev_i"))
    assert sorted(map(tuple, got.select("i", "prev_i").collect())) == sorted(map(tuple, want.collect()))
