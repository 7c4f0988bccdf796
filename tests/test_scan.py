import numpy as np
from pyspark.sql import functions as F

from tidewatch.operators import scan


def frame(spark, values, keys=None):
    keys = keys or ["a"] * len(values)
    return spark.createDataFrame([(k, float(v), i) for i, (k, v) in enumerate(zip(keys, values))], "k string, v double, i bigint")


def test_row_number_is_a_permutation_in_order(spark):
    rng = np.random.default_rng(1)
    values = np.round(rng.normal(size=500), 1)  # many ties
    df = frame(spark, values)
    got = {r["i"]: r["n"] for r in scan.row_number(df, [], "v", ["i"], "n").collect()}
    order = sorted(range(500), key=lambda i: (values[i], i))
    assert [got[i] for i in order] == list(range(500))


def test_running_total_descending_per_key(spark):
    values = [3, 1, 2, 2, 5, 4]
    df = frame(spark, values, ["a", "a", "a", "b", "b", "b"]).withColumn("g", F.floor("v").cast("int"))
    out = scan.running_total(df, ["k"], "g", [F.col("v").desc()], {"s": F.col("v")}, descending=True)
    assert {(r["k"], r["v"]): r["s"] for r in out.collect()} == {
        ("a", 3.0): 3, ("a", 2.0): 5, ("a", 1.0): 6, ("b", 5.0): 5, ("b", 4.0): 9, ("b", 2.0): 11,
    }


def test_exact_quantiles_equal_numpy_with_hot_value(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([np.full(400, 7.0), rng.exponential(size=777) * 10])
    probs = [0.0, 0.001, 0.3, 0.5, 0.77, 0.999, 1.0]
    got = {r["prob"]: r["quantile"] for r in scan.exact_quantiles(frame(spark, values), ["k"], "v", probs).collect()}
    for p in probs:
        assert abs(got[p] - np.quantile(values, p)) < 1e-9


def brute_runs(flags):
    out, start = [], None
    for i, f in enumerate(flags):
        start = (start if start is not None else i) if f else None
        out.append(start)
    return out


def test_runs_over_chunk_borders(spark):
    rng = np.random.default_rng(3)
    for flags in (
        [True] * 40,
        [False] * 40,
        list(rng.random(200) < 0.8),
        list(rng.random(200) < 0.1),
        [False] + [True] * 30 + [False] + [True] * 9,
    ):
        df = spark.createDataFrame([("s", i, bool(f)) for i, f in enumerate(flags)], "k string, p bigint, f boolean")
        out = scan.runs(df, ["k"], "p", F.col("f"), "start", chunk=8)
        got = [r["start"] for r in out.orderBy("p").collect()]
        assert got == brute_runs(flags)


def test_count_below(spark):
    array = [float(x) for x in (1, 3, 3, 5, 8, 9, 11)]
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 4, 9.5, 12)], "v double")
    got = df.select(scan.count_below(F.array(*[F.lit(a) for a in array]), F.col("v"), 3).alias("n")).collect()
    assert [r["n"] for r in got] == [sum(a < v for a in array) for v in (0, 1, 2, 3, 4, 9.5, 12)]


def test_binary_search_follows_the_arrays_size(spark):
    from pyspark.sql import functions as F

    for size in (0, 1, 2, 127, 128, 200, 1000):
        array = [float(2 * i) for i in range(size)]
        values = [-1.0, 0.0, 1.0, float(size), float(2 * size - 1), 1e9]
        df = spark.createDataFrame([(v,) for v in values], "v double")
        grid = F.array(*[F.lit(a) for a in array]).cast("array<double>")
        got = [r["n"] for r in df.select(scan.count_below(grid, F.col("v")).alias("n")).collect()]
        assert got == [sum(a < v for a in array) for v in values], size


def test_row_number_keeps_null_keys_and_cuts_common_values(spark, monkeypatch):
    monkeypatch.setattr(scan, "BUCKET_ROWS", 50)
    rows = [(None if i % 3 == 0 else "k", 1.0 if i % 2 else float(i % 17), i) for i in range(1200)]
    df = spark.createDataFrame(rows, "k string, v double, i bigint").repartition(5)
    got = {r["i"]: r["n"] for r in scan.row_number(df, ["k"], "v", ["i"], "n").collect()}
    assert len(got) == len(rows)
    for key in (None, "k"):
        order = sorted((v, i) for k, v, i in rows if k == key)
        assert [got[i] for _, i in order] == list(range(len(order)))
    # The value half of all rows share does not stay in one part.
    placed = scan.add_bucket(df, ["k"], "v")
    parts = scan.split_ties(placed, ["k"], "v", "i").groupBy("k", "_part").count()
    assert parts.agg({"count": "max"}).first()[0] < 200
