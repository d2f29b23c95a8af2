import datetime
import random
from collections import defaultdict

from pyspark.sql import functions as F

from polispark.operators import skew as S


def data(spark, n=3000):
    rng = random.Random(5)
    rows = [(("hot" if rng.random() < 0.35 else f"k{rng.randrange(400)}"), f"o{rng.randrange(50)}", rng.choice([None, 1, 2, 50])) for _ in range(n)]
    rows += [(None, "o1", 5), ("k1", None, 7), ("k1", None, 7)]
    return rows, spark.createDataFrame(rows, "key string, other string, amount bigint")


def test_stats_equal_brute_force(spark):
    rows, df = data(spark)
    n, a, o = defaultdict(int), defaultdict(lambda: None), defaultdict(set)
    for k, x, m in rows:
        if k is not None:
            n[k] += 1
            if m is not None:
                a[k] = (a[k] or 0) + m
            if x is not None:
                o[k].add(x)
    got = {r.key: (r.n_rows, r.amount, r.n_other) for r in S.per_key_stats(df, "key", "other", "amount").collect()}
    assert got == {k: (n[k], a[k], len(o[k])) for k in n}
    heavy = [r.key for r in S.per_key_stats(df, "key", "other", "amount", share=0.1).collect() if r.is_heavy]
    assert heavy == ["hot"]


def test_heavy_keys(spark):
    _, df = data(spark)
    assert S.heavy_keys(df, ["key"], 0.1) == [("hot",)]
    assert ("hot", "o1") in S.heavy_keys(df, ["key", "other"], 0.003)
    assert S.heavy_keys(df.limit(0), ["key"]) == []
    assert S.heavy_keys(df.where("key IS NULL"), ["key"]) == []


def test_joins_equal_plain_joins(spark, monkeypatch):
    _, left = data(spark)
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), (None, 4), ("zz", 5)], "key string, v int")
    for limit in (100, 0):  # broadcast, and salted
        monkeypatch.setattr(S, "BROADCAST_ROWS", limit)
        monkeypatch.setattr(S, "SMALL_BYTES", -1)
        for how in ("inner", "left", "left_semi", "left_anti"):
            want = sorted(map(str, left.join(right, ["key"], how).collect()))
            assert sorted(map(str, S.skew_join(left, right, ["key"], how).collect())) == want, (limit, how)


def test_empty(spark):
    _, left = data(spark)
    right = spark.createDataFrame([], "key string, v int")
    assert S.skew_join(left, right, ["key"], "left").count() == left.count()
    assert S.skew_join(left.limit(0), right, ["key"], "left").count() == 0
    assert S.per_key_stats(left.limit(0), "key", "other", "amount").count() == 0


def test_keys_of_any_type(spark):
    """Composite and typed keys: date, decimal, timestamp, binary."""
    left = spark.range(4000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id) END AS a", "date_add(DATE '2020-01-01', int(id % 3)) AS d", "CAST(id % 3 AS DECIMAL(5,2)) AS m", "timestamp_micros(id % 3) AS t", "CAST(string(id % 3) AS BINARY) AS b", "id AS v")
    for cols in (["a", "d"], ["a", "m"], ["a", "t"], ["a", "b"], ["d"], ["t", "m", "b"]):
        assert S.heavy_keys(left, cols, 0.2)
        right = left.select(*cols).distinct().withColumn("w", F.lit(1))
        assert S.skew_join(left, right, cols, "inner", share=0.2).count() == 4000
        assert S.skew_join(left, right, cols, "left_anti", share=0.2).count() == 0
    assert S.heavy_keys(left, ["a", "d"], 0.2) == [("hot", datetime.date(2020, 1, 1))]
    wide = left.selectExpr("CAST(v % 5 AS INT) AS k", "v")
    assert S.skew_join(wide, spark.range(5).selectExpr("id AS k", "1 AS w"), ["k"], "inner", share=0.1).count() == 4000


def test_many_partitions_make_small_keys_heavy(spark):
    """A key of half a per cent fills a partition of two hundred."""
    df = spark.range(20_000).selectExpr("CASE WHEN id % 200 = 0 THEN -1L ELSE id END AS k")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert S.heavy_keys(df, ["k"]) == [(-1,)]
        assert S.heavy_share(df, 10**12) == S.LEAST_SHARE
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert S.heavy_keys(df, ["k"]) == []


def test_right_sides_with_hot_keys(spark, monkeypatch):
    _, right = data(spark)
    right = right.selectExpr("key", "other AS o", "amount AS w")
    left = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), (None, 4), ("zz", 5)], "key string, v int")
    for limit in (100, 0):
        monkeypatch.setattr(S, "BROADCAST_ROWS", limit)
        for how in ("inner", "left", "left_semi", "left_anti"):
            want = sorted(map(str, left.join(right, ["key"], how).collect()))
            assert sorted(map(str, S.skew_join(left, right, ["key"], how, share=0.1, many=True).collect())) == want, (limit, how)
