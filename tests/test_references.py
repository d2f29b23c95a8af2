from polispark.operators import references as R


def test_masks_and_times(spark):
    refs = [
        (1, "a", "x", "2020-01-02"), (2, "a", "y", "2020-01-02"), (3, "a", "z", "2020-01-02"), (4, None, "x", "2020-01-02"), (5, "b", None, "2020-01-02"),
        (6, None, None, "2020-01-02"), (7, "c", None, "2020-01-02"), (8, "a", "x", None), (1, "a", "x", "2020-01-02"),
    ]
    r = spark.createDataFrame(refs, "id int, t string, k string, at string").selectExpr("id", "t", "k", "timestamp(at) at", "'x' AS extra")
    targets = spark.createDataFrame([("a", "x", "2020-01-01"), ("a", "x", "2021-01-01"), ("a", "y", "2020-01-03"), ("b", "q", "2019-01-01")], "t string, k string, c string").selectExpr("t", "k", "timestamp(c) created_at", "'y' AS extra")
    run = lambda match: {x.id: x.status for x in R.reference_status(r, targets, ["t", "k"], "at", match).collect()}
    base = {1: "ok", 2: "late", 3: "missing", 6: "ok", 8: "ok"}
    assert run("partial") == base | {4: "ok", 5: "ok", 7: "missing"}
    assert run("simple") == base | {4: "ok", 5: "ok", 7: "ok"}
    assert run("full") == base | {4: "missing", 5: "missing", 7: "missing"}
    assert R.reference_status(r, targets, ["t", "k"], "at").count() == len(refs)


def test_empty(spark):
    r = spark.createDataFrame([(1, "a", "x", None)], "id int, t string, k string, at timestamp")
    targets = spark.createDataFrame([], "t string, k string, created_at timestamp")
    assert [x.status for x in R.reference_status(r, targets, ["t", "k"], "at").collect()] == ["missing"]
    assert R.reference_status(r.limit(0), targets, ["t", "k"], "at").count() == 0
