from tessaline.llm import spread


def test_once(spark, monkeypatch):
    rows = [("a", 1), ("a", 1), ("b", 2), (None, 3), ("c", None), ("c", None), ("c", None)]
    df = spark.createDataFrame(rows, "key string, x int").selectExpr("*", "1 as _other")
    for most in (10, 0):
        monkeypatch.setattr(spread, "BROADCAST_KEYS", most)
        assert sorted((r.key, r.x) for r in spread.once(df, "key").collect()) == [("a", 1), ("b", 2), ("c", None)]
    assert spread.once(df.limit(0), "key").count() == 0
