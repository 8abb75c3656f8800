"""What a worker of the version differences holds is bounded, and nothing is lost by it."""

from termlake.operators import versions

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_bounded_batches_lose_nothing(spark, monkeypatch):
    old, new = " ".join(f"a{i}" for i in range(300)), " ".join(f"b{i}" for i in range(300))
    pairs = spark.createDataFrame([("u", 1, old, new), ("u", 2, new, new), ("v", 1, None, "x y"), ("v", 2, "x y", "")], "url string, version int, old_text string, text string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = [rows(f(pairs)) for f in (versions.token_diff, versions.token_bag_diff)]
    assert len(whole[0]) == len(whole[1]) == 604
    monkeypatch.setattr(versions, "_ROWS", 7)
    monkeypatch.setattr(versions, "_HELD", 50)
    was = spark.conf.get(KEY, None)
    spark.conf.unset(KEY)
    try:
        for f, want in zip((versions.token_diff, versions.token_bag_diff), whole, strict=True):
            spark.conf.unset(KEY)
            df = f(pairs)
            assert spark.conf.get(KEY) == "50" and rows(df) == want
    finally:
        spark.conf.set(KEY, was) if was else spark.conf.unset(KEY)
