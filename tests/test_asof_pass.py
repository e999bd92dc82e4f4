"""As-of lookups carry entries on in one pass, and write no entry but one per partition."""

import random

from pyspark.sql import functions as F

from quayside.operators import asof


def test_only_rows_and_borders_are_written(spark, monkeypatch):
    left = spark.range(400).select("id", (F.col("id") % 3).alias("k"), (F.col("id") % 50).cast("int").alias("t"))
    right = spark.range(6000).select((F.col("id") % 3).alias("k"), (F.col("id") % 40).cast("int").alias("t"), F.col("id").alias("v"))
    placed = []
    monkeypatch.setattr(asof, "stable", lambda df: placed.append(df) or df)
    got = asof.as_of_join(left, right, ["k"], F.col("t"), F.col("t"), ["v"], 6)
    want = {(k, t): max(v for v in range(6000) if v % 3 == k and v % 40 == max(u for u in range(40) if u <= t)) for k in range(3) for t in range(50)}
    assert {(r.k, r.t): r.v for r in got.collect()} == want
    assert placed[0].count() <= 400 + 6
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_keys_of_all_kinds_over_batches(spark, monkeypatch):
    """Nulls, NaNs and structs as keys, in batches of few rows."""
    monkeypatch.setattr(asof, "stable", lambda df: df)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = random.Random(4)
        real = lambda: rng.choice([None, float("nan"), 0.0, -0.0, 1.5])
        rows = [(i, real(), rng.choice("ab"), rng.randrange(60)) for i in range(300)]
        entries = [(real(), rng.choice("ab"), rng.randrange(60), rng.randrange(1000)) for _ in range(80)]
        left = spark.createDataFrame(rows, "id long, r double, s string, t int").withColumn("s", F.struct("s"))
        right = spark.createDataFrame(entries, "r double, s string, t int, v long").withColumn("s", F.struct("s"))
        got = {r.id: r.v for r in asof.as_of_join(left, right, ["r", "s"], F.col("t"), F.col("t"), ["v"], 5).collect()}
        kind = lambda x: "nan" if x is not None and x != x else x
        for i, r, s, t in rows:
            fit = [(u, v) for q, z, u, v in entries if r is not None and kind(q) == kind(r) and z == s and u <= t]
            assert got[i] == max(fit, default=(None, None))[1]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
