"""States of column statistics, as-of lookups and spans of days against plain versions."""

from __future__ import annotations

import datetime
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quayside.operators import asof, partitions, profile, spans, statistics

DAY = datetime.date(2020, 1, 1)


def day(n):
    return DAY + datetime.timedelta(days=n)


@pytest.fixture
def measured(spark):
    """A table of all kinds of columns in eight partitions, one of them empty of values."""
    return spark.range(20_000).select(
        F.when(F.col("id") % 8 == 7, None).otherwise((F.col("id") % 8).cast("string")).alias("part"),
        F.when(F.col("id") % 8 != 3, F.col("id") * 7919 % 6007).alias("whole"),
        (F.when(F.col("id") % 5 != 1, F.col("id") % 977 - 400).cast("double") / 8).alias("real"),
        (F.col("id") % 311).cast("decimal(20,2)").alias("exact one"),
        F.date_add(F.lit(DAY), (F.col("id") % 400).cast("int")).alias("date"),
        F.timestamp_seconds(F.col("id") % 5000).alias("moment"),
        F.when(F.col("id") % 9 != 2, F.repeat(F.lit("é"), (F.col("id") % 13).cast("int"))).alias("text"),
        (F.col("id") % 3 == 0).alias("truth"),
        F.array((F.col("id") % 17)).alias("list"),
        F.create_map(F.lit("k"), F.col("id")).alias("map"),
    )


COLUMNS = ["whole", "real", "exact one", "date", "moment", "text", "truth", "list", "map"]
EXACT = ["column_name", "low", "high", "nulls", "max_length", "trues", "falses"]


def shown(df, by=()):
    return sorted(((*[str(r[c]) for c in [*by, *EXACT]], round(r.avg_length, 9) if r.avg_length is not None else None) for r in df.collect()), key=str)


def test_merged_states_equal_a_direct_profile(spark, measured, tmp_path):
    path = str(tmp_path / "states")
    states = lambda df: statistics.column_states(df, COLUMNS, ["part"])
    # Partitions come one load after the other; one is loaded twice, the first time with other rows.
    statistics.save_states(states(measured.where("part in ('0', '1', '2')").withColumn("whole", F.lit(-5).cast("long"))), path, ["part"])
    statistics.save_states(states(measured.where("part in ('0', '1', '2')")), path, ["part"])
    statistics.save_states(states(measured.where("part is null or part not in ('0', '1', '2')")), path, ["part"])
    kept = statistics.saved_states(spark, path, {"part": "string"})
    merged = statistics.merged_states(kept)
    found, direct = statistics.profile_of_states(merged), profile.column_profile(measured, COLUMNS, exact=True)
    assert found.columns == direct.columns
    assert shown(found) == shown(direct)
    by_part = statistics.profile_of_states(kept, ["part"])
    assert shown(by_part, ["part"]) == shown(profile.column_profile(measured, COLUMNS, ["part"], exact=True), ["part"])
    counts = {r.column_name: r.distincts for r in direct.collect()}
    for r in found.collect():
        assert r.distincts == pytest.approx(counts[r.column_name], rel=0.05) if r.column_name != "map" else r.distincts is None
    # Merging merged states changes nothing; no row is repeated per column.
    twice = statistics.merged_states(kept.withColumn("half", F.col("part") < "3").transform(lambda d: statistics.merged_states(d, ["half"])))
    assert shown(statistics.profile_of_states(twice)) == shown(direct)
    for plan in (states(measured), merged):
        assert "Expand" not in plan._jdf.queryExecution().executedPlan().toString()
    quartiles = {r.column_name: r.quantiles for r in statistics.profile_of_states(merged, quantiles=[0.0, 0.5, 1.0]).collect()}
    assert quartiles["text"] is None and quartiles["whole"][1] == pytest.approx(3000, abs=0.03 * 6007)
    assert (quartiles["exact one"][0], quartiles["exact one"][2]) == (0.0, 310.0)


def test_states_of_older_partitions_lack_added_columns(spark, measured, tmp_path):
    path = str(tmp_path / "states")
    statistics.save_states(statistics.column_states(measured.where("part = '0'"), ["whole"], ["part"]), path, ["part"])
    statistics.save_states(statistics.column_states(measured.where("part = '1'"), ["whole", "text"], ["part"]), path, ["part"])
    found = statistics.profile_of_states(statistics.merged_states(statistics.saved_states(spark, path, {"part": "string"})))
    both = measured.where("part in ('0', '1')").withColumn("text", F.when(F.col("part") == "1", F.col("text")))
    assert shown(found) == shown(profile.column_profile(both, ["whole", "text"]))
    nothing = statistics.profile_of_states(statistics.column_states(measured.limit(0), ["whole", "text"]), quantiles=[0.5])
    assert [(r.nulls, r.distincts, r.low, r.quantiles) for r in nothing.collect()] == [(0, 0, None, None)] * 2


def looked_up(rows, entries):
    out = Counter()
    for i, k, t in rows:
        found = max(((u, v) for j, u, v in entries if j == k and k is not None and t is not None and u is not None and u <= t), default=(None, None))
        out[i, k, t, found[1]] += 1
    return out


@pytest.mark.parametrize("partitions_", [1, 3, 40])
def test_as_of_join(spark, partitions_):
    rng = random.Random(7)
    # A third of all rows, and most entries, under one key; many of one moment.
    key = lambda: "hot" if rng.random() < 0.35 else rng.choice(["a", "b", "c", "lone", None])
    rows = [(i, key(), rng.choice([None, 50, rng.randrange(100)])) for i in range(3000)]
    entries = [(rng.choice(["hot", "hot", "a", "b", "c", "unasked", None]), rng.choice([None, rng.randrange(5, 100)]), rng.randrange(1000)) for _ in range(150)]
    left = spark.createDataFrame(rows, "id long, k string, t int")
    right = spark.createDataFrame(entries, "k string, t int, found long")
    got = asof.as_of_join(left, right, ["k"], F.col("t"), F.col("t"), ["found"], partitions_)
    assert got.columns == ["id", "k", "t", "found"]
    assert Counter(tuple(r) for r in got.collect()) == looked_up(rows, entries)
    assert asof.as_of_join(left, right.limit(0), ["k"], F.col("t"), F.col("t"), ["found"]).where("found is not null").count() == 0
    assert asof.as_of_join(left.limit(0), right, ["k"], F.col("t"), F.col("t"), ["found"]).count() == 0


def test_a_hot_key_spans_partitions(spark, monkeypatch):
    """Rows of one key, even of one moment, are not one group."""
    left = spark.range(5000).select("id", F.lit("hot").alias("k"), F.lit(5).alias("t"))
    right = spark.createDataFrame([("hot", 4, "x"), ("hot", 6, "y")], "k string, t int, v string")
    placed = []
    monkeypatch.setattr(asof, "stable", lambda df: placed.append(df) or df)
    got = asof.as_of_join(left, right, ["k"], F.col("t"), F.col("t"), ["v"], 10)
    assert got.where("v = 'x'").count() == 5000
    sizes = [r["count"] for r in placed[0].groupBy("part").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 1500


def days_of(rows):
    out = defaultdict(Counter)
    for k, first, last in rows:
        if first is not None and last is not None:
            for n in range((last - first).days + 1):
                out[k][first + datetime.timedelta(days=n)] += 1
    return out


def as_spans(days):
    out, run = [], None
    for d in sorted(days):
        if run and run[1] + datetime.timedelta(days=1) == d:
            run[1] = d
        else:
            run = [d, d]
            out.append(run)
    return [tuple(r) for r in out]


def test_spans_equal_days(spark):
    rng = random.Random(3)

    def make(n):
        rows = []
        for _ in range(n):
            start = rng.randrange(300)
            rows.append((rng.choice("abcd"), day(start), day(start + rng.choice([0, 0, 1, 6, 30, -2]))))
        return rows + [("null", None, day(1)), ("x", day(5), day(5))]

    one, two = make(60), make(40)
    schema = "k string, first_day date, last_day date"
    a, b = spark.createDataFrame(one, schema), spark.createDataFrame(two, schema)
    da, db = days_of(one), days_of(two)
    listed = lambda df: sorted((r.k, r.first_day, r.last_day) for r in df.collect())
    want = lambda days: sorted((k, *s) for k, d in days.items() for s in as_spans(d))
    assert listed(spans.covered(a, ["k"])) == want(da)
    assert listed(spans.covered(a, ["k"], 2)) == want({k: [d for d, n in c.items() if n > 1] for k, c in da.items()})
    between = {k: [min(c) + datetime.timedelta(days=n) for n in range((max(c) - min(c)).days)] for k, c in da.items() if c}
    assert listed(spans.gaps(a, ["k"])) == want({k: set(d) - set(da[k]) for k, d in between.items()})
    assert listed(spans.common(a, b, ["k"])) == want({k: set(c) & set(db[k]) for k, c in da.items()})
    assert listed(spans.without(a, b, ["k"])) == want({k: set(c) - set(db[k]) for k, c in da.items()})
    asked = spark.createDataFrame([(k, day(n)) for k in ("a", "b", "x", "none", None) for n in range(0, 340, 3)] + [("a", None)], "k string, d date")
    got = {(r.k, r.d): r.seen for r in spans.inside(asked, F.col("d"), a, ["k"], "seen").collect()}
    assert got == {(r.k, r.d): r.d in da.get(r.k, ()) for r in asked.collect()}
    assert spans.covered(a.limit(0), ["k"]).count() == 0


def test_values_as_spans(spark):
    items = spark.createDataFrame(
        [("e", "2020-01-05__2020-01-02"), ("e", "2020-01-02__2020-01-05"), ("e", "2020-02-01,2020-02-03,x"), ("e", "2020-03-01"), ("e", "none"),
         ("e", "2020-04-01__odd"), ("e", None), ("e", "2020-05-01:7")], "execution_id string, partition_values string")
    found = sorted((str(r.first_day), str(r.last_day)) for r in spans.value_spans(items, ["execution_id"]).collect())
    assert found == [("2020-01-02", "2020-01-02"), ("2020-01-02", "2020-01-05"), ("2020-02-01", "2020-02-01"), ("2020-02-03", "2020-02-03"),
                     ("2020-03-01", "2020-03-01"), ("2020-04-01", "2020-04-01")]
    assert sorted(str(r.partition_value) for r in spans.other_values(items, ["execution_id"]).collect()) == ["2020-05-01:7", "None", "none", "x"]
    # The same days as values spelled out.
    spelled = partitions.submitted_values(items, strict=True).where(F.col("partition_value").try_cast("date").isNotNull())
    days = days_of([("e", r.first_day, r.last_day) for r in spans.value_spans(items, ["execution_id"]).collect()])["e"]
    assert sorted(r.partition_value for r in spelled.collect()) == sorted(str(d) for d in days)
