"""The paths for hot keys give the same rows as the plain ones, and as brute force."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from transitus.functions import skew

DAY0 = date(2020, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(400):
        key = 1 if rng.random() < 0.4 else rng.randint(2, 30)
        out.append((key, DAY0 + timedelta(days=rng.randint(0, 60)), i, rng.randint(1, 9)))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "k int, at date, id int, v int")


@pytest.mark.parametrize("min_rows", [2, 20, 10**6])
def test_neighbours(table, rows, min_rows):
    got = {
        r.id: (r._prev.id if r._prev else None, r._next.id if r._next else None)
        for r in skew.neighbours(table, ["k"], ["at", "id"], F.trunc("at", "week"), ["id"], min_rows).collect()
    }
    want = {}
    for k in {r[0] for r in rows}:
        ids = [r[2] for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))]
        for i, one in enumerate(ids):
            want[one] = (ids[i - 1] if i else None, ids[i + 1] if i + 1 < len(ids) else None)
    assert got == want


@pytest.mark.parametrize("min_rows", [2, 20, 10**6, None])
def test_running_sums(table, rows, min_rows):
    out = skew.running_sums(table, ["k"], ["at", "id"], F.trunc("at", "week"), {"s": F.col("v"), "n": F.lit(1)}, min_rows)
    want = {}
    for k in {r[0] for r in rows}:
        total = count = 0
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            want[r[2]] = (total, count)
            total, count = total + r[3], count + 1
    assert {r.id: (r.s, r.n) for r in out.collect()} == want


@pytest.mark.parametrize("min_rows", [1, 8, 10**6])
@pytest.mark.parametrize("tie", ["id", "name"])
def test_dense_ids(table, rows, min_rows, tie):
    named = table.withColumn("name", F.format_string("n%05d", "id"))
    got = {r.id: r.no for r in skew.dense_ids(named, "at", tie, "no", min_rows).collect()}
    assert got == {r[2]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])))}


@pytest.fixture(scope="module")
def intervals(spark):
    rng = random.Random(5)

    def some(n, open_share, inverted):
        out = []
        for i in range(n):
            a = DAY0 + timedelta(days=rng.randint(0, 400))
            b = None if rng.random() < open_share else a + timedelta(days=rng.randint(-5 if inverted else 0, 120))
            out.append((1 if rng.random() < 0.4 else rng.randint(2, 8), i, a, b))
        return out

    stays, facts = some(80, 0.1, False), some(150, 0.2, True)
    return (
        stays, facts,
        spark.createDataFrame(stays, "k int, sid int, lo date, hi date"),
        spark.createDataFrame(facts, "k int, fid int, a date, b date"),
    )


def overlaps(stays, facts):
    return {
        (s[1], f[1]) for s in stays for f in facts
        if s[0] == f[0] and s[3] is not None and f[2] <= s[3] and (f[3] is None or f[3] >= s[2])
    }


@pytest.mark.parametrize("min_rows", [1, 20, 10**6])
def test_interval_join(intervals, min_rows):
    stays, facts, s, f = intervals
    found = [(r.sid, r.fid) for r in skew.interval_join(s, f, "k", "lo", "hi", "a", "b", min_rows).collect()]
    assert len(found) == len(set(found))
    assert set(found) == overlaps(stays, facts)


@pytest.mark.parametrize("min_rows", [1, 20, 10**6])
def test_overlap_counts(intervals, min_rows):
    stays, facts, s, f = intervals
    out = skew.overlap_counts(s, {"n": f, "late": f.filter("fid >= 75")}, "k", "sid", "lo", "hi", "a", "b", min_rows)
    pairs = overlaps(stays, facts)
    want = {}
    for sid in {p[0] for p in pairs}:
        hits = [p[1] for p in pairs if p[0] == sid]
        want[sid] = (len(hits), sum(h >= 75 for h in hits))
    assert {r.sid: (r.n, r.late) for r in out.collect() if r.n} == want


def test_exact_quantiles(table, rows):
    out = skew.exact_quantiles(table, ["k"], "v", {"q": 0.5, "low": 0.1}, 3)
    for r in out.collect():
        values = sorted(v for k, _, _, v in rows if k == r.k)
        assert r.q == values[-(-len(values) // 2) - 1]
        assert r.low == values[max(-(-len(values) // 10), 1) - 1]


def test_salted_join(spark, table):
    names = spark.createDataFrame([(k, f"k{k}") for k in range(1, 25)], "k int, name string")
    plain = sorted(map(tuple, table.join(names, "k").collect()))
    salted = skew.salted_join(table, names, "k", skew.hot_keys(table, ["k"], 30), ["id"], 4)
    assert sorted(map(tuple, salted.select("k", "at", "id", "v", "name").collect())) == plain


def test_one_instant_holds_all_rows(spark):
    """Ids of any type that share a long prefix, all on one day at one instant, are dealt over partitions."""
    rows = spark.range(20_000).select(
        F.lit(DAY0).alias("at"), F.format_string("encounter-%08d", F.col("id")).alias("name"), "id"
    )
    joined_up = "spark.sql.adaptive.coalescePartitions.enabled"  # else 20,000 rows make one partition
    spark.conf.set(joined_up, "false")
    try:
        placed = skew.in_order(rows, ["at", "name"])
    finally:
        spark.conf.unset(joined_up)
    sizes = [r["count"] for r in placed.groupBy("_part").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 15_000
    out = skew.dense_ids(rows, "at", "name", "no")
    assert out.filter("no != id + 1").isEmpty() and out.count() == 20_000


def test_dense_ids_of_nothing(spark):
    none = spark.createDataFrame([(None, 1)], "at date, id int")
    assert skew.dense_ids(none, "at", "id", "no").collect() == []


def test_hot_day_is_cut(spark):
    """A day with more rows than a block may hold is cut into runs; sums and neighbours cross the cuts."""
    rows = spark.range(3_000).select(
        F.lit(1).alias("k"), F.when(F.col("id") < 2_900, F.lit(DAY0)).otherwise(F.lit(DAY0 + timedelta(days=1))).alias("at"), "id"
    )
    blocks = skew.with_blocks(rows, ["k"], F.col("at"), ["at", "id"], 500).groupBy("_block").count().collect()
    assert len(blocks) >= 7 and max(r["count"] for r in blocks) <= 500
    out = skew.running_sums(rows, ["k"], ["at", "id"], F.col("at"), {"n": F.lit(1)}, 500)
    assert out.filter("n != id").isEmpty()
    near = skew.neighbours(rows, ["k"], ["at", "id"], F.col("at"), ["id"], 500)
    assert near.filter("coalesce(_prev.id, -1) != id - 1 OR coalesce(_next.id, 3000) != id + 1").isEmpty()


def test_list_of_hot_keys_beyond_the_broadcast(table, monkeypatch):
    plain = sorted(map(str, skew.running_sums(table, ["k"], ["at", "id"], F.trunc("at", "week"), {"n": F.lit(1)}, 10**6).collect()))
    monkeypatch.setattr(skew, "MAX_HOT_KEYS", 2)
    split = skew.running_sums(table, ["k"], ["at", "id"], F.trunc("at", "week"), {"n": F.lit(1)}, 5)
    assert sorted(map(str, split.collect())) == plain
