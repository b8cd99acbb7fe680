"""Positions, merges and bounds against sorted lists."""

import random
from bisect import bisect_left

from lotwise.operators import shards

S = "key long, value long, weight long"


def rows(n, seed=0):
    rng = random.Random(seed)
    return [(rng.randrange(-50, 400), rng.randrange(5), 1) for _ in range(n)]


def test_positions_are_a_total_order(spark):
    data = rows(1500)
    got = shards.positions(spark.createDataFrame(data, S), "key", "value").collect()
    assert [(r.key, r.value) for r in sorted(got, key=lambda r: r.pos)] == sorted((k, v) for k, v, _ in data)
    assert sorted(r.pos for r in got) == list(range(1500))
    assert shards.positions(spark.createDataFrame([], S), "key", "value").count() == 0


def test_three_way_merge_keeps_all_rows(spark):
    parts = [rows(512, s) for s in range(3)]
    merged = shards.merge(*(spark.createDataFrame(p, S) for p in parts))
    got = sorted(shards.positions(merged, "key", "value").collect(), key=lambda r: r.pos)
    assert len(got) == 1536 and [(r.key, r.value) for r in got] == sorted((k, v) for p in parts for k, v, _ in p)


def test_lower_bound(spark):
    data = [(i, i + j, 1) for i in range(500) for j in (0, 1)]
    run = shards.sorted_run(spark.createDataFrame(data, S), 4)
    asked = [(s, x) for s in range(4) for x in (-5, 0, 7, 250, 499, 500)]
    got = {(r.shard, r.x): r.pos for r in shards.lower_bound(run, spark.createDataFrame(asked, "shard int, x long")).collect()}
    for s, x in asked:
        keys = sorted(k for k, _, _ in data if k % 4 == s)
        at = bisect_left(keys, x)
        assert got[s, x] == (at if at < len(keys) else None)


def test_lower_bound_takes_one_step_a_row(spark):
    """A frame that ends at the last row would be gone through anew for each row."""
    run = shards.sorted_run(spark.createDataFrame([(i, 0, 1) for i in range(9)], S), 1)
    found = shards.lower_bound(run, spark.createDataFrame([(0, 4)], "shard int, x long"))
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(0, 4, 4)]


def test_record_at(spark):
    run = shards.sorted_run(spark.createDataFrame([(8, 1, 1), (0, 2, 1), (16, 0, 1)], S), 8)
    got = shards.record_at(run, spark.createDataFrame([(0, 1), (0, 9)], "shard int, pos long")).collect()
    assert [(r.key, r.pos) for r in got] == [(8, 1)]
