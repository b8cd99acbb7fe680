"""Samples: exact look-ups, shares within tolerance, and alias tables."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lotwise.operators import sample as s
from lotwise.operators import weights
from lotwise.functions.records import coerce_weight, coordinate_key
from lotwise.plans.catalog import Q
from pyspark.sql import functions as F

S = "key long, value long, weight long"


@pytest.fixture(scope="module")
def classes(spark):
    """Keys 1, 2, 3 in shares 1/2, 1/4, 1/4 with weights 2, 4, 8: draws go 1/4, 1/4, 1/2."""
    rows = [((1, 2, 3)[0 if i % 2 else 1 + i // 2 % 2], i, (2, 4, 8)[0 if i % 2 else 1 + i // 2 % 2]) for i in range(4000)]
    return spark.createDataFrame(rows, S).cache()


@pytest.mark.parametrize("draw", [s.sample, s.sample_arrow, s.two_stage, s.sample_alias])
def test_shares_of_weighted_classes(classes, draw):
    k = 6000
    n = {r.key: r["count"] for r in draw(classes, k, seed=3).groupBy("key").count().collect()}
    want = {1: k / 4, 2: k / 4, 3: k / 2}
    chi = sum((n[x] - want[x]) ** 2 / want[x] for x in want)
    limit = 2 * (1 - 2 / 18 + 3.7 * math.sqrt(2 / 18)) ** 3  # Wilson-Hilferty, about 1 in 10,000
    assert sum(n.values()) == k and chi < limit


def test_look_up_is_the_interval_that_holds_the_draw(spark):
    rows = [(k, v, (k * 7 + v) % 5) for k in range(40) for v in range(3)]
    df = spark.createDataFrame(rows, S)
    line, total = s.offsets(df, 4)
    assert total == sum(w for _, _, w in rows)
    ordered = [r for r in sorted(rows, key=lambda r: (r[0] % 4, r)) if r[2]]
    ends = np.cumsum([w for _, _, w in ordered])
    draws = spark.range(total).select(F.col("id").alias("draw"), F.col("id").alias("r"))
    got = s.look_up(df.withColumn("shard", F.expr("cast(key % 4 as int)")), s.dealt(draws, line), ["shard"]).collect()
    assert len(got) == total
    for r in got:
        assert (r.key, r.value, r.weight) == ordered[int(np.searchsorted(ends, r.draw, side="right"))]


def test_both_engines_draw_alike(classes):
    a, b = (sorted(map(tuple, f(classes, 500, 5).collect())) for f in (s.sample, s.sample_arrow))
    assert [x[0] for x in a] == list(range(500)) and a == b


def test_rejecting_retrying_and_groups(spark, classes):
    buffer = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 1, 8), (4, 1, 0)], S)
    n = {r.key: r["count"] for r in s.sample_rejecting(buffer, 3000, attempts=200).groupBy("key").count().collect()}
    assert sum(n.values()) == 3000 and abs(n[3] / 3000 - 0.8) < 0.05 and 4 not in n
    kept = s.sample_retrying(classes, F.col("key") == 3, 2000, 20).groupBy("key").count().collect()
    assert {r.key for r in kept} == {1, 2} and sum(r["count"] for r in kept) == 2000
    assert all(abs(r["count"] / 2000 - 0.5) < 0.05 for r in kept)
    per = s.sample_by_group(classes.withColumn("g", F.col("key") % 2), "g", 300).groupBy("g").count().collect()
    assert sorted(map(tuple, per)) == [(0, 300), (1, 300)]
    without = s.sample_without(classes, 3000).collect()
    assert len({(r.key, r.value) for r in without}) == 3000


def test_no_weight_no_rows(spark):
    none = spark.createDataFrame([(1, 1, 0)], S)
    assert s.sample(none, 10).count() == 0 == s.sample_arrow(none, 10).count() == s.sample_rejecting(none, 10).count()
    assert s.sample(none.limit(0), 10).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=50).filter(any))
def test_alias_table_keeps_all_mass(w):
    w = np.array(w)
    prob, alias = weights.vose(w)
    mass = prob.copy()
    np.add.at(mass, alias, 1 - prob)
    assert np.allclose(mass / len(w), w / w.sum(), atol=1e-9) and (prob <= 1 + 1e-9).all()


def test_alias_mass_gives_back_the_weights(classes):
    got = weights.alias_mass(weights.alias_tables(classes, 4)).select("key", "value", "weight")
    assert got.exceptAll(classes).count() == 0 and got.count() == classes.count()


def test_weights_and_coordinates(spark):
    df = spark.createDataFrame([(0.5,), (1.006,)], "w double")
    assert [r[0] for r in df.select(coerce_weight(F.col("w"), 100)).collect()] == [50, 101]
    for bad in (-1.0, float("nan"), None):
        with pytest.raises(Exception, match="weights must be"):
            spark.createDataFrame([(bad,)], "w double").select(coerce_weight(F.col("w"))).collect()
    assert spark.range(1).select(coordinate_key(F.lit(-179.5))).first()[0] == 5_000_000


def test_every_draw_comes_whatever_the_weights(spark):
    rows = [(0, 0, 100_000)] + [(i, 0, 1) for i in range(1, 1000)]
    got = s.sample_rejecting(spark.createDataFrame(rows, S), 500, attempts=4).collect()
    assert sorted(r.draw for r in got) == list(range(500)) and sum(r.key == 0 for r in got) > 480
    mostly_dead = spark.createDataFrame([(3, 0, 10**9), (1, 1, 1), (2, 2, 3)], S)
    kept = s.sample_retrying(mostly_dead, F.col("key") == 3, 400, 2).collect()
    assert sorted(r.draw for r in kept) == list(range(400)) and {r["pass"] for r in kept} == {2}
    assert abs(sum(r.key == 2 for r in kept) / 400 - 0.75) < 0.08
    assert s.sample_retrying(mostly_dead, F.lit(True), 10, 2).count() == 0


def test_cells_of_the_line(spark):
    line = [(0, 0, 1), (3, 1, 100), (4, 100, 101), (7, 101, 103)]
    got = s.dealt(spark.range(103).selectExpr("id as draw", "id as r"), line).collect()
    assert sorted((r.draw, r.shard, r["at"]) for r in got) == [(r, *next((n, r - a) for n, a, b in line if a <= r < b)) for r in range(103)]


def test_empty_tables_and_tables_without_weight(spark):
    none = spark.createDataFrame([], "key long, value long, weight long")
    light = spark.createDataFrame([(1, 1, 0), (2, 2, 0)], "key long, value long, weight long")
    for df in (none, light):
        for f in (s.sample, s.sample_arrow, s.source_counts, s.two_stage, s.sample_alias):
            assert f(df, 20).count() == 0, f.__name__
        assert s.sample_rejecting(df, 20).count() == 0
        assert s.sample_retrying(df, F.lit(False), 20, 2).count() == 0


def test_a_line_of_huge_weights_loses_no_draw(spark):
    df = spark.createDataFrame([(i, i, 10**16 + i) for i in range(60)], "key long, value long, weight long")
    assert s.sample(df, 500, shards=7).count() == 500 == s.sample_arrow(df, 500, shards=7).count()


def test_alias_tables_are_exact_beyond_64_bits(spark):
    """Masses reach the total times the number of slots, which no 64-bit number and no double holds."""
    def check(w):
        cut, alias = weights.cuts(np.array(w))
        mass, total = [int(c) for c in cut], sum(w)
        for i, c in enumerate(cut.tolist()):
            assert 0 <= c <= total
            mass[alias[i]] += total - c
        assert mass == [x * len(w) for x in w]

    rng = np.random.default_rng(5)
    for most in (2, 100, 10**9, 10**15):
        check(rng.integers(0, most, 2000).tolist())
    check([10**18, *[1] * 999])
    check([7] * 50)
    check([1, 2**62])
    rows = [(i, i, int(x)) for i, x in enumerate(rng.integers(10**12, 10**15, 4000))]
    df = spark.createDataFrame(rows, S)
    got = weights.alias_mass(weights.alias_tables(df, 2)).select("key", "value", "weight")
    assert sorted(map(tuple, got.collect())) == rows


def test_normalized_weights_are_cut_not_rounded(spark, tmp_path):
    """A share just below a whole number of parts stays below it."""
    total = 10_000_019
    near = total - pow(10**12, -1, total)  # near * 10^12 is one less than a multiple of the total
    spark.createDataFrame([(1, 1, near / 100, "1-URGENT"), (2, 1, (total - near) / 100, "1-URGENT")], "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.key: r.parts for r in Q["normalized_weights"](spark, str(tmp_path)).collect()}
    assert got == {1: near * 10**12 // total, 2: (total - near) * 10**12 // total}


@pytest.mark.parametrize("per_range", [7, 60, 10**6])
def test_alias_tables_of_many_ranges_are_those_of_whole_shards(spark, per_range):
    """No task holds a shard: the tables come from ranges of a few rows as from arrays of all."""
    rng = np.random.default_rng(3)
    rows = [(4 * i, i, int(10 ** rng.uniform(0, 17))) for i in range(150)] + [(4 * i + 1, 0, 5) for i in range(20)]
    rows += [(4 * i + 2, 0, 1 if i < 90 else 10**6) for i in range(91)] + [(3, 0, 9), (7, 0, 0)]
    got = {}
    for r in weights.alias_tables(spark.createDataFrame(rows, S), 4, per_range).collect():
        got.setdefault(r.shard, []).append(r)
    assert sorted(got) == [0, 1, 2, 3]
    for shard, table in got.items():
        table.sort(key=lambda r: r.slot)
        want = sorted(r for r in rows if r[0] % 4 == shard and r[2])
        assert [(r.slot, r.key, r.value, r.weight) for r in table] == [(i, *w) for i, w in enumerate(want)]
        cut, alias = weights.cuts(np.array([w[2] for w in want]))
        assert [r.cut for r in table] == cut.tolist()
        if shard != 1:  # equal weights give nothing to an alias
            assert [r.alias for r in table] == alias.tolist()


def test_sample_alias_groups_no_shard_in_python(spark, classes):
    plan = s.sample_alias(classes, 50)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "FlatMapGroupsInArrow" not in plan
