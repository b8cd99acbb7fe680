"""Layout rules, the stored index's life, and streams."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_resolve import log, model

from lotwise.functions.records import OP
from lotwise.operators import bloom, metrics
from lotwise.plans import store
from lotwise.plans.layout import Config, Levels, Shard, closed_form, digits, flushes, level_capacity
from lotwise.plans.store import Index
from lotwise.sources import tsv, workload
from lotwise.streaming.ingest import ingest, ingest_lines, interleave


@pytest.mark.parametrize("policy", ["tiering", "leveling"])
@pytest.mark.parametrize("scale", [2, 3, 6])
def test_state_machine_follows_the_closed_form(policy, scale):
    config = Config(10, scale, layout=policy)
    levels = Levels(config)
    for f in range(1, 150):
        levels.add(Shard("", 10), lambda parts, bottom: Shard("", sum(x.rows for x in parts)))
        want = [(r["level"], r["shards"], r["rows"]) for r in closed_form(10 * f + 1, config)]
        assert [(i, len(lv), sum(x.rows for x in lv)) for i, lv in enumerate(levels.levels)] == want


def test_heights_of_small_indexes():
    assert [len(digits(flushes(n, 100), 2)) for n in (0, 100, 101, 300, 301)] == [0, 0, 1, 1, 2]
    assert level_capacity(Config(100, 2), 1) == 400
    with pytest.raises(ValueError):
        Config(layout="other")


def test_tombstones_keep_within_their_proportion():
    rng = random.Random(4)
    config = Config(100, 2, max_tombstone_prop=0.05)
    levels = Levels(config)

    def merge(parts, bottom):
        rows, t = sum(x.rows for x in parts), sum(x.tombstones for x in parts)
        return Shard("", rows - 2 * t if bottom else rows, 0 if bottom else t)

    for _ in range(60):
        levels.add(Shard("", 100, rng.randrange(30)), merge)
        assert all(p <= 0.05 for p in levels.tombstone_props())


@pytest.mark.parametrize("policy", ["tiering", "leveling"])
def test_index_lives_like_the_log(spark, tmp_path, policy):
    rows = log(1200, 7, 0.3)
    index = Index(spark, f"file://{tmp_path}/index", Config(100, 2, layout=policy))
    df = spark.createDataFrame(rows, OP)
    for i in range(4):
        index.append(df.where(f"seq >= {300 * i} and seq < {300 * (i + 1)}"), i)
    index.append(df.where("seq < 300"), 0)  # a replay does nothing
    alive, _ = model(rows)
    assert {r.seq for r in index.live().collect()} == alive
    m = index.metrics()
    assert m["height"] >= 2 and 0 < m["buffered"] <= 100 and m["bytes"] > 0
    again = Index(spark, f"file://{tmp_path}/index")  # from the manifest
    assert again.config == index.config and {r.seq for r in again.live().collect()} == alive
    drawn = again.sample(200, low=1, high=3).collect()
    assert len(drawn) == 200 and all(1 <= r.key <= 3 for r in drawn)
    assert again.compact_all().count() == len(alive)
    told = again.delete(spark.createDataFrame([(5000, *next((r[1], r[2]) for r in rows if r[0] in alive)), (5001, 99, 99)], "seq long, key long, value long")).collect()
    assert {r.seq: r.found for r in told} == {5000: 1, 5001: 0} and again.live().count() == len(alive) - 1
    again.destroy()
    assert Index(spark, f"file://{tmp_path}/index").live().count() == 0


def test_stream_is_ingested_once(spark, tmp_path):
    rows = log(400, 9)
    spark.createDataFrame(rows, OP).where("seq < 200").coalesce(1).write.parquet(f"{tmp_path}/in")
    index = Index(spark, f"file://{tmp_path}/index", Config(150, 2))
    ingest(tsv.table_stream(spark, f"{tmp_path}/in", OP), index, f"{tmp_path}/offsets").awaitTermination()
    spark.createDataFrame(rows, OP).where("seq >= 200").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for _ in range(2):
        ingest(tsv.table_stream(spark, f"{tmp_path}/in", OP), index, f"{tmp_path}/offsets").awaitTermination()
    assert {r.seq for r in index.live().collect()} == model(rows)[0]


def test_tsv_and_workloads(spark, tmp_path):
    df = spark.createDataFrame([(i, i * 2, i + 1) for i in range(100)], "key long, value long, weight long")
    tsv.write_records(df, f"{tmp_path}/tsv")
    back = tsv.read_records(spark, f"{tmp_path}/tsv")
    assert back.exceptAll(df).count() == 0 and tuple(tsv.key_bounds(back).first()) == (100, 0, 99)
    assert tsv.read_records(spark, f"{tmp_path}/tsv", limit=7).count() == 7
    mixed = workload.mixed_log(df.withColumnRenamed("key", "seq").selectExpr("seq", "seq as key", "value", "weight"), 300)
    rows = [tuple(r) for r in mixed.select("seq", "key", "value", "weight", "op").collect()]
    gone = [r for r in rows if r[4] == "T"]
    assert 10 < len(gone) < 60 and len(model(rows)[0]) == 100 - len(gone)
    r = workload.key_range(tsv.key_bounds(df), 100).first()
    assert r.high - r.low == 9 and 0 <= r.low and r.high <= 99


def test_bloom_and_metrics(spark):
    keys = spark.range(1000).selectExpr("id * 3 as key", "id as value")
    bits = bloom.build(keys, 1000)
    told = bloom.may_hold(spark.range(6000).selectExpr("id as key"), bits).selectExpr("key % 3 = 0 and key < 3000 as there", "may").groupBy("there").agg({"may": "count"}).count()
    assert told == 2
    hits = {(r.there, r.may): r["count"] for r in bloom.may_hold(spark.range(6000).selectExpr("id as key"), bits).selectExpr("key % 3 = 0 and key < 3000 as there", "may").groupBy("there", "may").count().collect()}
    assert (True, False) not in hits and hits.get((False, True), 0) < 0.03 * 5000
    checks = spark.createDataFrame([(0, True)] * 20 + [(0, False)] * 60 + [(1, True)] * 3, "level int, rejected boolean")
    assert sorted(map(tuple, metrics.rejections(checks, 10).collect())) == [(0, 80, 20, 250_000), (1, 3, 3, 0)]


def test_observation_and_filter_size(spark):
    df, seen = metrics.observed(spark.createDataFrame(log(100, 1), OP))
    assert df.count() == 100 == seen.get["ops"] == seen.get["inserts"] + seen.get["deletes"]
    assert metrics.aux_bytes(0) == 0 and metrics.aux_bytes(1000) == bloom.size_bits(1000) // 8 == 1199


def test_filter_in_parts_and_null_keys(spark):
    keys = spark.createDataFrame([(i * 3,) for i in range(2000)] + [(None,)], "key long")
    table = bloom.build(keys, 2000, most=4096)
    assert table.count() > 3
    asked = spark.createDataFrame([(i,) for i in range(6000)] + [(None,)] + [(3,)] * 50, "key long")
    told = [(r.key, r.may) for r in bloom.may_hold(asked, table).collect()]
    assert len(told) == 6051 and all(may for k, may in told if k is not None and k % 3 == 0) and (None, False) in told
    assert sum(may for k, may in told if k is not None and k % 3) < 0.03 * 4000
    assert {r.may for r in bloom.may_hold(asked, bloom.build(keys.where("false"), 0)).collect()} == {False}


@pytest.mark.parametrize("policy", ["tiering", "leveling"])
def test_bulk_load_is_what_appends_make(spark, tmp_path, policy):
    rows = [(i, i * 7 % 50, i, i % 9, "I") for i in range(730)]
    df = spark.createDataFrame(rows, OP)
    config = Config(100, 2, layout=policy)
    a, b = Index(spark, f"file://{tmp_path}/a", config), Index(spark, f"file://{tmp_path}/b", config)
    a.append(df)
    b.bulk_load(df, 1)
    shape = lambda x: [[s.rows for s in lv] for lv in x.state.levels]
    assert shape(a) == shape(b) and a.metrics()["buffered"] == b.metrics()["buffered"] == 30
    assert {r.seq for r in a.live().collect()} == {r.seq for r in b.live().collect()} == set(range(730))
    with pytest.raises(ValueError):
        b.bulk_load(df)
    mixed = log(900, 3, 0.3)
    c = Index(spark, f"file://{tmp_path}/c", config)
    c.bulk_load(spark.createDataFrame(mixed, OP))
    assert {r.seq for r in c.live().collect()} == model(mixed)[0]


def test_stored_sample_is_exact_and_rejects(spark, tmp_path):
    rows = [(i, i % 40, i, 1 + (i % 40), "I") for i in range(800)]
    rows += [(800 + i, i, j * 40 + i, 0, "T") for i, j in zip([3, 7, 39, 39], [2, 5, 0, 19])] + [(1000 + j, 38, 38 + 40 * j, 0, "T") for j in range(20)]
    index = Index(spark, f"file://{tmp_path}/index", Config(150, 2))
    index.append(spark.createDataFrame(rows, OP))
    live = {(r.key, r.value): r.weight for r in index.live().collect()}
    assert len(live) == 800 - 24
    drawn = [(r.draw, r.key, r.value, r.weight) for r in index.sample(6000, seed=5).collect()]
    assert sorted(d for d, *_ in drawn) == list(range(6000)) and all(live[k, v] == w for _, k, v, w in drawn)
    total = sum(live.values())
    for key in (5, 20, 39):
        want = 6000 * sum(w for (k, _), w in live.items() if k == key) / total
        assert abs(sum(k == key for _, k, *_ in drawn) - want) < 5 * want**0.5
    assert sorted(map(tuple, index.sample(50, seed=5, passes=1).collect())) == sorted(map(tuple, index.sample(50, seed=5, passes=1).collect()))
    none = Index(spark, f"file://{tmp_path}/none", Config(150, 2))
    assert none.sample(10).count() == 0
    none.append(spark.createDataFrame([(1, 1, 1, 5, "I"), (2, 1, 1, 0, "T")], OP))
    assert none.sample(10).count() == 0


def test_rejections_compact_and_readers_go_on(spark, tmp_path):
    rows = [(i, i % 50, i, 5, "I") for i in range(600)] + [(1000 + i, i % 50, i, 0, "T") for i in range(0, 600, 2)]
    index = Index(spark, f"file://{tmp_path}/index", Config(100, 3, max_rejection_rate=0.05, rejection_floor=10, retain=3, orphan_seconds=0))
    index.append(spark.createDataFrame(rows, OP))
    before, open_ = index.metrics()["shards"], index.live()
    index.sample(400, seed=2).count()
    assert index.metrics()["shards"] != before and sum(index.metrics()["checks"]) >= 0
    for i in range(2):
        index.append(spark.createDataFrame([(2000 + i, 1, 1, 1, "I")], OP))
    assert open_.count() == 300  # from the version it was opened at
    for i in range(4):
        index.append(spark.createDataFrame([(3000 + i, 1, 1, 1, "I")], OP))
    assert len(index._versions()) <= 4 and index.live().count() == 306


def test_deletes_are_told_apart_and_replayed(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/index", Config(100, 2, deletes="tag"))
    index.append(spark.createDataFrame([(1, 5, 5, 2, "I"), (2, 6, 1, 2, "I"), (3, 6, 9, 2, "I")], OP))
    asked = spark.createDataFrame([(10, 5, 5), (11, 5, 5)], "seq long, key long, value long")
    for _ in range(2):  # the second is a replay
        assert {r.seq: r.found for r in index.delete(asked, 7).collect()} == {10: 1, 11: 0}
        assert index.live().count() == 2
    told = {r.seq: (r.value, r.found) for r in index.erase(spark.createDataFrame([(20, 6), (21, 6), (22, 6)], "seq long, key long")).collect()}
    assert told == {20: (1, 1), 21: (9, 1), 22: (None, 0)} and index.live().count() == 0
    m = index.metrics()
    assert m["seconds"]["sample"] == 0 and m["aux_bytes"] == 0 and m["deletes_over_cap"] == 0


def test_deletes_of_sampled_records(spark):
    df = spark.range(500).selectExpr("id as seq", "id as key", "id as value", "id as weight")
    rows = [tuple(r) for r in workload.sampled_log(df, 60).select("seq", "key", "value", "weight", "op").collect()]
    gone = [r for r in rows if r[4] == "T"]
    assert len(gone) == 60 == len({r[1] for r in gone}) and len(model(rows)[0]) == 440
    assert sum(r[1] for r in gone) / 60 > 270  # by weight


def test_filters_change_no_draw(spark, tmp_path):
    rows = [(i, i % 90, i, 1 + i % 7, "I") for i in range(600)] + [(600 + i, i % 90, i, 0, "T") for i in range(0, 90, 9)]
    drawn = []
    for filters in (False, True):
        index = Index(spark, f"file://{tmp_path}/{filters}", Config(150, 2, filters=filters))
        index.append(spark.createDataFrame(rows, OP).repartition(1))
        drawn.append(sorted(map(tuple, index.sample(300, seed=3).collect())))
        assert (index.metrics()["aux_bytes"] > 0) == filters
        assert not index._may_delete(np.array([1001, 1003])) or not filters
        assert index._may_delete(np.array([9]))
    assert drawn[0] == drawn[1] and len(drawn[0]) == 300


def test_draws_do_not_depend_on_files_or_tasks(spark, tmp_path):
    """The same ops in other partitions, by other numbers of shuffle partitions and with other file sizes give the same draws."""
    rows = log(1500, 21, 0.25)
    before, drawn = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for i, (tasks, size, parts) in enumerate([(4, 1_000_000, 2), (7, 90, 5), (1, 33, 1)]):
            spark.conf.set("spark.sql.shuffle.partitions", tasks)
            index = Index(spark, f"file://{tmp_path}/{i}", Config(200, 2, file_rows=size))
            df = spark.createDataFrame(rows, OP).repartition(parts)
            for n in range(3):
                index.append(df.where(f"seq >= {500 * n} and seq < {500 * (n + 1)}"), n)
            assert len({f.part for lv in index.state.levels for s in lv for f in s.files}) > 1 or size > 200
            drawn.append([sorted(map(tuple, index.sample(300, seed=3).collect())), sorted(map(tuple, index.sample(200, seed=4, low=1, high=2).collect()))])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert drawn[0] == drawn[1] == drawn[2]
    assert [len(x) for x in drawn[0]] == [300, 200] and all(1 <= k <= 2 for _, k, *_ in drawn[0][1])


def test_files_are_sorted_and_a_sample_reads_few(spark, tmp_path):
    """What a sample reads doesn't grow with the index, and a range looks into two files of a shard at most."""
    read = []
    for n in (4000, 32_000):
        index = Index(spark, f"file://{tmp_path}/{n}", Config(n // 2 - 1, 2, file_rows=250))
        index.bulk_load(spark.range(n).selectExpr("id as seq", "id * 7 % 1009 as key", "id as value", "1 + id % 5 as weight", "if(id % 40 = 39, 'T', 'I') as op").withColumn("weight", F.expr("if(op = 'I', weight, 0)")))
        files = [f for lv in index.state.levels for s in lv for f in s.files]
        assert len(files) >= n // 400 and sum(f.rows for f in files) + sum(b.rows for b in index.buffers) <= n
        for lv in index.state.levels:
            for s in lv:
                keys = [(f.first, f.last) for f in s.files]
                assert keys == sorted(keys) and all(a[1] <= b[0] for a, b in zip(keys, keys[1:]))
        held, plain = [], index._read
        rows = {f"{s.path}/{f.name}": f.rows for lv in index.state.levels for s in lv for f in s.files}
        index._read = lambda paths, schema=OP: (held.extend(paths), plain(paths, schema))[1]
        assert index.sample(5, seed=1, passes=1).count() == 5
        read.append(sum(rows.get(p, 0) for p in held))
        held.clear()
        index._line(100, 300)
        assert len(held) <= 2 * sum(len(lv) for lv in index.state.levels)
    assert read[0] > 0 and read[1] < 2 * max(read[0], 2500)


def test_range_draws_are_exact(spark, tmp_path):
    rows = [(i, i % 60 if i % 97 else None, i, 1 + i % 9, "I") for i in range(1200)] + [(1200 + i, i % 60, i, 0, "T") for i in range(1, 600, 7) if i % 97]
    index = Index(spark, f"file://{tmp_path}/index", Config(170, 2, file_rows=60))
    index.append(spark.createDataFrame(rows, OP))
    live = [(r.key, r.value, r.weight) for r in index.live().collect()]
    for low, high in ((10, 19), (None, 4), (55, None), (30, 30), (200, 300)):
        want = {x for x in live if (low is None and high is None) or x[0] is not None and (low is None or x[0] >= low) and (high is None or x[0] <= high)}
        drawn = [tuple(r)[1:] for r in index.sample(2000, seed=9, low=low, high=high).collect()]
        assert len(drawn) == (2000 if want else 0) and set(drawn) <= want
        total = sum(w for *_, w in want)
        for w in (1, 9) if want else ():
            expected = 2000 * sum(x[2] for x in want if x[2] == w) / total
            assert abs(sum(x[2] == w for x in drawn) - expected) < 6 * max(1, expected) ** 0.5


def test_two_writers(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    op = lambda i: spark.createDataFrame([(i, i, i, 1, "I")], OP)
    a, b = Index(spark, path, Config(100, 2)), Index(spark, path)
    a.append(op(1))
    with pytest.raises(RuntimeError, match="another writer"):
        b.append(op(2))
    a.append(op(3))
    c = Index(spark, path)
    assert c.live().count() == 2
    c._current = lambda: None  # both look, then both write
    a.append(op(4))
    with pytest.raises(RuntimeError, match="another writer"):
        c.append(op(5))
    assert {r.seq for r in Index(spark, path).live().collect()} == {1, 3, 4}


def test_many_small_appends(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/index", Config(1000, 2, retain=2, orphan_seconds=0))
    for i in range(40):
        index.append(spark.createDataFrame([(i, i, i, 1 + i, "I")], OP).coalesce(1), i if i != 20 else 99)
    assert len(index.buffers) < 16 and (index.upto, index.beyond) == (19, {99, *range(21, 40)})
    index.append(spark.createDataFrame([(20, 0, 0, 1, "T")], OP), 20)
    assert (index.upto, index.beyond) == (39, {99})
    again = Index(spark, index.path)
    again.append(spark.createDataFrame([(77, 7, 7, 1, "I")], OP), 30)  # a replay
    assert again.live().count() == 39 and (again.upto, again.beyond) == (39, {99})
    assert len(list((tmp_path / "index").glob("buffer-*"))) <= 16 + 2 and len(list((tmp_path / "index").glob("manifest-*"))) == 3
    assert sorted(r.weight for r in again.sample(500, seed=2).select("weight").distinct().collect())[-1] == 40


def test_sweep_of_what_failed_writes_left(spark, tmp_path, monkeypatch):
    index = Index(spark, f"file://{tmp_path}/index", Config(50, 2, retain=1, orphan_seconds=0))
    df = spark.range(120).selectExpr("id as seq", "id as key", "id as value", "id as weight", "'I' as op")
    index.append(df.where("seq < 60"))
    with monkeypatch.context() as m:
        m.setattr(index, "_write_manifest", lambda: (_ for _ in ()).throw(OSError("no space")))
        with pytest.raises(OSError):
            index.append(df.where("seq >= 60"))
    again = Index(spark, index.path)
    assert {r.seq for r in again.live().collect()} == set(range(60))
    stale = {p.name for p in (tmp_path / "index").iterdir()} - {n.partition("/")[0] for n in again.named[again.version]}
    assert any(n.startswith(("buffer-", "load-")) for n in stale)
    again.append(df.where("seq >= 60"))
    snapshot = again.compact_all()
    again.append(df.where("seq < 0"))
    assert snapshot.count() == 120
    for _ in range(2):
        again.append(df.where("seq < 0"))
    left = {p.name for p in (tmp_path / "index").iterdir() if not p.name.startswith(("manifest-", "."))}
    assert left == {n.partition("/")[0] for names in again.named.values() for n in names}  # the snapshot's versions are over, too
    assert again.live().count() == 120


def test_a_shard_alone_moves_without_being_written(spark, tmp_path):
    """Levels that are merged down with one shard into an empty level: only the manifest changes."""
    index = Index(spark, f"file://{tmp_path}/index", Config(100, 2, max_rejection_rate=0.01, rejection_floor=0))
    index.bulk_load(spark.range(350).selectExpr("id as seq", "id as key", "id as value", "1L as weight", "'I' as op"))
    shards = [[s.path for s in lv] for lv in index.state.levels]
    assert [len(x) for x in shards] == [1, 1]
    before = {p for p in (tmp_path / "index").rglob("*.parquet")}
    index.observe_rejections(0, 100, 50)
    assert [[s.path for s in lv] for lv in index.state.levels] == [[], [shards[1][0], shards[0][0]]]
    assert {p for p in (tmp_path / "index").rglob("*.parquet")} == before and index.live().count() == 350
    assert index.seconds["merge"] == 0 and index.metrics()["checks"] == [0, 0]


def test_rejections_are_counted_by_cause_and_kept(spark, tmp_path):
    rows = [(i, i, i, 5, "I") for i in range(300)] + [(300 + i, i, i, 0, "T" if i % 3 else "D") for i in range(0, 150)]
    index = Index(spark, f"file://{tmp_path}/index", Config(90, 2))
    index.append(spark.createDataFrame(rows, OP))
    assert index.sample(400, seed=1).count() == 400
    told = index.metrics()["rejects"]
    assert told["tombstone"] > told["tag"] > 0 == told["range"]
    index.append(spark.createDataFrame([(900, 1, 1, 1, "I")], OP))
    assert Index(spark, index.path).metrics()["rejects"] == told


def test_lines_as_a_stream(spark, tmp_path):
    good, bad = ["5\t1\t10", "6\t2\t20", "-7\t3\t0"], ["", "x\t1\t2", "1\t2", "1\t2\t3\t4", "1\t\t3", "1\t2\tnan"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.tsv").write_text("\n".join([*good[:2], *bad[:4]]) + "\n")
    assert sorted(r.line for r in tsv.malformed(spark, f"{tmp_path}/in").collect()) == sorted(bad[:4])
    index = Index(spark, f"file://{tmp_path}/index", Config(2, 2))
    run = lambda: ingest_lines(tsv.record_stream(spark, f"{tmp_path}/in"), index, f"{tmp_path}/offsets", f"{tmp_path}/aside").awaitTermination()
    run()
    (tmp_path / "in/b.tsv").write_text("\n".join([*good[2:], *bad[4:]]))
    run()
    run()
    assert sorted((r.value, r.key, r.weight) for r in index.live().collect()) == [(-7, 3, 0), (5, 1, 10), (6, 2, 20)]
    kept = spark.read.parquet(f"{tmp_path}/aside")
    assert sorted(r.line for r in kept.collect()) == sorted(bad) and {r.batch: r["count"] for r in kept.groupBy("batch").count().collect()} == {0: 4, 1: 2}


@pytest.mark.parametrize("deletes", ["tombstone", "tag"])
def test_interleaved_deletes_meet_what_lives(spark, tmp_path, deletes):
    """Batches with flushes and merges: every delete is of a record that was drawn while it lived, and meets it."""
    rows = spark.range(900).selectExpr("id as seq", "id as key", "id % 7 as value", "1 + id % 11 as weight")
    for i in range(6):
        rows.where(f"seq div 150 = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    index = Index(spark, f"file://{tmp_path}/index", Config(130, 2, deletes=deletes))
    stream = tsv.table_stream(spark, f"{tmp_path}/in", "seq long, key long, value long, weight long")
    interleave(stream, index, f"{tmp_path}/offsets", 20, batches_per_pool=2).awaitTermination()
    live = {r.key for r in index.live().collect()}
    gone = set(range(900)) - live
    assert 60 <= len(gone) <= 100 and index.metrics()["tombstones"] < len(gone)
    stored = index.log().where("op != 'I'").collect()
    assert all(r.key in gone and r.seq % 2 == 1 for r in stored) and all(r.op == ("D" if deletes == "tag" else "T") for r in stored)
    assert max(gone) < 750 and min(r.seq for r in stored) >= 2 * 150 - 1
    # each batch's deletes are those of its share of the pool
    assert index.metrics()["records"] == 900 - len(gone) + 2 * len(stored) and any(n.startswith("pool-2") for n, _ in index.handed)


def rows_read(spark, action):
    """What ``action`` gives, and how many records its stages read from files."""
    store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    stages = lambda: {(x.stageId(), x.attemptId()): x.inputRecords() for x in (lambda s: [s.apply(i) for i in range(s.size())])(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None))}
    bus.waitUntilEmpty(10_000)
    before = stages()
    out = action()
    bus.waitUntilEmpty(10_000)
    return out, sum(n for k, n in stages().items() if k not in before)


def test_pages_that_no_draw_needs_are_skipped(spark, tmp_path):
    """Files of many pages: the rows read for a few draws are pages, not files, and stay so as the index grows."""
    read, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    for n in (200_000, 800_000):
        index = Index(spark, f"file://{tmp_path}/{n}", Config(n - 1, 2, file_rows=200_000))
        spark.conf.set("spark.sql.shuffle.partitions", 1)
        index.bulk_load(spark.range(n).selectExpr("id as seq", "id as key", "id as value", "1 + id % 5 as weight", "'I' as op"))
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert len(index.state.levels[0][0].files) == n // 200_000
        line = index._line(None, None)
        placed = spark.createDataFrame([(0, 0, 17), (1, len(line) - 1, 200_000), (2, 0, 500_000)], "draw long, shard int, at long")
        found, rows = rows_read(spark, lambda: sorted(map(tuple, index._fallen(placed, line).collect())))
        assert [(r[0], r[4]) for r in found] == [(0, 1 + found[0][2] % 5), (1, 1 + found[1][2] % 5), (2, 1 + found[2][2] % 5)]
        read.append(rows)
    assert 0 < read[0] <= 120_000 and read[1] <= 120_000


def test_filters_are_asked_in_one_go(spark, tmp_path):
    """As many jobs for many shards' filters as for few."""
    jobs = []
    for n in (2, 9):
        index = Index(spark, f"file://{tmp_path}/{n}", Config(40, 12, filters=True))
        index.bulk_load(spark.range(41 * n).selectExpr("id as seq", "id as key", "id as value", "1L as weight", "if(id % 4 = 3, 'T', 'I') as op"))
        assert len([s for s in index._all() if s.tombstones]) >= n - 1
        spark.sparkContext.setJobGroup(f"asked-{n}", "filters")
        assert index._may_delete(np.arange(0, 41 * n, 5))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"asked-{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] and abs(jobs[1] - jobs[0]) <= 1


def test_a_large_buffer_is_looked_up_in_ranges(spark, tmp_path, monkeypatch):
    """No task sorts the whole buffer, and the draws are the same whatever the ranges."""
    def whole(*_):
        raise AssertionError("the buffer is looked up as one group")

    monkeypatch.setattr(store, "look_up", whole, raising=False)
    ops = spark.createDataFrame([(i, i % 40, i % 3, 1 + i % 7, "I") for i in range(300)], OP)
    got = []
    for rows in (1_000_000, 20):
        index = Index(spark, f"{tmp_path}/{rows}", Config(buffer_cap=1000, file_rows=rows))
        index.append(ops)
        got.append(sorted(map(tuple, index.sample(200, 3).collect())))
    assert got[0] == got[1] and [r[0] for r in got[0]] == list(range(200))
