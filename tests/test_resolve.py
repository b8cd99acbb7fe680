"""Liveness of ops against a stack model, and the buffer's tombstone cap."""

import random

from lotwise.functions.records import OP
from lotwise.operators import resolve


def model(rows):
    """Live inserts and unmatched deletes by seq, by stacks."""
    stacks, lost = {}, set()
    for seq, k, v, _, op in sorted(rows):
        s = stacks.setdefault((k, v), [])
        if op == "I":
            s.append(seq)
        elif s:
            s.pop()
        else:
            lost.add(seq)
    return {x for s in stacks.values() for x in s}, lost


def log(n, seed, share=0.4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        op = "I" if rng.random() > share else rng.choice("TD")
        out.append((i, rng.randrange(5), rng.randrange(3), rng.randrange(1, 9) if op == "I" else 0, op))
    return out


def test_random_logs_against_stacks(spark):
    for seed, share in ((1, 0.4), (2, 0.7), (3, 0.0)):
        rows = log(400, seed, share)
        df = spark.createDataFrame(rows, OP)
        alive, lost = model(rows)
        assert {r.seq for r in resolve.live(df).collect()} == alive
        assert {r.seq for r in resolve.unmatched(df).collect()} == lost
    assert resolve.live(df.limit(0)).count() == 0


def test_buffer_cancellation_leaves_512_of_768(spark):
    rows = [(i, k, k, 1, "I") for i, k in enumerate(range(512, 0, -1))] + [(600 + k, k, k, 0, "T") for k in range(1, 257)] + [(2000 + k, k, k + 1, 1, "I") for k in range(257, 513)]
    assert resolve.live(spark.createDataFrame(rows, OP)).count() == 512


def test_full_cancellation(spark):
    pairs = [(i, i + j) for i in range(50) for j in (0, 1)]
    rows = [(n, k, v, 1, "I") for n, (k, v) in enumerate(pairs)] + [(1000 + n, k, v, 0, "T") for n, (k, v) in enumerate(pairs)]
    marked = resolve.brackets(spark.createDataFrame(rows, OP))
    assert marked.where("alive").count() == 0


def test_tombstone_cap_refuses_the_51st(spark):
    rows = [(i, i, i, int(i % 2 == 1), "T" if i % 2 == 0 else "I") for i in range(99)] + [(99, 1000, 1, 0, "T")]
    told = {r.seq: r.accepted for r in resolve.accept(spark.createDataFrame(rows, OP), 200, 50).collect()}
    assert not told[99] and sum(told.values()) == 99


def test_deleted_only_by_a_later_tombstone(spark):
    rows = [(0, 1, 1, 0, "T"), (1, 1, 1, 5, "I"), (2, 2, 2, 5, "I"), (3, 2, 2, 0, "T"), (4, 3, 3, 5, "I")]
    assert {r.seq: r.deleted for r in resolve.deleted_later(spark.createDataFrame(rows, OP)).collect()} == {1: False, 2: True, 4: False}


def test_found(spark):
    have = spark.createDataFrame([(1, 1), (2, 2), (2, 2)], "key long, value long")
    asked = spark.createDataFrame([(1, 1), (2, 3), (2, 2)], "key long, value long")
    assert sorted(map(tuple, resolve.found(asked, have, ["key", "value"]).collect())) == [(1, 1, 1), (2, 2, 1), (2, 3, 0)]


def test_brackets_in_ranges_are_the_same(spark):
    rows = log(600, 11, 0.45)
    df = spark.createDataFrame([*rows, (601, None, 1, 5, "I"), (602, None, 1, 0, "T"), (603, None, 2, 0, "T"), (604, 1, None, 2, "I"), (605, 4, None, 0, "D")], OP)
    want = {(r.seq, r.alive) for r in resolve.brackets(df, 1).collect()}
    alive, lost = model(rows)
    assert {r for r, a in want if a} == alive | lost | {603, 604, 605}
    for parts in (2, 7, 64, 300):
        assert {(r.seq, r.alive) for r in resolve.brackets(df, parts).collect()} == want
    one = spark.createDataFrame([(i, 1, 1, 1, "I" if i % 3 else "T") for i in range(500)], OP)  # one (key, value) has the whole log
    rows = [tuple(r) for r in one.collect()]
    assert {r.seq for r in resolve.live(one, 40).collect()} == model(rows)[0]


def test_the_log_is_exchanged_once(spark, tmp_path):
    """One exchange by range, which both its uses share; the only other one is of two rows for each range."""
    spark.createDataFrame(log(300, 5), OP).write.parquet(f"{tmp_path}/log")
    stored = spark.read.parquet(f"{tmp_path}/log")
    marked = resolve.live(stored, 8, ordered=True)
    marked.collect()
    plan = marked._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in plan
    ranged = [line for line in plan.splitlines() if "Exchange rangepartitioning" in line]
    assert len(ranged) == 2 and sum("ReusedExchange" in line for line in ranged) == 1 and plan.count("FileScan") == 1
    assert plan.count("Exchange hashpartitioning") == 1
    plain = resolve.live(stored, 8)
    assert "rangepartitioning" not in plain._jdf.queryExecution().toString()  # that was when the ranges were written
    assert plain.exceptAll(marked).count() == 0 == marked.exceptAll(plain).count()
    keys = [(r.key, r.value, r.seq) for r in marked.collect()]
    assert keys == sorted(keys)
    twice = resolve.brackets(resolve.brackets(stored, 3).where("alive").drop("alive").union(stored.where("seq < 0")), 5)
    assert {r.seq for r in twice.where("op = 'I' and alive").collect()} == {r.seq for r in marked.collect()}


def test_two_requests_for_one_record(spark):
    there = spark.createDataFrame([(1, 5, 5), (2, 5, 5), (9, 6, 6)], "seq long, key long, value long")
    asked = spark.createDataFrame([(3, 5, 5), (4, 5, 5), (5, 5, 5), (6, 6, 6), (7, 8, 8)], "seq long, key long, value long")
    assert {r.seq: r.found for r in resolve.met(asked, there).collect()} == {3: 1, 4: 1, 5: 0, 6: 0, 7: 0}


def test_ranges_are_scanned_in_chunks(spark, monkeypatch):
    """A task holds a chunk of its range, whatever the range's size; what lives is the same."""
    held = []
    rows = log(700, 3, 0.45) + [(1000 + i, 9, 9, 1, "I" if i % 3 else "T") for i in range(400)]
    df = spark.createDataFrame(rows, OP)
    alive, lost = model(rows)
    for most in (1, 7, 64):
        monkeypatch.setattr(resolve, "CHUNK", most)
        for parts in (1, 5):
            assert {r.seq for r in resolve.brackets(df, parts).where("alive").collect()} == alive | lost
    written = resolve.written
    monkeypatch.setattr(resolve, "written", lambda df, name: held.append(written(df, name)) or held[-1])
    resolve.brackets(df, 1)
    assert held[0].groupBy("_part").count().agg({"count": "max"}).first()[0] <= 64
    monkeypatch.undo()


def test_ordered_rows_in_a_union(spark, tmp_path):
    """The tasks of a union are numbered through, ranges aren't."""
    rows = log(300, 8)
    spark.createDataFrame(rows, OP).write.parquet(f"{tmp_path}/log")
    stored = spark.read.parquet(f"{tmp_path}/log")
    both = stored.where("op = 'I'").union(resolve.live(stored, 6, ordered=True).select(stored.columns))
    assert sorted(r.seq for r in both.collect()) == sorted([r[0] for r in rows if r[4] == "I"] + list(model(rows)[0]))
