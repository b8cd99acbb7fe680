"""Repeated windows of lines against a plain model."""

import random

from pyspark.sql import functions as F

from lotwise.llm.line_dedup import dedup_lines


def plain(rows, w=3):
    """Text after removal by (id, text); rows of equal id and text are one."""
    first = {}
    docs = sorted({(i, t) for i, t in rows if t is not None}, key=lambda x: (x[0] is None, x[0] or 0))
    for i, t in docs:
        a = t.split("\n")
        for p in range(len(a) - w + 1):
            first.setdefault(tuple(a[p : p + w]), (i, t, p))
    out = {(i, None): (None, 0) for i, t in rows if t is None}
    for i, t in docs:
        a = t.split("\n")
        gone = {p + k for p in range(len(a) - w + 1) if first[tuple(a[p : p + w])] != (i, t, p) for k in range(w)}
        out[i, t] = ("\n".join(x for p, x in enumerate(a) if p not in gone), len(gone))
    return out


def test_against_plain_model(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choices("abc", k=rng.randrange(1, 14)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n\n\n\n"), (103, "q\nr\ns\nt"), (104, "q\nr\ns\nt"), (104, "q\nr\ns\nt"), (None, "x\nq\nr\ns"), (105, "L\n" * 3000)]
    docs = spark.createDataFrame([(i, t, "keep") for i, t in rows], "doc_id long, text string, n_lines string").withColumn("_d", F.lit(1)).withColumn("at", F.lit(2))
    got = dedup_lines(docs, name="c").collect()
    want = plain(rows)
    assert len(got) == len(rows)
    before = {}
    for r in got:
        before.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        text, gone = want[i, t]
        assert any((r.text, r.c["n_removed"], r.n_lines) == (text, gone, "keep") for r in before[i]), (i, t)
    assert dedup_lines(docs.limit(0)).count() == 0


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc")], "doc_id long, text string")
    plan = dedup_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
