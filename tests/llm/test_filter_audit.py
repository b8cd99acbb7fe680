"""Filter interactions against a plain model over documents and orders."""

import random
import re
from itertools import permutations

from lotwise.llm.filter_audit import filter_interactions


def plain(rows, labels):
    """rows: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = any(i is not None and j is not None and j < i and (u or "") == t for j, u, _ in rows)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": smaller}
        docs.append((s or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, shapley = {}, {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                out[part, "".join(order), step] = [len(left), len(gone), sum(x in d[1] for d in mine) - len(gone), sum(d[1] == {x} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shapley[part, x] = shapley.get((part, x), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def told(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, source string, mask string, n int")
    got = filter_interactions(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len({(r.part, r.filter_order, r.step) for r in got}) == len(got)
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}


def test_against_plain_model(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)] + ["WORD", "Caps", "a#b", "x|y", "été"]
    rows = []
    for i in range(150):
        t = " ".join(rng.choices(words if i % 3 else words[:30], k=rng.randrange(30, 90)))
        rows.append((i, rng.choice([t, t.lower(), t.replace("#", "").replace("|", "")]), rng.choice(["a", "b", "", None])))
    rows += [(200 + i, rng.choice(rows[:20])[1], "a") for i in range(60)]  # copies over parts
    rows += [(300, None, "a"), (301, "", None), (302, " \t\n", "b"), (None, rows[0][1], "a"), (None, None, None), (400, "Z" * 100_000, "long"), (7, rows[7][1], rows[7][2])]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 260, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    assert told(spark, rows, labels) == plain(rows, labels)


def test_edges(spark):
    assert told(spark, [], []) == {}
    assert told(spark, [], [(1, 1, 1)]) == {}
    got = told(spark, [(1, "a b", "s")], [])
    assert len(got) == 600 and got == plain([(1, "a b", "s")], [])
    same = [(i, "one text in every row", "hot") for i in range(500)]
    assert told(spark, same, []) == plain(same, [])


def test_plan_has_no_python_and_no_cross_join(spark):
    docs = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    plan = filter_interactions(docs, spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "BroadcastNestedLoop" not in plan
