"""Seeds, chains and alignments against plain loops; planted passages found, clean texts left alone."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lotwise.llm.passages import align, chains, common, repeated_passages, seeds


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=60), st.integers(1, 4), st.integers(1, 6))
def test_seeds_are_window_minima(words, k, window):
    w = np.array(words, dtype=np.uint64)
    h, at = seeds(w, k, window)
    grams, where = seeds(w, k, 1)
    every = {}
    for x, p in zip(grams.tolist(), where.tolist()):
        every[tuple(words[p : p + k])] = x
    full = [every[tuple(words[i : i + k])] for i in range(len(words) - k + 1)]
    n = min(window, len(full))
    want = {i for j in range(len(full) - n + 1) if n for i in range(j, j + n) if full[i] == min(full[j : j + n])}
    assert at.tolist() == sorted(i for i in want if not (i and full[i] == full[i - 1]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=1, max_size=25))
def test_best_chain_as_by_all_predecessors(points):
    points = sorted(set(points))
    best = {}
    for j, (p, q) in enumerate(points):
        best[p, q] = 6 + max([0.0] + [best[a, b] - 0.1 * (p - a + q - b) for a, b in points[:j] if a < p and b < q])
    found = chains(points, 6, 0.1, 10**9)
    assert sorted(x for c in found for x in c) == points
    cost = lambda c: 6 * len(c) - 0.1 * sum(c[-1][i] - c[0][i] for i in (0, 1))
    assert all(a[0] < b[0] and a[1] < b[1] for c in found for a, b in zip(c, c[1:]))
    if len({p - q for p, q in points}) > 1:
        assert abs(cost(found[0]) - max(best.values())) < 1e-9


def test_common_and_align():
    a = np.arange(100, dtype=np.uint64)
    b = np.concatenate((np.arange(500, 520), np.arange(10, 40), [900], np.arange(41, 60), np.arange(62, 90), [77])).astype(np.uint64)
    assert common(a[:10], a[2:12]) == 8
    s, e, t, u, m = align(a, b, [(15, 25), (42, 52), (70, 78)], 6)
    assert (s, e, t, u, m) == (10, 90, 20, 98, 77)


def test_planted_passages(spark):
    rng = random.Random(21)
    vocab = [f"w{i}" for i in range(5000)]
    text = lambda n: rng.choices(vocab, k=n)
    passage = text(80)
    rows, holders = [], set()
    for i in range(90):
        w = text(rng.randrange(5, 200))
        if i % 3 == 0:
            p = list(passage)
            for _ in range(i % 4):
                p[rng.randrange(80)] = "changed"
            if i % 2:
                del p[40]
            at = rng.randrange(len(w) + 1)
            w[at:at] = p
            holders.add(i)
        rows.append((i, " ".join(w)))
    own = text(60)
    rows += [(200, " ".join(own + text(100) + own)), (201, None), (202, ""), (203, "same " * 5000), (204, rows[1][1]), (None, " ".join(text(50))), (205, "A-b, " * 30)]
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows + [rows[0]]], "doc_id long, text string, start int")
    got = repeated_passages(docs).collect()
    pairs = [(r.doc_id, r.source_id) for r in got]
    reached = {0}
    for _ in holders:  # all holders hang together
        reached |= {x for p in pairs if reached & set(p) for x in p}
    assert reached == holders
    assert (200, 200) in pairs
    long_copy = len(rows[1][1].split()) >= 40
    assert ((204, 1) in pairs or (1, 204) in pairs) == long_copy
    assert {d for p in pairs for d in p} <= holders | {200, 1, 204}
    for r in got:
        if r.doc_id in holders:
            assert r.end - r.start >= 40 and r.identity >= 0.9
    assert len(got) == len(set(pairs)) and repeated_passages(docs.limit(0)).count() == 0


def test_passages_of_frequent_lines(spark):
    rng = random.Random(5)
    lines = [" ".join(f"x{i}y{j}" for j in range(14)) for i in range(240)]
    filler = lambda n: " ".join(f"f{rng.randrange(10**9)}" for _ in range(n))
    rows, pairs = [], []
    for i in range(60):  # each passage in two documents only, each of its lines and line pairs in many
        passage = " ".join(lines[4 * i : 4 * i + 4])
        for _ in range(2):
            rows.append((len(rows), f"{filler(30)} {passage} {filler(30)}"))
        pairs.append((len(rows) - 2, len(rows) - 1))
    for i in range(240):
        for _ in range(20):
            rows.append((len(rows), f"{filler(20)} {lines[i]} {filler(20)}"))
            if i % 4 < 3:  # 28 words: two lines of a passage
                rows.append((len(rows), f"{filler(20)} {lines[i]} {lines[i + 1]} {filler(20)}"))
    got = {frozenset((r.doc_id, r.source_id)) for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {frozenset(p) for p in pairs}


def test_exact_words_in_a_row_whose_anchors_are_frequent(spark):
    rng = random.Random(6)
    filler = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    rows, pairs = [], []
    for i in range(40):  # 40 words common to two; their first and last 39 words to ten others each
        run = [f"r{i}w{j}" for j in range(40)]
        pairs.append(frozenset((len(rows), len(rows) + 1)))
        for w in [run] * 2 + [run[:39]] * 10 + [run[1:]] * 10:
            rows.append((len(rows), " ".join(filler(20) + w + filler(20))))
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {frozenset((r.doc_id, r.source_id)) for r in got.collect()} == set(pairs)


def brute_runs(rows, size):
    """Groups of documents that the same ``size`` words in a row connect."""
    at = {}
    for i, t in rows:
        w = (t or "").split()
        for j in range(len(w) - size + 1):
            at.setdefault(tuple(w[j : j + size]), set()).add(i)
    return connected(at.values())


def connected(groups):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for g in groups:
        g = sorted(g)
        for x in g[1:]:
            up[top(x)] = top(g[0])
    return {x: top(x) for x in list(up) if top(x) in {top(y) for y in up if y != x}}


def test_every_exact_run_is_linked(spark):
    """A mosaic of few phrases, so that seeds stand first all over the place: all runs against brute force."""
    rng = random.Random(31)
    phrases = [[f"p{i}x{j}" for j in range(rng.randrange(5, 30))] for i in range(25)]
    filler = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for i in range(300):
        w = []
        for _ in range(rng.randrange(1, 7)):
            w += filler(rng.randrange(3)) + rng.choice(phrases) if rng.random() < 0.8 else rng.choices(["a", "b"], k=rng.randrange(50)) + ["same"] * rng.randrange(60)
        rows.append((i, " ".join(w)))
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    have = connected([{r.doc_id, r.source_id} for r in got])
    want = brute_runs(rows, 40)
    assert len(want) > 90
    for group in {frozenset(x for x in want if want[x] == top) for top in want.values()}:
        assert len({have.get(x, -x - 1) for x in group}) == 1
    texts = {i: t.split() for i, t in rows}
    for r in got:
        a, b = texts[r.doc_id][r.start : r.end], texts[r.source_id][r.source_start : r.source_end]
        assert len(a) >= 40 and (r.identity < 1 or a == b)


def test_pairs_whose_pieces_stand_elsewhere(spark):
    rng = random.Random(8)
    filler = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    rows, pairs = [], set()
    for i in range(20):
        run = [f"r{i}w{j}" for j in range(80)]
        pairs.add(frozenset((len(rows), len(rows) + 1)))
        for _ in range(2):
            rows.append((len(rows), " ".join(filler(25) + run + filler(25))))
        for j in range(0, 54, 5):  # too short to count
            for _ in range(4):
                rows.append((len(rows), " ".join(filler(25) + run[j : j + 27] + filler(25))))
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {frozenset((r.doc_id, r.source_id)) for r in got.collect()} == pairs
