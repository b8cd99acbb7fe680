"""SuperMinHash classes against all pairs on full sets."""

import random
import re

import numpy as np
import pytest

from lotwise.llm.super_minhash import bands, keep_first, minhash_classes, signature


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def plain(rows, size=2, percent=80):
    """(id, n, component, kept) of each row, by comparing all pairs."""
    sets = [shingles(t, size) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and group[i] != group[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    out = []
    for (i, _), s, g in zip(rows, sets, group):
        ids = [rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None]
        component = (min(ids) if ids else None) if s else i
        out.append((i, len(s), component, component == i))
    return sorted(out, key=repr)


def told(spark, texts, **more):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, n string, k int")
    return sorted((tuple(r) for r in minhash_classes(docs, **more).collect()), key=repr)


def changed(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def some(seed, groups=12, each=7):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([2, 6, 20, 60, 150]))]
        for _ in range(rng.randrange(1, each)):
            rows.append((len(rows) * 3 % 1009, changed(rng, base, rng.randrange(0, max(2, len(base) // 8)))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, seed):
    rows = some(seed)
    assert told(spark, rows) == plain(rows)
    if seed == 1:
        assert told(spark, rows, size=5, percent=60) == plain(rows, 5, 60)


def test_chains_and_blocks(spark):
    """Texts that drift, so that most members of a key are linked through others only; and tasks of two blocks."""
    rng = random.Random(4)
    words, rows = [f"w{i}" for i in range(100)], []
    for i in range(60):
        words[rng.randrange(100)] = f"x{i}"
        rows.append((1000 - i, " ".join(words)))
    assert told(spark, rows) == plain(rows)
    common = [f"c{i}" for i in range(60)]
    rows += [(2000 + i, " ".join(common + [f"own{i}-{j}" for j in range(rng.randrange(20, 50))])) for i in range(60)]  # alike, not linked
    assert told(spark, rows, block=2000, rows=2) == plain(rows)


def test_edges(spark):
    text = "one two three four five six"
    rows = [(5, None), (6, ""), (7, " \n"), (8, "word"), (9, "WORD"), (None, text), (None, "alone here"), (3, text), (3, text), (4, text.upper() + " seven"), (11, "a b " * 5000), (12, "b a " * 5000), (13, "long " * 50_000)]
    assert told(spark, rows) == plain(rows)
    assert told(spark, []) == []
    same = [(i, text) for i in range(300)]
    assert told(spark, same) == [(i, 5, 0, i == 0) for i in sorted(range(300), key=lambda i: repr((i, 5, 0, i == 0)))]


def test_keep_first(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, None), (None, "a b c d e f g h"), (4, "other words stand in this one here")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, _gone string")
    got = keep_first(docs)
    assert got.columns == ["doc_id", "text", "_gone"]
    assert sorted(map(str, (r.doc_id for r in got.collect()))) == ["1", "3", "4", "None"]


def test_signature_is_unbiased_and_varies_less_than_independent_hashes():
    rng = np.random.default_rng(5)
    for n, s in ((12, 0.75), (200, 0.8)):
        same = []
        for _ in range(200):
            both, u = int(n * s), rng.integers(0, 1 << 63, n).astype(np.uint64)
            cut = both + (n - both) // 2
            a, b = signature(np.sort(u[:cut]), 240), signature(np.sort(np.concatenate([u[:both], u[cut:]])), 240)
            same.append((a == b).mean())
        assert abs(np.mean(same) - s) < 0.01
        assert np.std(same) < 0.9 * (s * (1 - s) / 240) ** 0.5
    # early stopping changes nothing: chunks in any order, and all at once
    u = np.unique(rng.integers(0, 1 << 63, 9000).astype(np.uint64))
    parts = np.minimum(signature(u[:4000], 240), signature(u[4000:], 240))
    assert (signature(u, 240) == parts).all() and (signature(u[::-1], 240) == parts).all()
    assert len(set(bands(parts, 6).tolist())) == 40
