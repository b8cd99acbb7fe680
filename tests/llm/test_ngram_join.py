"""The Jaccard join against all pairs, and its parts."""

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lotwise.llm import ngram_join
from lotwise.llm.components import components
from lotwise.llm.ngram_join import jaccard_classes, keep_one, key_stars, keys, odd_bits, sifted, trie_links


def shingles(text, size):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def linked(a, b, percent):
    return bool(a and b) and 100 * len(a & b) >= percent * len(a | b)


def closure(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        x, y = label[a], label[b]
        label = [min(x, y) if v in (x, y) else v for v in label]
    return label


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([60, 80, 90]))
def test_trie_and_keys_lose_no_link(seed, percent):
    rng = random.Random(seed)
    base = rng.sample(range(10**6), rng.randrange(1, 120))
    sets = []
    for _ in range(rng.randrange(2, 14)):
        s = set(base)
        for _ in range(rng.randrange(0, 1 + len(base) // 6)):
            s.discard(rng.choice(base))
            if rng.random() < 0.5:
                s.add(rng.randrange(10**6))
        s = s or {1}
        sets.append(np.array(sorted(hash((x, 7)) & (2**64 - 1) for x in s), dtype=np.uint64))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if linked(set(sets[i].tolist()), set(sets[j].tolist()), percent)]
    for order in (None, lambda x: x % np.uint64(5)):
        assert closure(len(sets), trie_links(sets, percent, None, order)) == closure(len(sets), pairs)
    for i, j in pairs:
        assert np.array_equal(sets[i], sets[j]) or set(keys(sets[i], percent).tolist()) & set(keys(sets[j], percent).tolist())


def texts():
    rng = random.Random(11)
    out = [None, "", " \n ", "one", "one", "One two", "one two", "x y z", "X  y\nz"]
    for _ in range(14):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([8, 30, 90, 300]))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            out.append(" ".join(w))
    return out + [out[-1], "long " * 5000]


def test_against_all_pairs(spark):
    rows = [(1000 - i, t) for i, t in enumerate(texts())]
    for size, percent, block in ((3, 90, 2_000_000), (3, 90, 150), (5, 80, 2_000_000)):
        sets = [shingles(t, size) for _, t in rows]
        label = closure(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if linked(sets[i], sets[j], percent)])
        want = {rows[i][0]: (len(sets[i]), min(r[0] for r, v in zip(rows, label) if v == label[i])) for i in range(len(rows))}
        docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, component_id int")
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(docs, size, percent, block).collect()} == want
        if size == 5:
            kept = keep_one(docs)
            assert kept.columns == docs.columns
            assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (7, "other words stand here"), (None, None), (None, "alone in this world")], "doc_id long, text string")
    got = sorted(str(tuple(r)) for r in jaccard_classes(docs).collect())
    assert got == sorted(map(str, [(None, 2, 7), (7, 2, 7), (7, 2, 7), (7, 2, 7), (None, 0, None), (None, 2, None)]))
    assert jaccard_classes(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    nodes = [rng.randrange(-(2**62), 2**62) for _ in range(200)]
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 150)] + [(i, i) for i in range(150, 160)]
    got = {r.node: r.label for r in components(spark.createDataFrame([(nodes[a], nodes[b]) for a, b in pairs], "u long, v long")).collect()}
    want = closure(200, pairs)
    for a, _ in pairs:
        for b, _ in pairs:
            if a < 150 and b < 150:
                assert (got[nodes[a]] == got[nodes[b]]) == (want[a] == want[b])


def test_sets_with_equal_hashes_are_told_apart(spark):
    """A hash of four bits, so that most sets share theirs with others."""
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    rows = lambda **more: sorted(map(tuple, jaccard_classes(docs, **more).collect()))
    assert rows(digest_bits=4) == rows()


def test_sieve_keeps_links_and_parts_chains():
    """Sets that are linked are never told apart; sets that only share a passage are."""
    rng = np.random.default_rng(2)
    for percent in (60, 80, 90):
        for n in (1, 3, 20, 90, 400, 3000):
            base = rng.integers(0, 2**63, n, dtype=np.uint64)
            sets = [base]
            for _ in range(12):
                s = base.copy()
                m = int(rng.integers(0, n // 4 + 1))
                s[:m] = rng.integers(0, 2**63, m, dtype=np.uint64)
                sets.append(np.unique(s[: n - int(rng.integers(0, n // 6 + 1))]))
            pairs = [(i, j) for i in range(len(sets)) for j in range(i) if linked(set(sets[i].tolist()), set(sets[j].tolist()), percent)]
            found = [(x, int(y)) for x, others in sifted(np.array([len(s) for s in sets]), [odd_bits(s) for s in sets], percent) for y in others]
            label = closure(len(sets), found)
            assert all(label[i] == label[j] for i, j in pairs)
    common = rng.integers(0, 2**63, 60, dtype=np.uint64)
    chain = [np.unique(np.concatenate((common, rng.integers(0, 2**63, 60, dtype=np.uint64)))) for _ in range(40)]
    assert sum(len(o) for _, o in sifted(np.array([len(s) for s in chain]), [odd_bits(s) for s in chain], 80)) < 4


def test_a_family_that_keys_chain_is_no_product_of_blocks(spark, monkeypatch):
    """Texts of unlike sets that share passages are one family by keys; none of them is sent to pairs of blocks."""
    rng = random.Random(4)
    common = [" ".join(f"c{k}.{i}" for i in range(60)) for k in range(6)]
    rows = [(i, f"{common[i % 6]} {common[(i + 1) % 6]} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))) for i in range(120)]
    rows += [(1000 + i, t + " end") for i, t in rows[:10]]
    asked = []
    real = ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", lambda df, name: asked.append(name) or real(df, name))
    got = {r.doc_id: r.component_id for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, block=2000).collect()}
    assert got == {i: i % 1000 for i, _ in rows}
    assert "bits" in asked and "large" not in asked


def test_keys_take_one_narrow_exchange(spark):
    """A key goes to its part as 8 bytes, once: it used to be shuffled twice, with two columns of 8 bytes."""
    rng = np.random.default_rng(1)
    sigs = [np.sort(rng.integers(0, 2**63, 50_000, dtype=np.uint64)) for _ in range(4)]
    sigs[3][:100] = sigs[0][:100]
    sigs[3].sort()
    rows = [(i << 40, 50_000, x.tobytes(), (np.arange(50_000) % 7).astype("<u2").tobytes()) for i, x in enumerate(sigs)]
    stars = key_stars(spark.createDataFrame(rows, "no long, m long, keys binary, owners binary"), 30_000)
    got = stars.collect()
    assert got and {(r.u >> 40, r.a >> 40) for r in got} == {(3, 0)}
    shuffled = re.findall(r"Exchange hashpartitioning\((.*?)#", stars._jdf.queryExecution().executedPlan().toString())
    assert set(shuffled) == {"part"}
