"""Base scores against plain counts; model scores against a plain tree; the tree as a distribution."""

import functools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lotwise.llm.suffix_tree_lm import DEPTH, EDGE, SuffixTree, positions, saved, score_texts, state


def tokens_of(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)}).split()


def corpus():
    rng = random.Random(6)
    parts = ["ka", "lo", "mi", "tra", "pön", "du", "日"]
    words = lambda n: " ".join("".join(rng.choices(parts, k=rng.randrange(1, 7))) for _ in range(n))
    rows = [(i, words(rng.randrange(0, 60))) for i in range(300)]
    return rows + [(300, None), (301, ""), (None, "ka lo"), (5, "KA lo\tmi"), (302, "ka " * 20000), (303, "ünseen " + "x" * 150)]


def plain_model(texts, gain=8.0, least=1e-3, state_share=0.02, symbol_share=0.01, divergence=0.01):
    """The whole model by plain dictionaries, from the token lists to learn from."""
    counts = Counter(w for t in texts for w in [*t, None])
    spell = lambda w: b" \n" if w is None else b" " + w.encode() + b" "
    after = {}
    for t, c in counts.items():
        s = spell(t)
        for i in range(1, len(s)):
            for d in range(min(i, DEPTH) + 1):
                after.setdefault(s[i - d : i], Counter())[s[i]] += c
    total = sum(after[b""].values())
    after = {k: v for k, v in after.items() if sum(v.values()) >= max(1, math.ceil(least * total))}
    kept = {b""}
    for k, v in after.items():
        if k and k[1:] in after:
            n, up = sum(v.values()), after[k[1:]]
            m = sum(up.values())
            if sum(c * math.log(c / n / (up[x] / m)) for x, c in v.items()) >= gain:
                kept.update(k[i:] for i in range(len(k)))

    @functools.cache
    def letter(k, x):
        below = 1 / 256 if not k else letter(k[1:], x)
        n, kinds = sum(after[k].values()), len(after[k])
        return (after[k][x] + kinds * below) / (n + kinds)

    def letters(s, upto):
        return math.prod(letter(next(s[i - d : i] for d in range(min(i, DEPTH), -1, -1) if s[i - d : i] in kept), s[i]) for i in range(1, upto))

    raw = lambda w: b"\n" if w is None else w.encode()
    n, kinds = sum(counts.values()), len(counts)
    discount = saved(*(sum(c == k for c in counts.values()) for k in (1, 2)))

    @functools.cache
    def u(w):
        return (max(counts[w] - discount, 0) + discount * kinds * letters(spell(w), len(spell(w)))) / n

    # symbols: frequent tokens, or the longest frequent prefix of the others
    need = lambda share: max(1, math.ceil(share * n))
    top = {w for w, c in counts.items() if w is None or c >= need(symbol_share)}
    starts, ends = Counter(), Counter()
    for w, c in counts.items():
        for k in range(1, 4):
            if w is not None and len(raw(w)) >= k:
                ends[raw(w)[-k:]] += c
                if w not in top:
                    starts[raw(w)[:k]] += c
    starts = {p for p, c in starts.items() if c >= need(symbol_share)}
    ends = {p for p, c in ends.items() if c >= need(state_share)}
    prefix = lambda w: next((raw(w)[:k] for k in (3, 2, 1) if len(raw(w)) >= k and raw(w)[:k] in starts), b"")
    symbol = lambda w: (w,) if w in top else prefix(w)
    mass = {(w,): u(w) for w in top}
    for p in {b"", *starts}:
        c = sum(max(x - discount, 0) for w, x in counts.items() if symbol(w) == p)
        t = (letters(b" " + p, len(p) + 1) if p else 1) - sum(letters(b" " + q, len(q) + 1) for q in starts if q[: len(p)] == p and len(q) == len(p) + 1)
        t -= sum(letters(spell(w), len(spell(w))) for w in top if prefix(w) == p)
        mass[p] = (c + discount * kinds * t) / n

    # contexts before tokens: suffixes of the token before, and all of it
    def suffixes(w):
        return [(w,)] * (counts[w] >= need(state_share)) + [raw(w)[-k:] for k in (3, 2, 1) if w is not None and len(raw(w)) >= k and raw(w)[-k:] in ends] + [b""]

    follows = {}
    for t in texts:
        for a, b in zip([None, *t], [*t, None]):
            for k in suffixes(a):
                follows.setdefault(k, Counter())[symbol(b)] += 1
    retained = {b"": None}
    for size in (1, 2, 3, 4):
        for k in [k for k in follows if (4 if isinstance(k, tuple) else len(k)) == size]:
            up = next(x for x in (suffixes(k[0])[1:] if isinstance(k, tuple) else [k[i:] for i in range(1, len(k) + 1)]) if x in retained)
            m, above = sum(follows[k].values()), follows[up]
            told = sum(c / m * math.log(c / m / (above[x] / sum(above.values()))) for x, c in follows[k].items())
            if told >= divergence and m * told >= gain:
                retained[k] = up
    assert len(retained) > 3 and any(isinstance(k, tuple) for k in retained)

    def after_state(k, x):
        if retained[k] is None:
            return mass[x]
        d = saved(*(sum(c == j for c in follows[k].values()) for j in (1, 2)))
        m = sum(follows[k].values())
        return max(follows[k][x] - d, 0) / m + d * len(follows[k]) / m * after_state(retained[k], x)

    def text(words):
        total, seen = 0, Counter()
        for i, (w, before) in enumerate(zip([*words, None], [None, *words])):
            weight = 0.3 * i / (i + 20)
            state = next(k for k in suffixes(before) if k in retained)
            told = after_state(state, symbol(w)) * u(w) / mass[symbol(w)]
            total += math.log10(weight * seen[w] / max(i, 1) + (1 - weight) * told)
            seen[w] += 1
        return total

    assert abs(sum(mass.values()) - 1) < 1e-9
    return text


def test_scores(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in rows + rows[:3]], "doc_id long, text string, score double")
    got = score_texts(docs, least_share=1e-3, head_share=2e-3, state_share=0.02, symbol_share=0.01).collect()
    rows = rows + rows[:3]
    assert len(got) == len(rows)
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts, ends = Counter(), 0
    for i, t in rows:
        if not out(i):
            counts.update(tokens_of(t))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    base = lambda c: math.log10((c + 1) / (n + v + 1))
    score = plain_model([tokens_of(t) for i, t in rows if not out(i)])
    want = sorted((i is None, i or 0, out(i), len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n, round(sum(base(counts[x]) for x in w) + base(ends), 4), round(score(w), 3)) for i, t in rows for w in [tokens_of(t)])
    have = sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 3)) for r in got)
    for a, b in zip(have, want):
        assert a[:6] == b[:6] and a[6:] == pytest.approx(b[6:], rel=1e-4, abs=2e-3)


def test_chunks_of_texts_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in corpus()], "doc_id long, text string")
    once = {r.doc_id: r.score for r in score_texts(docs, head_share=2e-3).collect()}
    import lotwise.llm.suffix_tree_lm as lm

    sizes, ids = np.array([3, 2]), np.array([5, 5, 1, 5, 1])
    place, earlier = lm.seen_before(sizes, ids)
    assert place.tolist() == [0, 1, 2, 0, 1] and earlier.tolist() == [0, 1, 0, 0, 0]
    monkeypatch.setattr(lm, "CHUNK", 4)
    assert list(lm.in_chunks([b"ab", None, b"abcd", b"", b"a"])) == [(0, 3), (3, 5)]
    again = {r.doc_id: r.score for r in score_texts(docs.repartition(3), head_share=2e-3).collect()}
    assert again == pytest.approx(once)


def test_tree_is_a_distribution():
    rng = random.Random(1)
    words = ["".join(rng.choices("abc", k=rng.randrange(1, 6))).encode() for _ in range(400)]
    _, before, packed = positions(words)
    keys = np.concatenate([state(packed[before >= d], d) for d in range(DEPTH + 1)])
    keys, counts = np.unique(keys, return_counts=True)
    tree = SuffixTree.grow(keys, counts, 2.0)
    for context in (b" ", b" a", b" ab", b" abcab", b" zz", b" aazab"):
        p = [int.from_bytes((context + bytes([x]))[-DEPTH - 1 :], "big") for x in range(256)]
        probs = 10 ** tree.symbols(np.full(256, min(len(context), DEPTH)), np.array(p, dtype=np.uint64))
        assert abs(probs.sum() - 1) < 1e-6
    assert EDGE == 0x20


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert score_texts(none).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = score_texts(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0) and row.score < 0
