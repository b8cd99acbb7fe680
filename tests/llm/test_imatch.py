"""Lexicon frequencies, successors and edits against plain loops."""

import hashlib
import random
from collections import Counter

import pytest

from lotwise.llm.imatch import NONE, edited_fingerprints, fingerprint, fingerprints, lexicon, likeness


def corpus(n=120):
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(150)]
    rows = [(i * 7, " ".join(rng.choices(vocab[: 150 if i % 2 else 30], k=rng.randrange(1, 60)))) for i in range(n)]
    return rows + [(10_001, None), (10_002, ""), (10_003, "é日本🙂 w1"), (10_004, "w1 " * 9000)]


def test_lexicon_has_exact_frequencies(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = Counter(w for _, t in rows for w in set((t or "").split()))
    got = lexicon(docs, 0.05, 0.3)
    n = len(rows)
    want = {w.encode() for w, c in counts.items() if max(2, 0.05 * n) <= c <= int(0.3 * n) and w.isascii()}
    assert {w for w in got if w.isascii()} == want


def test_successors_edits_and_likeness(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string")
    terms = lexicon(docs, 0.02, 0.5)
    order = sorted(rows, reverse=True)
    for bucket_mb in (8, 0.001):
        got = {r.doc_id: r for r in edited_fingerprints(docs, 0.02, 0.5, bucket_mb=bucket_mb).collect()}
        assert len(got) == len(rows)
        for k, (i, t) in enumerate(order):
            own, other = t or "", order[(k + 1) % len(order)][1] or ""
            edited = own[: len(own) - len(own) // 3] + other[: len(own) // 3]
            a, b, c = (fingerprint(x.encode(), terms) for x in (own, edited, other))
            r = got[i]
            assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
            assert (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == (a, b, likeness(a, b), likeness(a, c))
    assert sum(r.near_edited for r in got.values()) > 1.5 * sum(r.near_next for r in got.values())
    assert {r.doc_id: r.fingerprint for r in fingerprints(docs, 0.02, 0.5).collect()} == {i: r.fingerprint for i, r in got.items()}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    got = edited_fingerprints(docs).collect()
    assert len(got) == 4 and len({r.fingerprint for r in got if r.n_chars}) == 1
    assert edited_fingerprints(docs.limit(0)).count() == 0
    alone = edited_fingerprints(spark.createDataFrame([(1, "abc def")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0
    with pytest.raises(TypeError):
        edited_fingerprints(spark.createDataFrame([("a", "abc def")], "doc_id string, text string"))
    assert likeness(NONE * 2, NONE * 2) == 1.0 and likeness("1" * 8 + NONE, "1" * 8 + "2" * 8) == 0.5


def test_lexicon_is_the_same_whatever_is_held_and_broadcast(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    want = lexicon(docs, 0.05, 0.3)
    assert want and lexicon(docs, 0.05, 0.3, block=1) == want == lexicon(docs, 0.05, 0.3, room=20)


def test_fingerprints_against_their_definition(spark):
    """Restated: mixed hashes of the band's terms choose subsets, each hashed over its sorted terms."""
    import struct

    import xxhash

    def mixed(x):
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * by % 2**64
        return x ^ x >> 31

    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = Counter(w for _, t in rows for w in set((t or "").replace("🙂", "🙂").split()))
    band = {w for w, c in counts.items() if max(2, 0.05 * len(rows)) <= c <= 0.3 * len(rows)}
    got = {r.doc_id: r.fingerprint for r in fingerprints(docs, 0.05, 0.3).collect()}
    for i, t in rows:
        w = set((t or "").split())
        h = sorted(xxhash.xxh3_64_intdigest(x.encode()) for x in (w & band or w))
        want = ""
        for r, bits in enumerate([0] + [2] * 3 + [4] * 6 + [6] * 10 + [8] * 12):
            part = [x for x in h if not bits or mixed((x + r * 0x9E3779B1 + 1) % 2**64) >> (64 - bits) == 0]
            want += f"{xxhash.xxh32_intdigest(struct.pack(f'<{len(part)}Q', *part), r) or 1:08x}" if part else "0" * 8
        assert got[i] == want
