"""The conversation trie against a plain model over whole sequences."""

import hashlib
import random
import zlib

from lotwise.llm import prefix_trie
from lotwise.llm.prefix_trie import branched_trie, conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, digest string, depth int"


def sequences(rows):
    out = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def rebuilt(seqs):
    out = {}
    for c, own in seqs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = seqs.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + own[h:]
    return out


def plain(seqs):
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    out = set()
    for node, m in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(k[: len(n)] == n and len(k) == len(n) + 1 for k in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(m), len(node), parent, len(m), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def told(spark, rows, f):
    got = f(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()
    assert len(set(got)) == len(got)
    return {tuple(r) for r in got}


def some(seed, convs, longest=6):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(rng.randrange(1, longest)):
            rows.append((c, t, rng.choice(["user", "system", None]), rng.choice(["a", "é", "bb", "", None])))
    rng.shuffle(rows)
    return rows


def test_plain_trie(spark):
    rows = some(1, range(70)) + [(500, None, "user", "a"), (500, None, "user", "a"), (500, 1, "x", "y"), (500, 1, "x", "b"), (None, 1, "user", "lost")]
    assert told(spark, rows, conversation_trie) == plain(sequences(rows))


def test_branches(spark):
    rows = some(2, [*range(90, 230), *range(-130, -95), 1234, 99_999_999_999])
    assert told(spark, rows, branched_trie) == plain(rebuilt(sequences(rows)))


def test_turnless_conversations_are_members_of_the_root(spark):
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows = [(c, 0, "user", "gone")]  # without a base, h > its turns
    assert told(spark, rows, branched_trie) == {(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())}


def test_long_conversations_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "RANGE", 20)
    rng = random.Random(3)
    base = [("user", rng.choice("abc")) for _ in range(43)]
    rows = []
    for c, (keep, more) in enumerate([(43, 0), (43, 0), (43, 7), (20, 9), (20, 9), (8, 0), (9, 3), (4, 4), (5, 30)]):
        turns = base[:keep] + [("user", f"{c}-{i}" if c != 4 else f"3-{i}") for i in range(more)]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    rng.shuffle(rows)
    assert told(spark, rows, conversation_trie) == plain(sequences(rows))
    assert told(spark, rows, branched_trie) == plain(rebuilt(sequences(rows)))


def test_copies_and_ends(spark):
    """Many conversations that end at one node, in several runs of ids."""
    rows = [(c, t, "user", "same") for c in range(0, 9000, 3) for t in range(2)]
    ids = ",".join(map(str, range(0, 9000, 3)))
    got = {r[1]: r for r in told(spark, rows, conversation_trie)}
    assert got[2] == (0, 2, 0, 3000, 0, 1, 2999 * 4, hashlib.sha256(ids.encode()).hexdigest())
    assert got[0] == (0, 0, None, 3000, 1, 1, 2 * 2999 * 4, hashlib.sha256(b"").hexdigest())


def test_empty_table(spark):
    assert told(spark, [], conversation_trie) == set()
    assert told(spark, [(None, 1, "a", "b")], branched_trie) == set()
