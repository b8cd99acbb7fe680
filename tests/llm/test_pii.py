"""Base spans against Python's re, disclosing terms against a plain count."""

import math
import random
import re
import time
from collections import defaultdict

from lotwise.llm.pii import KINDS, find_private, sanitise

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in v.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def plain(text):
    out = [(m.start(), r, m.end(), m[0]) for r, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if valid(k, m[0])]
    return sorted(out)


def texts():
    rng = random.Random(3)
    bits = ["a@b.c", "x.y+z@mail-1.example.com", "@", "a@b_c@d.e", "a@b.c@d.e", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "010.000.00255.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111 5", "+1 (555) 123-4567", "+12", "+49 30 1234567 ", "é", "日本", " ", ", ", "word", "9" * 30, "+", "-", ".", "..", "Müller"]
    out = ["".join(rng.choices(bits, k=rng.randrange(0, 14))) for _ in range(300)]
    return [None, "", "7" * 20000, "a" * 20000 + "@", "+1" + " " * 5000, "x@y.z " * 500, *out]


def test_base_spans_as_plain_patterns_give_them(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, base string")
    got = {r.doc_id: [tuple(s) for s in r.base] for r in find_private(docs).collect()}
    for i, t in rows:
        assert got[i] == plain(t), t


def test_terms_that_disclose(spark):
    rng = random.Random(8)
    filler = ["lorem", "ipsum", "dolor", "amet", "elit", "tempor"]
    rows = []
    for i in range(80):
        f = lambda: " ".join(rng.choices(filler, k=12))
        rows.append((i, f"{f()} zorbax contact joe@corp.example now {f()}" if i < 3 else f"{f()} contact p{i}@corp.example {f()}" if i < 30 else f"{f()} contact {f()}"))
    rows += [(80, rows[0][1]), (80, rows[0][1]), (None, None), (81, "zorbax")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = find_private(docs, bits=3.0).collect()
    assert len(got) == len(rows)
    n_t, n_e, n_te, near = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    for i, t in set(rows):
        for w in re.findall(r"[^\W\d_]{4,}", (t or "").lower()):
            n_t[w].add(i)
        spans = plain(t)
        for a, _, b, v in spans:
            n_e[v].add(i)
            for m in re.finditer(r"[^\W\d_]{4,}", t):
                left = m.end() <= a and (m.start() > a - 40 or a <= 40)
                right = m.start() >= b and (m.end() - b < 40 or m.end() - b == 40 == len(t) - b)
                if (left or right) and not any(x < m.end() and y > m.start() for x, _, y, _ in spans):
                    n_te[v, m[0].lower()].add(i)
                    near[i, t].add((m.start(), m.end(), v, m[0].lower()))
    told = {k: len(x) / len(n_t[k[1]]) for k, x in n_te.items() if len(x) >= 2 and len(x) / len(n_t[k[1]]) >= 0.5 and math.log2(len(x) * len(rows) / len(n_t[k[1]]) / len(n_e[k[0]])) >= 3}
    assert {w for _, w in told} == {"zorbax"}
    for r in got:
        text = dict(rows)[r.doc_id]
        want = sorted({(a, KINDS.index("term"), b, "remove" if told[v, w] >= 0.9 else "generalise") for a, b, v, w in near[r.doc_id, text] if (v, w) in told})
        assert [tuple(s) for s in r.terms] == want
    clean = {r.doc_id: r.text for r in sanitise(docs, bits=3.0).collect()}
    assert "[EMAIL]" in clean[0] and "@" not in clean[0] and "zorbax" not in clean[0] and "[TERM]" in clean[0]
    assert clean[None] is None and clean[81] == "zorbax" and clean[79] == rows[79][1]
    assert find_private(docs.limit(0)).count() == 0


def test_entity_in_a_third_of_all_rows(spark):
    rows = [(i, f"some filler {'Zorbax asks joe@corp.example' if i % 3 == 0 else 'asks nobody'} today") for i in range(90)]
    for n in (90, 12):
        got = find_private(spark.createDataFrame(rows[:n], "doc_id long, text string")).collect()
        assert {r.doc_id: [(s.start, s.end, s.value) for s in r.terms] for r in got} == {i: [(12, 18, "remove")] if i % 3 == 0 else [] for i, _ in rows[:n]}
    everywhere = [(i, "Zorbax asks joe@corp.example") for i in range(90)]
    assert all(not r.terms for r in find_private(spark.createDataFrame(everywhere, "doc_id long, text string")).collect())


def test_terms_far_from_their_entity(spark):
    far = "and so on " * 30
    rows = [(i, f"other words {far}") for i in range(400)]
    rows += [(400 + i, f"Dear Zorbax {far} ZORBAX, {far} xéZorbax joe@corp.example zorbax@corp.example") for i in range(4)]
    docs = spark.createDataFrame(rows + [(500, "Zorbax")], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end, s.value) for s in r.terms] for r in find_private(docs).collect()}
    for i, t in rows[400:]:
        want = [(m.start(), m.end()) for m in re.finditer(r"(?<![^\W\d_])(Dear|Zorbax|ZORBAX|xéZorbax)(?![^\W\d_]|@)", t)]
        assert [x[:2] for x in got[i]] == want and len(want) == 4
    assert not any(got[i] for i in [*range(400), 500])


def test_repeated_rows_change_no_spans(spark):
    rows = [(i, f"some filler {'Zorbax asks joe@corp.example' if i % 9 == 0 else 'asks nobody'} today") for i in range(90)] + [(90, "Zorbax alone")]
    spans = lambda x: {(r.doc_id, tuple((s.start, s.end, s.value) for s in r.terms)) for r in find_private(spark.createDataFrame(x, "doc_id long, text string")).collect()}
    once = spans(rows)
    assert sum(bool(t) for _, t in once) == 10
    assert spans(rows + [rows[0]] * 4) == spans(rows + [rows[90]] * 40 + [rows[5]] * 300) == once


def test_many_values_in_one_text_take_linear_work(spark):
    rows = [(1, " ".join(f"Name{i} user{i}@host{i % 7}.example 10.0.{i % 256}.{i % 200}" for i in range(20_000))), (2, "Zorbax joe@corp.example"), (3, "Zorbax joe@corp.example")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    began = time.time()
    got = {r.doc_id: r for r in find_private(docs).collect()}
    took = time.time() - began
    assert [tuple(s) for s in got[1].base] == plain(rows[0][1]) and not got[1].terms
    assert took < 40, took


def test_many_values_and_words_that_documents_share_take_linear_work(spark):
    """Two documents with the same 10,000 addresses and 10,000 words: all words tell of all addresses; and a third with half of each."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    names = sorted({word() for _ in range(10_000)})
    mails = [f"u{i}@host{i % 9}.example" for i in range(10_000)]
    rows = [(i, " ".join(f"{w} {m}" for w, m in zip(names[: 10_000 // (i + 1)], mails))) for i in range(2)] + [(2, " ".join(f"{m} {w}" for w, m in zip(names, mails)))]
    rows += [(10 + i, f"{names[i]} alone, {word()}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    began = time.time()
    got = {r.doc_id: r for r in find_private(docs).collect()}
    took = time.time() - began
    assert took < 60, took
    assert not any(got[i].terms for i in range(10, 310))
    # the first 300 words stand in four documents, three with an entity; the others in three or two
    for i, n in ((0, len(names)), (1, 5000), (2, len(names))):
        values = [s.value for s in got[i].terms]
        assert len(values) == n and values.count("generalise") == 300
