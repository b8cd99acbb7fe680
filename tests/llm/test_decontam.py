"""Windows found by the prefix filter against a plain search of every window in every text."""

import random
import re

import numpy as np

from lotwise.llm.decontam import Index, decontaminate, find_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(text, items, window):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        b = words(body)
        for at in range(max(1, len(b) - window + 1)) if b else ():
            x = b[at : at + window]
            for p in range(len(w) - len(x) + 1):
                if w[p : p + len(x)] == x:
                    hit.update(range(p, p + len(x)))
                    if item is not None:
                        found.add(str(item))
    return len(w), sorted(hit), sorted(found)


def tables(spark):
    rng = random.Random(5)
    vocab = ["the", "of", "Äpfel", "a1", "x", "Y", "日本", "z9"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 2, 3, 5, 7, 14])))) for i in range(12)] + [(99, None), (98, ""), (97, " .!"), (None, "null id here"), (5, "second row of five"), (5, "second row of five")]
    texts = [None, "", "...", "The NULL-id, here!", "second row of five and more", "the"]
    for _ in range(60):
        body = rng.choices(vocab, k=rng.randrange(0, 40))
        if rng.random() < 0.7:
            at = rng.randrange(len(body) + 1)
            body[at:at] = (rng.choice(items)[1] or "").split()
        texts.append(rng.choice([" ", "\n", ", "]).join(body))
    texts += [texts[-1], "the of " * 5000]
    docs = spark.createDataFrame([(i, t, "e", 0) for i, t in enumerate(texts)] + [(None, "x", "e", 1)], "doc_id long, text string, items string, n_words int")
    return docs, spark.createDataFrame(items, "item_id long, text string"), items


def test_against_plain_search_in_one_block_and_in_many(spark):
    docs, bench, items = tables(spark)
    for block_mb in (16, 0.0002):
        got = find_contamination(docs, bench, window=4, shingle=2, block_mb=block_mb, name="c").collect()
        assert len(got) == docs.count()
        for r in got:
            assert (r.c["n_words"], r.c["hits"], r.c["items"]) == plain(r.text, items, 4), r.text


def test_filter_keeps_columns_and_clean_rows(spark):
    docs, bench, items = tables(spark)
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in docs.collect() if not plain(r.text, items, 10)[1])
    assert decontaminate(docs.limit(0), bench).count() == 0
    assert decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_a_large_benchmark_is_indexed_fast():
    """Some 280,000 windows in seconds, and found again; words that many windows share are no slower."""
    import time

    rng = random.Random(3)
    vocab = [f"w{i}".encode() for i in range(20_000)]
    items = [(str(k), b" ".join(rng.choices(vocab, k=rng.randrange(1, 300)))) for k in range(2000)] + [("same", b"a a a a a a a a a a a a"), ("again", b"a a a a a a a a a a")]
    began = time.time()
    index = Index(items, 10, 5)
    index.order({s: np.ones(len(k), dtype=np.int64) for s, k in index.keys.items()})
    assert time.time() - began < 20 and len(index.begin) > 250_000
    for k in (3, 700):
        words = items[k][1].split()
        hit, found = index.scan([b"x", *words, b"y"])
        assert hit.tolist() == list(range(1, len(words) + 1)) and str(k) in found
    hit, found = index.scan([b"a"] * 20_000)
    assert len(hit) == 20_000 and found == ["again", "same"]
