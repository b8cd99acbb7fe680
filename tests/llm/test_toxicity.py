"""The automata against edit distances, and held-out accuracy with quotations, misspellings and stems."""

import math
import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pytest import approx

from lotwise.llm import toxicity
from lotwise.llm.queries import op3_toxicity
from lotwise.llm.toxicity import ADDRESS, REPORTING, Lexicon, Model, drop_toxic, fit, in_quotes, score_toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def one_edit(a, b):
    return distance(a, b) == 1 or any(a[:i] + a[i + 1] + a[i] + a[i + 2 :] == b != a for i in range(len(a) - 1))


WORDS = {"abcde": 3.0, "abcab": 2.0, "bbbbb": 4.0, "ab": 5.0, "cabcab": 1.0}


@settings(max_examples=400, deadline=None)
@given(st.text("abcd", max_size=8))
def test_automata_give_edit_distance_one(word):
    want = None
    if word in WORDS:
        want = ("exact", WORDS[word])
    elif word.startswith("dada"):
        want = ("stem", 9.0)
    elif near := [w for t, w in WORDS.items() if len(t) >= 5 and one_edit(t, word)]:
        want = ("fuzzy", max(near))
    assert Lexicon(WORDS, {"dada": 9.0}).match(word) == want


def test_quotes():
    assert in_quotes('they said "you fool" then', 15, 19)
    assert not in_quotes('"yes" you fool "no', 10, 14)
    assert in_quotes("er rief „Narr“ laut", 9, 13)


def corpus():
    rng = random.Random(4)
    filler = ["river", "stone", "walks", "green", "table", "window", "quiet", "seven", "lantern", "paper"]
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(filler, k=40)
        toxic = int(i % 3 == 0)
        if toxic:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(["grobnik", "snarfel", "vexu" + rng.choice(["lo", "mi", "tra", "pos"])])
        elif i % 3 == 1 and i % 2:
            words[10] = '"grobnik"'
            words[9] = "said"
        rows.append((i, " ".join(words), toxic))
        labels.append((i, toxic))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus()
    extra = [(1000, None, 0), (1001, "", 0), (None, "river", 0), (1002, "grobnikk snarfl grobnik " * 3000, 1), (1003, "grobmik you snarfell", 1), (0, rows[0][1], 1)]
    docs = spark.createDataFrame([(a, b, "c") for a, b, _ in rows + extra], "doc_id long, text string, toxic string")
    table = spark.createDataFrame(labels + [(None, 1), (3, None), (0, 1)], "doc_id long, toxic int")
    model = fit(docs, table)
    got = score_toxicity(docs, model, "score").collect()
    assert len(got) == len(rows) + len(extra)
    truth = {a: c for a, _, c in rows + extra}
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id is None or r.doc_id >= 1000 or zlib.crc32(str(r.doc_id).encode()) % 4 == 2:
            assert (r.score >= 0.3) == truth[r.doc_id], (r.doc_id, r.score, r.text)
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {a for a, c in truth.items() if not c}


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = fit(docs, none)
    assert isinstance(model, Model) and len({r.s for r in score_toxicity(docs, model, "s").collect()}) == 1
    assert score_toxicity(docs.limit(0), model, "s").count() == 0


def plain_words(text):
    return [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]


def plain_quoted(text, a, b):
    before, after = text[:a].rpartition("\n")[2], text[b:].partition("\n")[0]
    if before.count('"') % 2 and '"' in after:
        return True
    return any(o in before and before.rfind(o) > before.rfind(c) and c in after for o, c in zip("“„«", "”“»"))


def plain_hit(word, words, stems, innocent=()):
    if word in words:
        return "exact", words[word]
    if began := [w for s, w in stems.items() if word.startswith(s)]:
        return "stem", max(began)
    if word not in innocent and (near := [w for t, w in words.items() if len(t) >= 5 and one_edit(t, word)]):
        return "fuzzy", max(near)
    return None


def plain_features(text, words, stems, innocent=(), straight=None):
    spans = plain_words(text)
    met = [(k, hit) for k, (_, _, w) in enumerate(spans) if (hit := plain_hit(w, words, stems, innocent))]
    if not met:
        return [1.0] + [0.0] * 6
    direct, quoted, addressed = [], [], 0
    for k, hit in met:
        near = {w for _, _, w in spans[max(0, k - 8) : k + 9]}
        told = plain_quoted(text, *spans[k][:2]) or near & REPORTING
        (quoted if told else direct).append(hit[1])
        addressed += bool(near & ADDRESS)
        if straight is not None and not told and hit[0] == "fuzzy":
            straight.add(spans[k][2])
    fuzzy = sum(hit[0] == "fuzzy" for _, hit in met)
    return [1.0, math.log1p(sum(direct)), math.log1p(sum(quoted)), max(direct, default=0) / 10, math.log1p(100 * len(met) / len(spans)), math.log1p(fuzzy), math.log1p(addressed)]


def plain_model(rows, labels):
    """Lexicon, stems and innocent words of labelled rows, by loops; and these rows."""
    known = Counter()
    for i, label in labels:
        if i is not None and label is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            known[i] = max(known[i], label)
    train = Counter()
    for i, text, _ in rows:
        if i in known:
            train[text] = max(train[text], known[i])
    n = Counter(label > 0 for label in train.values())
    by = {False: Counter(), True: Counter()}
    for text, label in train.items():
        found = {w for _, _, w in plain_words(text)}
        by[label > 0].update({(w, True) for w in found} | {(w[:k], False) for w in found for k in range(4, 9) if k < len(w)})
    weights, shown = {}, {}
    rate = n[True] / len(train)
    need = max(4.0, math.log(max(1, sum(by[True][t] + by[False][t] >= 3 for t in {*by[True], *by[False]})) / 2.0))
    for t, bad in by[True].items():
        good = by[False][t]
        weights[t] = math.log((bad + 0.5) / (n[True] + 1)) - math.log((good + 0.5) / (n[False] + 1))
        surprise = bad * math.log(bad / (bad + good) / rate) + (good * math.log(good / (bad + good) / (1 - rate)) if good else 0)
        shown[t] = weights[t] >= 1 and surprise >= need
    words = {t: weights[t, True] for t, whole in weights if whole and shown[t, True]}
    stems = {}
    for t in sorted((t for t, whole in weights if not whole and shown[t, False]), key=len):
        widest = max([by[True][w, True] for w in words if w.startswith(t) and w != t], default=1)
        if by[True][t, False] >= 2 * widest:
            stems[t] = weights[t, False]
    stems = {t: w for t, w in stems.items() if not any(t != s and t.startswith(s) for s in stems)}
    used = {False: Counter(), True: Counter()}
    for text, label in train.items():
        straight = set()
        plain_features(text, words, stems, straight=straight)
        used[label > 0].update(straight)
    innocent = set()
    for w, good in used[False].items():
        toxic = 1 / (1 + (n[False] + 0.5) / (n[True] + 0.5) * math.exp(-plain_hit(w, words, stems)[1]))
        if used[True][w] * math.log(toxic / rate) + good * math.log((1 - toxic) / (1 - rate)) < 0:
            innocent.add(w)
    return words, stems, innocent, train


def test_query_against_loops(spark, tmp_path):
    """The whole query: lexicon, innocent words and features by loops, and weights that no step betters."""
    rows, labels = corpus()
    rng = random.Random(9)
    for i in range(600, 760):  # misspelt, swapped, quoted, and clean words a letter off
        words = rng.choices(["river", "stone", "harbour", "snarfed", "seven", "You"], k=25)
        toxic = i % 2
        if toxic:
            words[rng.randrange(25)] = rng.choice(["grobnki", "snarfell", "grobnik", "SNARFEL"])
            words[rng.randrange(25)] = "snarfel"
        elif i % 3 == 0:
            words[5:5] = rng.choice(["„ grobnik “", "« snarfel »", "“x snarfel”", '" grobnik "', "\n“ snarfel\n”"]).split(" ")
        else:
            words[3] = "snarfed"
        rows.append((i, " ".join(words), toxic))
        labels.append((i, toxic))
    rows += [(900, None, 0), (901, "", 0), (902, "grobnik " * 500, 1), (0, rows[0][1], 1)]
    labels += [(900, 0), (901, 0), (0, 1), (None, 1), (5, None)]
    spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    words, stems, innocent, train = plain_model(rows, labels)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert model.words == approx(words) and model.stems == approx(stems) and model.innocent == innocent
    assert words and stems
    x = [plain_features(t, words, stems, innocent) for t in train]
    dot = lambda f: sum(a * b for a, b in zip(f, model.coefficients))
    off = [1 / (1 + math.exp(-dot(f))) - (label > 0) for f, label in zip(x, train.values())]
    for j, c in enumerate(model.coefficients):  # the penalised likelihood is flat there
        assert abs(sum(e * f[j] for e, f in zip(off, x)) + 0.01 * c) < 1e-4
    got = op3_toxicity(spark, str(tmp_path)).collect()
    want = sorted((i, 1 / (1 + math.exp(-dot(plain_features(t, words, stems, innocent))))) for i, t, _ in rows)
    assert sorted((r.doc_id, r.score) for r in got) == [(i, approx(s, abs=1e-9)) for i, s in want]
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3)


def test_a_full_memo_changes_no_score(monkeypatch):
    """What is kept of words is cleared when it is full, in the midst of a text as well."""
    model = Model({"idiot": 3.0, "moron": 2.0}, {}, coefficients=(-1.0, 1.0, 0.5, 1.0, 0.1, 0.1, 0.1))
    texts = [b"you idiot and moron " + b" ".join(b"word%d" % (i + j) for j in range(20)) for i in range(30)]
    want = [model.scorer().score(t) for t in texts]
    for most in (1, 2, 3, 7, 30):
        monkeypatch.setattr(toxicity, "MEMO", most)
        scorer = model.scorer()
        assert [scorer.score(t) for t in texts] == want
