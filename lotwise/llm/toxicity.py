"""Toxicity: a learned lexicon in a trie, met by Levenshtein automata, and scores of the context of each hit."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, attach, by_batch, drop_stored, held_out, id_text, new_name, raw_texts, stored

#: Marks that open and close a quotation, words that report one, and words of address.
OPENING, CLOSING = '"“„«', '"”“»'
REPORTING = frozenset("said says wrote writes called quote quoted quoting reported told sagte schrieb nannte dit disait dijo escribió llamó".split())
ADDRESS = frozenset("you your yours youre du dich dir ihr tu te toi vous tú usted ustedes vosotros".split())
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
MEMO = 400_000


class Node:
    """A trie node: the weight of the word that ends here, that of a stem, and whether edits can pay below."""

    __slots__ = ("children", "edits", "stem", "weight")

    def __init__(self):
        self.children: dict[str, int] = {}
        self.weight = self.stem = 0.0
        self.edits = 0


class Lexicon:
    """The product of the trie and Levenshtein automata, built state by state as words come.

    A state is the set of (trie node, edits so far) that the letters read so far can reach. Reading a
    letter follows the edge of that letter, or spends an edit on a substitution, an extra letter,
    a missing one or two swapped neighbours; the first of these waits in the node after both, with
    2 + the code of the second for its edits. As the states are kept, a word costs one look-up for each letter, and most
    words fall out of the trie within a few.
    """

    def __init__(self, words: dict[str, float], stems: dict[str, float], edit_length: int = 5):
        self.nodes = [Node()]
        for table, whole in ((words, True), (stems, False)):
            for term, weight in table.items():
                at = 0
                path = [0]
                for c in term:
                    nxt = self.nodes[at].children.get(c)
                    if nxt is None:
                        self.nodes.append(Node())
                        nxt = self.nodes[at].children[c] = len(self.nodes) - 1
                    at = nxt
                    path.append(at)
                if whole:
                    self.nodes[at].weight = weight
                    if len(term) >= edit_length:
                        for p in path:
                            self.nodes[p].edits = 1
                else:
                    self.nodes[at].stem = weight
        self.edit_length = edit_length
        self.depth = [0] * len(self.nodes)
        for i, n in enumerate(self.nodes):  # children come after their parents
            for c in n.children.values():
                self.depth[c] = self.depth[i] + 1
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.number: dict[tuple[tuple[int, int], ...], int] = {}
        self.next: list[dict[str, int]] = []
        self.verdict: list[tuple[float, float, float]] = []
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        """The number of the state, its missing-letter moves taken; -1 for none."""
        todo = list(pairs)
        while todo:
            i, e = todo.pop()
            if e < self.nodes[i].edits:
                for c in self.nodes[i].children.values():
                    if self.nodes[c].edits and (c, e + 1) not in pairs:
                        pairs.add((c, e + 1))
                        todo.append((c, e + 1))
        key = tuple(sorted(pairs))
        if not key:
            return -1
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
            exact = max((self.nodes[i].weight for i, e in key if e == 0), default=0.0)
            fuzzy = max((self.nodes[i].weight for i, e in key if e == 1 and self.depth[i] >= self.edit_length), default=0.0)
            stem = max((self.nodes[i].stem for i, e in key if e == 0), default=0.0)
            self.verdict.append((exact, fuzzy, stem))
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        pairs = set()
        for i, e in self.states[state]:
            n = self.nodes[i]
            if e > 1:
                if c == chr(e - 2):
                    pairs.add((i, 1))
                continue
            if c in n.children and (e == 0 or self.nodes[n.children[c]].edits):
                pairs.add((n.children[c], e))
            if e < n.edits:
                pairs.add((i, e + 1))
                pairs.update((x, e + 1) for x in n.children.values() if self.nodes[x].edits)
                for d, x in n.children.items():
                    swapped = self.nodes[x].children.get(c)
                    if d != c and swapped is not None and self.nodes[swapped].edits:
                        pairs.add((swapped, 2 + ord(d)))
        out = self.next[state][c] = self._state(pairs)
        return out

    def match(self, word: str) -> tuple[str, float] | None:
        """How the word meets the lexicon: ("exact" | "stem" | "fuzzy", weight), or None."""
        state, best = self.start, 0.0
        for c in word:
            nxt = self.next[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
            if state < 0:
                return ("stem", best) if best else None
            best = max(best, self.verdict[state][2])
        exact, fuzzy, _ = self.verdict[state]
        if exact:
            return "exact", exact
        if best:
            return "stem", best
        return ("fuzzy", fuzzy) if fuzzy else None


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    innocent: frozenset[str] = frozenset()
    edit_length: int = 5
    coefficients: tuple[float, ...] = ()

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """A task's working copy of a model, with the automata's states and the words seen so far."""

    def __init__(self, model: Model):
        self.model = model
        self.lexicon = Lexicon(model.words, model.stems, model.edit_length)
        self.seen: dict[bytes, tuple[str, float] | None] = {}

    def look_up(self, word: bytes) -> tuple[str, float] | None:
        if word in self.seen:
            return self.seen[word]
        if len(self.seen) >= MEMO:
            self.seen.clear()
        text = word.decode()
        hit = self.lexicon.match(text)
        if hit and hit[0] == "fuzzy" and text in self.model.innocent:
            hit = None
        self.seen[word] = hit
        return hit

    def hits(self, words: list[bytes]) -> list[bytes]:
        return [w for w in set(words) if self.look_up(w) is not None]

    def features(self, raw: bytes | None, reach: int = 8, straight: set[str] | None = None) -> np.ndarray:
        """Of a whole text: weights of direct and of quoted hits, the strongest, how dense, misspelled, addressed.
        Words of direct hits are added to ``straight``."""
        out = np.zeros(7)
        out[0] = 1.0
        words = alnum_words(raw or b"")
        found = self.hits(words)
        if not found:
            return out
        wanted = {w.decode(): self.look_up(w) for w in found}  # what is kept may have been cleared since
        text = (raw or b"").decode().translate(LOWER)
        spans = [(m.start(), m.end(), m[0]) for m in WORD.finditer(text)]
        quotes = Quotes(text)
        direct = quoted = strongest = fuzzy = addressed = 0.0
        count = 0
        for i, (a, b, w) in enumerate(spans):
            hit = wanted.get(w)
            if hit is None:
                continue
            count += 1
            near = {x for _, _, x in spans[max(0, i - reach) : i + reach + 1]}
            if quotes.around(a, b) or near & REPORTING:
                quoted += hit[1]
            else:
                if straight is not None:
                    straight.add(w)
                direct += hit[1]
                strongest = max(strongest, hit[1])
            fuzzy += hit[0] == "fuzzy"
            addressed += bool(near & ADDRESS)
        out[1:] = math.log1p(direct), math.log1p(quoted), strongest / 10, math.log1p(100 * count / len(spans)), math.log1p(fuzzy), math.log1p(addressed)
        return out

    def score(self, raw: bytes | None) -> float:
        z = float(np.dot(self.features(raw), self.model.coefficients))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


class Quotes:
    """Where quotations open and close in a text."""

    def __init__(self, text: str):
        self.places = {c: [m.start() for m in re.finditer(c, text)] for c in {*OPENING, *CLOSING, "\n"}}

    def last(self, c: str, before: int) -> int:
        i = bisect_left(self.places[c], before)
        return self.places[c][i - 1] if i else -1

    def around(self, a: int, b: int) -> bool:
        """Whether a quotation opens before ``a`` and closes after ``b``, in the same line."""
        start = self.last("\n", a)
        i = bisect_left(self.places["\n"], b)
        stop = self.places["\n"][i] if i < len(self.places["\n"]) else math.inf
        for o, c in zip(OPENING, CLOSING):
            closing = self.places[c]
            j = bisect_left(closing, b)
            if j == len(closing) or closing[j] >= stop:
                continue
            if o == c:
                if (bisect_left(closing, a) - bisect_left(closing, start)) % 2 == 1:
                    return True
            elif self.last(o, a) > max(start, self.last(c, a)):
                return True
        return False


def in_quotes(text: str, a: int, b: int) -> bool:
    """Whether a quotation opens before ``a`` and closes after ``b``, in the same line."""
    return Quotes(text).around(a, b)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Coefficients by Newton's method with a little ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + (ridge + 1e-6) * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, by_chance: float = 2.0, odds: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn lexicon and weights from labelled rows that aren't held out.

    At most ``max_rows`` labelled rows are learned from, those with the smallest hash of the id; this
    bound is what makes their ids fit in a broadcast and their features in the driver. Equal texts
    count once. Terms and stems (prefixes of four letters or more that several toxic words share)
    enter the lexicon if their log odds ratio is ``odds`` or more and the binomial evidence that
    they prefer toxic texts is so strong that chance would give it to ``by_chance`` of all terms
    in three texts or more; ``max_rows`` bounds how many these can be. Words a letter off are no
    misspellings if the clean and toxic texts that hold them, as direct hits, are likelier for any word than for the lexicon's word.
    Labels with a null id or label don't count; a document labelled twice is toxic if either
    label says so. Without rows of both classes, the model has no lexicon and gives the smoothed share of toxic rows.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col(id_col), 4, 2)).groupBy(F.col(id_col).alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    train = stored(id_text(docs, id_col, text_col).join(F.broadcast(sample), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")), "train")

    def count():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            by: tuple[Counter, Counter] = Counter(), Counter()
            n = [0, 0]
            for label, raw in zip(batch.column("toxic").to_pylist(), raw_texts(batch.column("text"))):
                words = set(alnum_words(raw or b""))
                texts = [w.decode() for w in words]
                by[label > 0].update({w + "$" for w in texts} | {w[:k] for w in texts for k in range(4, min(len(w), 9))})
                n[label > 0] += 1
            terms = list(by[0].keys() | by[1].keys()) + [""]
            by[0][""], by[1][""] = n
            return pa.RecordBatch.from_arrays([pa.array(terms), pa.array([by[1][t] for t in terms], pa.int64()), pa.array([by[0][t] for t in terms], pa.int64())], ["term", "bad", "good"])

        return f

    counts = stored(by_batch(train, count, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "terms")
    totals = counts.where("term = ''").first()
    bad, good = (totals.bad, totals.good) if totals else (0, 0)
    prior = math.log((bad + 0.5) / (good + 0.5))
    if not bad or not good:
        drop_stored(train)
        drop_stored(counts)
        return Model(coefficients=(prior, *[0.0] * 6))
    weight = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    n, rate = F.col("bad") + F.col("good"), bad / (bad + good)
    share = F.col("bad") / n
    surprise = n * (share * F.log(share / rate) + (1 - share) * F.when(share < 1, F.log((1 - share) / (1 - rate))).otherwise(0))
    evidence = max(4.0, math.log(max(1, counts.where((F.col("term") != "") & (n >= 3)).count()) / by_chance))
    best = counts.where((F.col("term") != "") & (F.col("bad") > 0)).withColumn("w", weight).where((F.col("w") >= odds) & (surprise >= evidence)).orderBy(F.desc("bad"), "term").collect()
    words = {r.term[:-1]: r.w for r in best if r.term.endswith("$")}
    widest = Counter()
    for r in best:
        if r.term.endswith("$"):
            for k in range(4, len(r.term)):
                widest[r.term[:k]] = max(widest[r.term[:k]], r.bad)
    stems = {r.term: r.w for r in best if not r.term.endswith("$") and r.bad >= 2 * max(1, widest[r.term])}
    stems = {s: w for s, w in stems.items() if not any(s[:k] in stems for k in range(4, len(s)))}
    model = Model(words, stems)

    # words that are a letter off a lexicon word, but stand where any word does
    def direct():
        scorer = model.scorer()

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            found: tuple[Counter, Counter] = Counter(), Counter()
            for label, raw in zip(batch.column("toxic").to_pylist(), raw_texts(batch.column("text"))):
                straight: set[str] = set()
                scorer.features(raw, straight=straight)
                found[label > 0].update(w for w in straight if scorer.look_up(w.encode())[0] == "fuzzy")
            words = list(found[0].keys() | found[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([found[i][w] for w in words], pa.int64()) for i in (1, 0))], ["w", "bad", "good"])

        return f

    used = by_batch(train, direct, "w string, bad long, good long").groupBy("w").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    look_up, told = model.scorer().look_up, []
    for r in used.where("good > 0").collect():  # words of the labelled rows that are a letter off
        toxic = 1 / (1 + math.exp(-prior - look_up(r.w.encode())[1]))  # how many of the lexicon word's texts are
        if r.bad * math.log(toxic / rate) + r.good * math.log((1 - toxic) / (1 - rate)) < 0:
            told.append(r.w)
    model.innocent = frozenset(told)

    def measure():
        scorer = model.scorer()

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [scorer.features(raw).tolist() for raw in raw_texts(batch.column("text"))]
            return pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "x"])

        return f

    seen = by_batch(train, measure, "toxic int, x array<double>").groupBy("toxic", "x").count().collect()  # bounded by max_rows
    drop_stored(train)
    drop_stored(counts)
    x = np.repeat(np.array([r.x for r in seen]), [r["count"] for r in seen], axis=0)
    y = np.repeat(np.array([float(r.toxic > 0) for r in seen]), [r["count"] for r in seen])
    order = np.lexsort((*x.T, y))  # the same sums in the same order in each run
    model.coefficients = tuple(logistic(x[order], y[order]).tolist())
    return model


def score_toxicity(docs: DataFrame, model: Model, name: str = "toxicity", text_col: str = "text") -> DataFrame:
    """``docs`` with a double ``name``: the probability that a whole text is toxic.

    Lexicon hits are found exactly, by stem, or one edit off (two swapped neighbours are one edit); each counts as direct or, within quotation
    marks or near a reporting word, as quoted. Only the text decides: ids, labels and other
    columns don't. Null and empty texts have no hits and get the score of such texts. The model
    (bounded by ``fit``'s parameters) goes to the tasks with the function; there is no shuffle.
    """
    inner = new_name(docs, "_toxicity")

    def make():
        scorer = model.scorer()
        return lambda raws: {"score": pa.array([scorer.score(r) for r in raws], pa.float64())}

    return attach(docs, inner, make, "score double", text_col).withColumn(name, F.col(f"{inner}.score")).drop(inner)


def drop_toxic(docs: DataFrame, model: Model, at: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``at``, with the columns they had."""
    name = new_name(docs, "_score")
    return score_toxicity(docs, model, name, text_col).where(F.col(name) < at).drop(name)
