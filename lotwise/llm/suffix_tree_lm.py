"""Language-model scores from a probabilistic suffix tree: contexts before a corpus's tokens and within them."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from itertools import repeat as always

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, by_task, held_out, plain_words, raw_texts, stored

#: Symbols that no token holds: the start and end of a token, and the end of a text.
EDGE, END = 0x20, 0x0A
ENDING = bytes([END])
DEPTH = 6
#: How much text is read at once.
CHUNK = 4_000_000


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def digests(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """96 bits that stand for each word, as a long and an int: among 10^10 words, two meet with a chance of 1e-9."""
    raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), dtype=np.int32).reshape(-1, 4)
    return np.ascontiguousarray(raw[:, :2]).view(np.int64).ravel(), raw[:, 2].copy()


def positions(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each symbol of each token and its end: the token's number, how many symbols stand before
    it (with the start), and the packed last DEPTH + 1 symbols up to it, the latest lowest."""
    parts = [b" \n" if t == ENDING else b" " + t + b" " for t in tokens]
    data = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint64)
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    owner = np.repeat(np.arange(len(tokens)), sizes)
    before = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    packed = np.zeros(len(data), dtype=np.uint64)
    for d in range(DEPTH + 1):
        if d < len(data):
            packed[d:] |= data[: len(data) - d] << np.uint64(8 * d)
    keep = before > 0
    return owner[keep], np.minimum(before[keep], DEPTH), packed[keep]


def state(packed: np.ndarray, d: int) -> np.ndarray:
    """The key of a context and the symbol after it: depth, d symbols, symbol."""
    return (packed & np.uint64((1 << 8 * (d + 1)) - 1)) | np.uint64(d << 56)


@dataclass
class SuffixTree:
    """Retained contexts (sorted keys, depth on top) with the weight of their suffix, and smoothed
    probabilities of the symbols seen after each."""

    contexts: np.ndarray
    backoff: np.ndarray
    pairs: np.ndarray
    prob: np.ndarray

    @staticmethod
    def grow(keys: np.ndarray, counts: np.ndarray, gain: float) -> SuffixTree:
        """From the counts of (context, symbol) of all frequent contexts.

        A context is retained when its next-symbol distribution diverges from that of its longest
        proper suffix: count * KL >= ``gain`` nats. Ancestors of retained contexts stay, too, so that a
        missing symbol's mass goes down one suffix at a time. Distributions are smoothed with the
        suffix's by Witten and Bell's weights, at the root with the uniform one.
        """
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(float)
        table: dict[int, tuple[int, int]] = {}
        ctx = keys >> np.uint64(8)
        cuts = np.concatenate((np.flatnonzero(np.diff(ctx, prepend=ctx[:1] + np.uint64(1))), [len(ctx)])) if len(ctx) else np.array([0])
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            table[int(ctx[a])] = (a, b)
        syms = (keys & np.uint64(255)).astype(np.int64)

        def parent(key: int) -> int:
            d = key >> 48
            return (d - 1) << 48 | key & (1 << 8 * (d - 1)) - 1

        wanted: set[int] = {0} & table.keys()
        for key in sorted(table, reverse=True):  # the deepest first
            if key in wanted or not key >> 48:
                continue
            a, b = table[key]
            up = table.get(parent(key))
            if up is None:
                continue
            n = counts[a:b].sum()
            there = np.zeros(256)
            there[syms[up[0] : up[1]]] = counts[up[0] : up[1]]
            p, q = counts[a:b] / n, there[syms[a:b]] / there.sum()
            if n * float((p * np.log(p / q)).sum()) >= gain:
                while key and key not in wanted and key in table:
                    wanted.add(key)
                    key = parent(key)
        contexts, backoff, pairs, prob = [], [], [], []
        full: dict[int, np.ndarray] = {}
        for key in sorted(wanted):  # the shallowest first: the depth is on top
            a, b = table[key]
            below = np.full(256, 1 / 256) if not key else full[parent(key)]
            n, kinds = counts[a:b].sum(), b - a
            own = below * (kinds / (n + kinds))
            own[syms[a:b]] += counts[a:b] / (n + kinds)
            full[key] = own.astype(np.float32) if key else own
            contexts.append(key)
            backoff.append(kinds / (n + kinds))
            pairs.append(keys[a:b])
            prob.append(own[syms[a:b]])
        none = np.empty(0)
        return SuffixTree(np.array(contexts, dtype=np.uint64), np.log10(np.array(backoff)) if backoff else none, np.concatenate(pairs) if pairs else none.astype(np.uint64), np.log10(np.concatenate(prob)) if prob else none)

    def symbols(self, before: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol after its longest retained suffix."""
        out = np.zeros(len(packed))
        depth = np.full(len(packed), -1)
        spot = np.zeros(len(packed), dtype=np.int64)
        for d in range(DEPTH, -1, -1):  # longest suffix state
            todo = np.flatnonzero((depth < 0) & (before >= d))
            if len(todo) and len(self.contexts):
                key = state(packed[todo], d) >> np.uint64(8)
                i = np.minimum(np.searchsorted(self.contexts, key), len(self.contexts) - 1)
                hit = self.contexts[i] == key
                depth[todo[hit]], spot[todo[hit]] = d, i[hit]
        left = np.flatnonzero(depth >= 0)
        out[depth < 0] = -math.log10(256)
        for d in range(DEPTH, -1, -1):
            here = left[depth[left] == d]
            if not len(here):
                continue
            key = state(packed[here], d)
            i = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            hit = self.pairs[i] == key
            out[here[hit]] += self.prob[i[hit]]
            miss = here[~hit]
            out[miss] += self.backoff[spot[miss]]
            depth[here[hit]] = -1
            if d == 0:
                out[miss] -= math.log10(256)
            else:  # the suffix is retained as well
                depth[miss] = d - 1
                spot[miss] = np.searchsorted(self.contexts, state(packed[miss], d - 1) >> np.uint64(8))
        return out

    def tokens(self, tokens: list[bytes]) -> np.ndarray:
        """log10 probability of each whole token: its symbols and its end."""
        if not tokens:
            return np.zeros(0)
        owner, before, packed = positions(tokens)
        return np.bincount(owner, self.symbols(before, packed), minlength=len(tokens))


@dataclass
class Tables:
    """What a task needs to know of the frequent tokens: all of bounded size.

    ``words`` are the head tokens, END first. ``symbols`` and ``states`` give each one's symbol and the state after
    it; every other token has the symbol of its longest prefix in ``prefixes`` and the state of
    its longest suffix in ``suffixes``, 0 if none is there.
    """

    words: list[bytes]
    symbols: np.ndarray
    states: np.ndarray
    prefixes: dict[bytes, int]
    suffixes: dict[bytes, int]
    n_symbols: int
    n_states: int
    known: np.ndarray = field(default_factory=lambda: np.zeros(0))
    base: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: log10 of each head token's probability, and of what a state makes of a symbol's.
    own: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ratio: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))


def longest(table: dict[bytes, int], parts: list[bytes]) -> int:
    return next((n for x in parts if (n := table.get(x)) is not None), 0)


def longest_prefixes(table: dict[bytes, int], words: list[bytes]) -> np.ndarray:
    """``longest`` of many words; a number of 0 has only 0 for its shorter parts."""
    get = table.get
    return np.array([get(w[:3]) or get(w[:2]) or get(w[:1]) or 0 for w in words], dtype=np.int64)


def longest_suffixes(table: dict[bytes, int], words: list[bytes]) -> np.ndarray:
    get = table.get
    return np.array([get(w[-3:]) or get(w[-2:]) or get(w[-1:]) or 0 for w in words], dtype=np.int64)


def prefixes_of(w: bytes) -> list[bytes]:
    return [w[:k] for k in (3, 2, 1) if len(w) >= k]


def suffixes_of(w: bytes) -> list[bytes]:
    return [w[-k:] for k in (3, 2, 1) if len(w) >= k]


class Reader:
    """Texts as arrays of token numbers, symbols and states."""

    def __init__(self, tables: Tables):
        self.tables = tables
        self.number = {w: i for i, w in enumerate(tables.words)}

    def read(self, raws: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Sizes of the texts (with END), token numbers (those beyond the head count up in the list
        that follows), symbols, and the states before them."""
        t, words, sizes = self.tables, [], []
        for raw in raws:
            before = len(words)
            words += plain_words(raw or b"")
            words.append(ENDING)
            sizes.append(len(words) - before)
        ids = np.fromiter(map(self.number.get, words, always(-1)), dtype=np.int64, count=len(words))
        rest: dict[bytes, int] = {}
        beyond = np.flatnonzero(ids < 0)
        ids[beyond] = [rest.setdefault(words[i], len(rest)) + len(t.words) for i in beyond.tolist()]
        tail = list(rest)
        symbols = np.concatenate((t.symbols, longest_prefixes(t.prefixes, tail)))
        states = np.concatenate((t.states, longest_suffixes(t.suffixes, tail)))
        sizes = np.array(sizes, dtype=np.int64)
        before = np.empty(len(ids), dtype=np.int64)
        before[1:] = states[ids[:-1]]
        before[np.cumsum(sizes) - sizes] = t.states[0]
        return sizes, ids, tail, symbols[ids], before


def in_chunks(raws: list[bytes | None]):
    """(from, to) of runs of texts of about CHUNK bytes."""
    start = held = 0
    for i, raw in enumerate(raws):
        held += len(raw or b"")
        if held >= CHUNK:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(raws):
        yield start, len(raws)


def seen_before(sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token its place in its text and how often it stands earlier there."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    n = len(ids)
    key = (owner * (int(ids.max(initial=0)) + 1) + ids) * n + np.arange(n)
    key.sort()
    key, order = np.divmod(key, n)
    first = np.concatenate(([True], np.diff(key) != 0))[:n]
    rank = np.arange(n)
    earlier = np.empty(n, dtype=np.int64)
    earlier[order] = rank - np.maximum.accumulate(np.where(first, rank, 0))
    return at, earlier


def token_counts(rows: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(token, c): every token of every text, and how often it and END stand in the rows to learn from.

    Each task sends a row for each of its distinct tokens, so a token in every document is a row for each task.
    """

    def make():
        counts: Counter = Counter()

        def flush():
            tokens = list(counts)
            for at in range(0, len(tokens), 100_000):
                part = tokens[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([counts[t] for t in part], pa.int64())], ["token", "n"])
            counts.clear()

        def add(batch: pa.RecordBatch):
            for raw, out in zip(raw_texts(batch.column("text")), batch.column("held_out").to_pylist()):
                words = plain_words(raw or b"")
                if out:
                    for w in set(words):
                        counts.setdefault(w, 0)
                else:
                    counts.update(words)
                    counts[ENDING] += 1
                if len(counts) > most:
                    yield from flush()

        return add, flush

    found = by_task(rows.select("text", "held_out"), make, "token binary, n long")
    return found.repartition("token").groupBy("token").agg(F.sum("n").alias("c"))


def learn(tokens: DataFrame, gain: float = 8.0, least_share: float = 1e-5, most: int = 4_000_000) -> SuffixTree:
    """The suffix tree of all tokens with their counts.

    Every occurrence of every context of up to DEPTH symbols is counted. Only contexts that make up
    ``least_share`` of all symbols or more can be retained, so there are at most (DEPTH + 1) /
    least_share, whatever the corpus: that bounds what comes to the driver and goes to the tasks.
    """

    def make():
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merge():
            nonlocal size
            keys, sums = np.concatenate([k for k, _ in held]), np.concatenate([s for _, s in held])
            keys, where = np.unique(keys, return_inverse=True)
            held[:] = [(keys, np.bincount(where, sums).astype(np.int64))]
            size = len(keys)

        def flush():
            nonlocal size
            if held:
                merge()
                for at in range(0, size, 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(as_long(held[0][0][at : at + 100_000])), pa.array(held[0][1][at : at + 100_000])], ["key", "n"])
                held.clear()
                size = 0

        def add(batch: pa.RecordBatch):
            nonlocal size
            owner, before, packed = positions(batch.column("token").to_pylist())
            weight = batch.column("c").to_numpy()[owner]
            for d in range(DEPTH + 1):
                some = before >= d
                keys, where = np.unique(state(packed[some], d), return_inverse=True)
                held.append((keys, np.bincount(where, weight[some]).astype(np.int64)))
                size += len(keys)
            if size > most:
                merge()
                if size > most // 2:
                    yield from flush()

        return add, flush

    found = by_task(tokens.where("c > 0").select("token", "c"), make, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = stored(found, "contexts")
    context = F.shiftrightunsigned("key", 8)
    sums = found.groupBy(context.alias("context")).agg(F.sum("n").alias("total"))
    all_ = found.where(F.shiftrightunsigned("key", 56) == 0).agg(F.sum("n").alias("n")).first().n or 0
    kept = found.join(sums.where(F.col("total") >= max(1, math.ceil(least_share * all_))), context == F.col("context"), "left_semi")
    table = kept.select("key", "n").toArrow()  # bounded, see above
    return SuffixTree.grow(table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy(), gain)


def saved(n1: float, n2: float) -> float:
    """The discount of seen counts, from how many were seen once and twice."""
    return min(0.95, max(0.1, n1 / max(1, n1 + 2 * n2)))


class Spelling:
    """log10 probabilities of tokens without regard to what stands before them.

    A token has ((c - d)+ + d V t) / N: c of its N tokens, V distinct ones, and its probability t
    in the tree of spellings; just t where nothing was learned.
    """

    def __init__(self, tree: SuffixTree, n: int, kinds: int, discount: float):
        self.tree, self.n, self.kinds, self.discount = tree, n, kinds, discount

    def spelled(self, words: list[bytes]) -> np.ndarray:
        return self.tree.tokens(words)

    def begun(self, prefixes: list[bytes]) -> np.ndarray:
        """log10 probability that a token begins so."""
        if not prefixes:
            return np.zeros(0)
        owner, before, packed = positions(prefixes)
        inner = np.concatenate((np.diff(owner) == 0, [False]))  # all but each one's end
        return np.bincount(owner[inner], self.tree.symbols(before[inner], packed[inner]), minlength=len(prefixes))

    def of(self, c: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        if not self.n:
            return spelled
        with np.errstate(divide="ignore"):
            # in logs, as a long unseen token's spelling may be too unlikely for a double
            return np.logaddexp(np.log(np.maximum(c - self.discount, 0)), spelled * math.log(10) + math.log(self.discount * self.kinds)) / math.log(10) - math.log10(self.n)


def frequent_parts(tokens: DataFrame, need_state: int, need_symbol: int) -> tuple[dict[bytes, tuple[int, int]], set[bytes]]:
    """Prefixes of one to three bytes that ``need_symbol`` occurrences or more of tokens with fewer occurrences each have, with their
    occurrences and distinct tokens, and suffixes that ``need_state`` occurrences or more have. END has neither."""
    part = lambda kind, k, cut: F.when((F.length("token") >= k) & (F.lit(kind == "s") | (F.col("c") < need_symbol)), F.struct(F.lit(kind).alias("kind"), cut.alias("part")))
    parts = F.array(*[part("p", k, F.substring("token", 1, k)) for k in (1, 2, 3)], *[part("s", k, F.substring("token", -k, k)) for k in (1, 2, 3)])
    rows = tokens.where((F.col("c") > 0) & (F.col("token") != F.lit(ENDING))).select("c", F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("x"))
    sums = rows.groupBy("x.kind", "x.part").agg(F.sum("c").alias("c"), F.count("*").alias("kinds"))
    kept = sums.where(F.col("c") >= F.when(F.col("kind") == "p", need_symbol).otherwise(need_state)).collect()  # at most three for each 1 / share
    return {bytes(r.part): (r.c, r.kinds) for r in kept if r.kind == "p"}, {bytes(r.part) for r in kept if r.kind == "s"}


def symbol_masses(model: Spelling, top: list[bytes], spelled_top: np.ndarray, prefixes: dict[bytes, tuple[int, int]], c_rest: int, kinds_rest: int) -> tuple[dict[bytes, int], np.ndarray]:
    """Numbers of the prefix symbols (0 is that of tokens with none of these prefixes) and their probabilities.

    Such a symbol stands for all tokens whose longest prefix it is and that aren't in ``top``, seen or not.
    """
    names = sorted(prefixes, key=lambda p: (len(p), p))
    number = {p: i + 1 for i, p in enumerate(names)}
    every = np.array([[c_rest, kinds_rest, 1.0], *[[*prefixes[p], 10**x] for p, x in zip(names, model.begun(names))]], dtype=float)
    own = every.copy()
    for p in names:  # what has a longer prefix is no part of the shorter one's symbol
        own[longest(number, prefixes_of(p)[1:])] -= every[number[p]]
    for w, x in zip(top, spelled_top):
        own[longest(number, prefixes_of(w)), 2] -= 10**x
    c, kinds, t = own.T
    t = np.maximum(t, 1e-15 * every[:, 2])
    return number, (c - model.discount * kinds + model.discount * model.kinds * t) / model.n if model.n else t


def retain(counts: np.ndarray, parents: np.ndarray, masses: np.ndarray, divergence: float, gain: float) -> tuple[np.ndarray, np.ndarray]:
    """The retained state of each context before tokens (0: the root), and what each state makes of a symbol's
    probability, in log10.

    ``counts`` are those of symbols after contexts, each where it is the longest; shorter ones come first and get the counts of
    what they end. A context is retained if what follows diverges from what follows its longest
    retained suffix by ``divergence`` nats an occurrence or more and ``gain`` nats at all. Its
    distribution is smoothed with that of this suffix by absolute discounts.
    """
    full = counts.astype(float)
    for i in range(len(full) - 1, 0, -1):
        full[parents[i]] += full[i]
    state, rows, probability = np.zeros(len(full), dtype=np.int64), [np.zeros(len(masses))], {0: masses}
    source = {0: 0}  # of each state, the context
    for i in range(1, len(full)):
        up = int(state[parents[i]])
        state[i] = up
        n = full[i].sum()
        some = np.flatnonzero(full[i])
        if not n:
            continue
        above = full[source[up]]
        p, q = full[i, some] / n, above[some] / above.sum()
        told = float((p * np.log(p / q)).sum())
        if told >= divergence and n * told >= gain:
            d = saved((full[i] == 1).sum(), (full[i] == 2).sum())
            own = np.maximum(full[i] - d, 0) / n + d * len(some) / n * probability[up]
            state[i] = len(rows)
            source[len(rows)], probability[len(rows)] = i, own
            rows.append(np.log10(own / masses))
    return state, np.array(rows)


def score_texts(docs: DataFrame, parts: int = 7, at: int = 2, gain: float = 8.0, least_share: float = 1e-5, head_share: float = 2**-18, state_share: float = 2**-10, symbol_share: float = 2**-11, divergence: float = 0.01, repeat: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A unigram base score and the model's score of every whole text.

    Tokens are runs of anything but white space, A-Z lower-cased, then one end of text. Rows whose
    id's crc32 modulo ``parts`` is ``at`` are held out of all counts. Returns the id, held_out,
    n_tokens (with the end), n_known (tokens seen in learning), train_tokens (N), base_score, the
    sum of log10((c + 1) / (N + V + 1)), and score, the model's log10 probability of the text.

    The model is a suffix tree with contexts before tokens and within them.

    * Without regard to what stands before it, token w has u(w) = ((c - d)+ + d V t) / N; t is the probability of its
      spelling, each letter and the end predicted from the longest retained suffix of what stands before it in the token (``learn``).
    * Tokens are dealt into symbols: each with ``symbol_share`` of all occurrences is one, the others go by the longest
      of their first one to three bytes that has that share. A symbol's u(x) is the sum of its tokens', seen or not.
    * Contexts are the last one to three bytes of the token before and that whole token, if ``state_share`` of all
      tokens follow it. Each symbol's occurrences after each context are counted; a context is retained by the divergence of these from
      its longest retained suffix's and smoothed by them (``retain``). After the longest retained suffix s,
      w has P(x | s) u(w) / u(x).
    * That is mixed with the token's share of the same text's tokens so far, with a weight that grows to ``repeat``.

    Each of these sums to 1 over all tokens and the end.

    Token counts cover all rows to learn from and stay distributed. Tokens with ``head_share`` of all occurrences, at
    most 1 / head_share, are broadcast with the matrix of at most (4 / state_share) x (4 / symbol_share)
    transitions. A first scan counts tokens, a second one transitions, a third one scores all but the rarer tokens: these
    are written with the partial sums, joined by 96 bits of a hash and added up.
    None of them has more than head_share of all occurrences, so no key is hot, and no text is shuffled.

    Null and empty texts are just the end. A null id counts as '' for crc32. Repeated rows are
    rows of their own; an empty table gives none; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", held_out(F.col("doc_id"), parts, at))
    sc = docs.sparkSession.sparkContext
    tokens = stored(token_counts(rows), "tokens")
    sums = tokens.agg(F.sum("c").alias("n"), *[F.count_if(x).alias(k) for k, x in (("v", F.col("c") > 0), ("n1", F.col("c") == 1), ("n2", F.col("c") == 2))]).first()
    n_all, kinds = sums.n or 0, sums.v
    need = lambda share: max(1, math.ceil(share * n_all))
    spelling = Spelling(learn(tokens, gain, least_share), n_all, kinds, saved(sums.n1, sums.n2))
    is_head = (F.col("c") >= need(head_share)) | (F.col("token") == F.lit(ENDING))
    held = {bytes(r.token): r.c for r in tokens.where(is_head).collect()}  # at most 1 / head_share, and END
    words = [ENDING, *sorted(held.keys() - {ENDING}, key=lambda w: (-held[w], w))]
    c = np.array([held.get(w, 0) for w in words], dtype=np.int64)
    spelled = spelling.spelled(words)
    own = spelling.of(c, spelled)

    n_top = 1 + int((c[1:] >= need(symbol_share)).sum())
    prefixes, suffixes = frequent_parts(tokens, need(state_share), need(symbol_share))
    rest = tokens.where((F.col("c") > 0) & (F.col("c") < need(symbol_share)) & (F.col("token") != F.lit(ENDING))).agg(F.sum("c").alias("c"), F.count("*").alias("kinds")).first()
    begin, masses = symbol_masses(spelling, words[:n_top], spelled[:n_top], prefixes, rest.c or 0, rest.kinds)
    masses = np.concatenate((masses, 10 ** own[:n_top]))
    symbols = np.array([len(begin) + 1 + i if i < n_top else longest(begin, prefixes_of(w)) for i, w in enumerate(words)], dtype=np.int64)
    end = {s: i + 1 for i, s in enumerate(sorted(suffixes, key=lambda s: (len(s), s)))}
    whole = [i for i in range(len(words)) if c[i] >= need(state_share)]
    contexts = np.array([longest(end, suffixes_of(w)) if i else 0 for i, w in enumerate(words)], dtype=np.int64)
    parents = np.array([0, *[longest(end, suffixes_of(s)[1:]) for s in end], *contexts[whole]], dtype=np.int64)
    contexts[whole] = 1 + len(end) + np.arange(len(whole))
    model = Tables(words, symbols, contexts, begin, end, len(masses), len(parents))
    counting = sc.broadcast(model)

    def follow():
        t: Tables = counting.value
        reader, seen = Reader(t), np.zeros(t.n_states * t.n_symbols, dtype=np.int64)

        def add(batch: pa.RecordBatch):
            raws = raw_texts(batch.column("text"))
            for a, b in in_chunks(raws):
                _, _, _, symbol, state = reader.read(raws[a:b])
                np.add.at(seen, state * t.n_symbols + symbol, 1)
            return iter(())

        def finish():
            some = np.flatnonzero(seen)
            for a in range(0, len(some), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(some[a : a + 100_000]), pa.array(seen[some[a : a + 100_000]])], ["k", "n"])

        return add, finish

    followed = by_task(rows.where("not held_out").select("text"), follow, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # bounded, see above
    transitions = np.zeros((len(parents), len(masses)), dtype=np.int64)
    transitions.reshape(-1)[followed.column("k").to_numpy()] = followed.column("n").to_numpy()
    retained, ratio = retain(transitions, parents, masses, divergence, gain)
    model.states, model.suffixes = retained[contexts], {s: int(retained[i]) for s, i in end.items()}
    model.known, model.base, model.own, model.ratio = c > 0, np.log10((c + 1) / (n_all + kinds + 1)), own, ratio
    unseen = -math.log10(n_all + kinds + 1)
    scoring, tree = sc.broadcast(model), sc.broadcast(spelling)

    def score():
        t: Tables = scoring.value
        reader, head = Reader(t), len(t.words)

        def part(raws: list[bytes | None]) -> tuple:
            sizes, ids, tail, symbol, state = reader.read(raws)
            place, earlier = seen_before(sizes, ids)
            weight = repeat * place / (place + 20)
            again = weight * earlier / np.maximum(place, 1)
            mixed = np.log10(1 - weight) + t.ratio[state, symbol]
            rare = ids >= head
            known = np.where(rare, 0, ids)
            told = np.where(rare, mixed, mixed + t.own[known])
            both = np.flatnonzero((again > 0) & ~rare)
            told[both] = np.logaddexp(np.log(again[both]), told[both] * math.log(10)) / math.log(10)
            starts = np.cumsum(sizes) - sizes
            total = lambda x: np.add.reduceat(x, starts)
            hashes, more = digests(tail)
            n_rare = total(rare.astype(np.int64))
            lists = pa.StructArray.from_arrays([pa.array(hashes[ids[rare] - head]), pa.array(more[ids[rare] - head]), pa.array((again[rare] * 10 ** -mixed[rare]).astype(np.float32))], ["h", "g", "r"])
            return sizes, total(np.where(rare, False, t.known[known]).astype(np.int64)), total(np.where(rare, unseen, t.base[known])), total(told), n_rare, lists

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            raws = raw_texts(batch.column("text"))
            done = [part(raws[a:b]) for a, b in in_chunks(raws)]
            columns = [np.concatenate([x[i] for x in done]) for i in range(5)]
            offsets = np.concatenate(([0], np.cumsum(columns[4]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays([x[5] for x in done]))
            return pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("row", "doc_id", "held_out")), *map(pa.array, columns[:4]), lists], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"])

        return f

    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    scored = stored(by_batch(numbered, score, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<h: long, g: int, r: float>>"), "scored")

    def rare():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, model = batch.column("token").to_pylist(), tree.value
            h, g = digests(words)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), batch.column("c"), pa.array(model.of(batch.column("c").to_numpy(), model.spelled(words)))], ["h", "g", "c", "u"])

        return f

    told = by_batch(tokens.where(~is_head), rare, "h long, g int, c long, u double")
    asked = scored.select("row", F.explode("rare").alias("x")).select("row", "x.h", "x.g", F.col("x.r").cast("double").alias("r"))
    each = asked.join(told, ["h", "g"]).select("row", "c", F.when(F.col("r") > 0, F.log10(F.col("r") + F.pow(F.lit(10.0), F.col("u")))).otherwise(F.col("u")).alias("s"))
    more = each.repartition("row").groupBy("row").agg(F.count_if(F.col("c") > 0).alias("k"), F.sum(F.log10(F.col("c") + 1.0)).alias("b"), F.sum("s").alias("s"))
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    out = scored.drop("rare").join(more, "row", "left")
    return out.select(F.col("doc_id").alias(id_col), "held_out", "n_tokens", plus("n_known", "k").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), plus("base", "b").alias("base_score"), plus("score", "s").alias("score"))
