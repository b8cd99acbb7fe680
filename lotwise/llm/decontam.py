"""Benchmark decontamination: a prefix-filtered containment join of item windows and document texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, attach, by_batch, new_name, raw_texts, stored

MIX = 0x9E3779B97F4A7C15


class Index:
    """The windows of one block of items, found by their rarest shingle.

    Words are numbers of this block's vocabulary, so equal numbers are equal words. All items' words stand in one array, and
    a window is a stretch of it: ``begin`` and ``length`` of the distinct windows, the items of window w are ``owners`` from ``bounds[w]`` to
    ``bounds[w + 1]``, as numbers of ``names``. A window is contained where all its shingles are, so one prefix token is
    enough: the shingle that fewest documents hold.
    """

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int, shingle: int):
        self.vocab: dict[bytes, int] = {}
        self.names = sorted({i for i, _ in items if i is not None})
        code = {i: n for n, i in enumerate(self.names)}
        self.shingle = shingle
        words = [[self.vocab.setdefault(w, len(self.vocab)) for w in alnum_words(raw or b"")] for _, raw in items]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        self.stream = np.fromiter((i for w in words for i in w), dtype=np.int32, count=int(sizes.sum()))
        first = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
        owner = np.array([code.get(i, -1) for i, _ in items], dtype=np.int64)
        begin, length, bounds, owners = [], [], [], []
        for size in sorted({min(int(n), window) for n in sizes if n}):
            own = np.flatnonzero((sizes == size) if size < window else (sizes >= window))
            each = sizes[own] - size + 1
            at = np.repeat(first[own] - np.concatenate(([0], np.cumsum(each)[:-1])), each) + np.arange(each.sum())
            rows = np.ascontiguousarray(self.stream[at[:, None] + np.arange(size)]).view(f"V{4 * size}").ravel()
            _, one, which = np.unique(rows, return_index=True, return_inverse=True)
            pairs = np.unique(which.astype(np.int64) * (len(self.names) + 1) + np.repeat(owner[own], each) + 1)  # 0: an item without id
            named = pairs[pairs % (len(self.names) + 1) > 0]
            begin.append(at[one])
            length.append(np.full(len(one), size))
            bounds.append(np.bincount(named // (len(self.names) + 1), minlength=len(one)))
            owners.append(named % (len(self.names) + 1) - 1)
        whole = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.empty(0, dtype=np.int64)
        self.begin, self.length, self.owners = whole(begin), whole(length), whole(owners)
        self.bounds = np.concatenate(([0], np.cumsum(whole(bounds))))
        #: All shingles by their length, and where those of each window stand among them.
        self.keys: dict[int, np.ndarray] = {}
        lengths = np.minimum(self.length, shingle)
        for s in np.unique(lengths).tolist():
            rolled = self.rolled(self.stream, s)
            found = [rolled[self.begin[lengths == s][self.length[lengths == s] == size][:, None] + np.arange(size - s + 1)].ravel() for size in np.unique(self.length[lengths == s]).tolist()]
            self.keys[s] = np.unique(np.concatenate(found))

    @staticmethod
    def rolled(ids: np.ndarray, s: int) -> np.ndarray:
        """A 64-bit key of each s consecutive words; 0 where one is outside the vocabulary."""
        n = len(ids) - s + 1
        key = np.zeros(max(n, 0), dtype=np.uint64)
        if n <= 0:
            return key
        known = np.ones(n, dtype=bool)
        with np.errstate(over="ignore"):
            for j in range(s):
                part = ids[j : j + n]
                known &= part >= 0
                key = (key + part.astype(np.uint64) + np.uint64(1)) * np.uint64(MIX)
                key ^= key >> np.uint64(29)
        key[key == 0] = 1
        key[~known] = 0
        return key

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.vocab.get
        return np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))

    def places(self, ids: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which a shingle of length ``s`` stands, and its number."""
        rolled = self.rolled(ids, s)
        at = np.flatnonzero(rolled)
        if not len(at):
            return at, at
        keys = self.keys[s]
        i = np.minimum(np.searchsorted(keys, rolled[at]), len(keys) - 1)
        hit = keys[i] == rolled[at]
        return at[hit], i[hit]

    def order(self, counts: dict[int, np.ndarray]) -> None:
        """Choose each window's prefix token by rarity, then number, then place; counts: documents with each shingle, by its length."""
        number = np.zeros(len(self.begin), dtype=np.int64)
        self.offset = np.zeros(len(self.begin), dtype=np.int64)
        lengths = np.minimum(self.length, self.shingle)
        for s, keys in self.keys.items():
            rolled = self.rolled(self.stream, s)
            for size in np.unique(self.length[lengths == s]).tolist():
                mine = np.flatnonzero((lengths == s) & (self.length == size))
                numbers = np.searchsorted(keys, rolled[self.begin[mine][:, None] + np.arange(size - s + 1)])
                best = np.argmin(counts[s][numbers] * len(keys) + numbers, axis=1)
                self.offset[mine] = best
                number[mine] = numbers[np.arange(len(mine)), best]
        #: By length: the prefix tokens, and the windows of the i-th from ``starts[i]`` to ``starts[i + 1]``.
        self.postings: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for s in self.keys:
            mine = np.flatnonzero(lengths == s)
            mine = mine[np.argsort(number[mine], kind="stable")]
            rare, starts = np.unique(number[mine], return_index=True)
            self.postings[s] = rare, np.append(starts, len(mine)), mine

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, list[str]]:
        """Positions of words inside a window's occurrence, and the items with such windows in order."""
        ids = self.numbers(words)
        cover = np.zeros(len(ids) + 1, dtype=np.int64)
        met = []
        for s, (rare, starts, windows) in self.postings.items():
            at, number = self.places(ids, s)
            i = np.minimum(np.searchsorted(rare, number), len(rare) - 1)
            keep = rare[i] == number
            at, i = at[keep], i[keep]
            for a in range(0, len(at), 1000):  # places at once
                many = starts[i[a : a + 1000] + 1] - starts[i[a : a + 1000]]
                inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                w = windows[np.repeat(starts[i[a : a + 1000]], many) + inner]
                start = np.repeat(at[a : a + 1000], many) - self.offset[w]
                # positional and length bounds, then exact containment
                fits = (start >= 0) & (start + self.length[w] <= len(ids))
                w, start = w[fits], start[fits]
                for size in np.unique(self.length[w]).tolist():
                    mine = self.length[w] == size
                    along = np.arange(size)
                    same = (ids[start[mine][:, None] + along] == self.stream[self.begin[w[mine]][:, None] + along]).all(axis=1)
                    np.add.at(cover, start[mine][same], 1)
                    np.add.at(cover, start[mine][same] + size, -1)
                    met.append(w[mine][same])
        w = np.unique(np.concatenate(met)) if met else np.empty(0, dtype=np.int64)
        many = self.bounds[w + 1] - self.bounds[w]
        owners = self.owners[np.repeat(self.bounds[w], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        return np.flatnonzero(np.cumsum(cover[:-1])), [self.names[i] for i in np.unique(owners).tolist()]


def shingle_counts(docs: DataFrame, shared: Broadcast, text_col: str) -> dict[int, np.ndarray]:
    """In how many documents each shingle of the block stands, by its length: exact, over all whole texts."""

    def make():
        index: Index = shared.value

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            totals = {s: np.zeros(len(k), dtype=np.int64) for s, k in index.keys.items()}
            for raw in raw_texts(batch.column(0)):
                ids = index.numbers(alnum_words(raw or b""))
                for s, total in totals.items():
                    total[np.unique(index.places(ids, s)[1])] += 1
            some = {s: np.flatnonzero(t) for s, t in totals.items()}
            columns = [np.repeat(np.array([*some], dtype=np.int64), [len(i) for i in some.values()]), np.concatenate([*some.values(), np.empty(0, dtype=np.int64)]), np.concatenate([*(totals[s][i] for s, i in some.items()), np.empty(0, dtype=np.int64)])]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["s", "i", "n"])

        return f

    counted = by_batch(docs.select(text_col), make, "s long, i long, n long").groupBy("s", "i").agg(F.sum("n").alias("n")).toArrow()  # at most one row for each shingle of the block
    s, i, n = (counted.column(c).to_numpy() for c in ("s", "i", "n"))
    out = {size: np.zeros(len(keys), dtype=np.int64) for size, keys in shared.value.keys.items()}
    for size, total in out.items():
        total[i[s == size]] = n[s == size]
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, block_mb: float = 8, name: str = "contamination", id_col: str = "item_id", text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``name``: n_words, hits (positions of hit words), items (ids as strings, sorted).

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Every ``window``
    consecutive words of an item are a window, as is an item of fewer words; a document word
    inside any occurrence of a window is hit. The benchmark's size is measured first: it is split
    by a hash of its ids into blocks of about ``block_mb`` MB of text, and only one block's index
    is broadcast at a time, so a benchmark of any size is scanned whole in bounded memory. Of each block
    but a single one, only the hits are written, with two hashes of the text, and joined to the documents once. Within a block, a first pass counts
    in how many documents each shingle stands; windows are then looked up by their rarest one.

    Null and empty texts have no words. An item with a null id is searched for, and hits count,
    but it is not listed. Repeated items count once, repeated documents each. Empty tables give
    no hits or no rows. Other columns of ``docs`` go through untouched.
    """
    items = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(item_text_col).alias("t"))
    size = items.agg(F.sum(F.octet_length("t")).alias("n")).first().n or 0
    blocks = max(1, -(-size // int(block_mb * 1e6)))
    part = F.pmod(F.xxhash64("i", "t"), F.lit(blocks))
    sc = docs.sparkSession.sparkContext

    def prepared(b: int) -> Broadcast:
        index = Index([(r.i, None if r.t is None else r.t.encode()) for r in items.where(part == b).collect()], window, shingle)
        unordered = sc.broadcast(index)
        index.order(shingle_counts(docs, unordered, text_col))
        unordered.unpersist()
        return sc.broadcast(index)

    def whole(shared: Broadcast):
        def f(raws: list[bytes | None]) -> dict[str, pa.Array]:
            n, hits, found = [], [], []
            for raw in raws:
                words = alnum_words(raw or b"")
                hit, ids = shared.value.scan(words)
                n.append(len(words))
                hits.append(hit)
                found.append(ids)
            return {"n_words": pa.array(n, pa.int64()), "hits": pa.array(hits, pa.list_(pa.int32())), "items": pa.array(found, pa.list_(pa.string()))}

        return lambda: f

    if blocks == 1:
        return attach(docs, name, whole(prepared(0)), "n_words long, hits array<int>, items array<string>", text_col)

    def some(shared: Broadcast):
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            h1, h2, hits, found = [], [], [], []
            for raw in raw_texts(batch.column(0)):
                hit, ids = shared.value.scan(alnum_words(raw or b""))
                if len(hit):
                    a, b = (xxhash.xxh64_intdigest(raw, seed) for seed in (1, 2))
                    h1.append(a - (a >> 63 << 64))
                    h2.append(b - (b >> 63 << 64))
                    hits.append(hit)
                    found.append(ids)
            return pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))], ["h1", "h2", "hits", "items"])

        return lambda: f

    found = None
    for b in range(blocks):
        shared = prepared(b)
        here = stored(by_batch(docs.select(text_col), some(shared), "h1 long, h2 long, hits array<int>, items array<string>").dropDuplicates(["h1", "h2"]), "decontam")
        shared.unpersist()
        found = here if found is None else found.unionByName(here)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    found = found.groupBy("h1", "h2").agg(union("hits").alias("hits"), union("items").alias("items"))

    def measure(raws: list[bytes | None]) -> dict[str, pa.Array]:
        sums = [[xxhash.xxh64_intdigest(raw or b"", seed) for raw in raws] for seed in (1, 2)]
        a, b = (pa.array([x - (x >> 63 << 64) for x in column], pa.int64()) for column in sums)
        return {"n_words": pa.array([len(alnum_words(raw or b"")) for raw in raws], pa.int64()), "h1": a, "h2": b}

    m, h1, h2 = new_name(docs, "_m"), new_name(docs, "_h1"), new_name(docs, "_h2")
    named = found.select(F.col("h1").alias(h1), F.col("h2").alias(h2), F.struct("hits", "items").alias(name))
    out = attach(docs, m, lambda: measure, "n_words long, h1 long, h2 long", text_col).join(named, (F.col(f"{m}.h1") == F.col(h1)) & (F.col(f"{m}.h2") == F.col(h2)), "left")
    none = lambda c, kind: F.coalesce(F.col(f"{name}.{c}"), F.array().cast(kind))
    return out.select(*docs.columns, F.struct(F.col(f"{m}.n_words").alias("n_words"), none("hits", "array<int>").alias("hits"), none("items", "array<string>").alias("items")).alias(name))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with the columns they had."""
    name = new_name(docs, "_contamination")
    return find_contamination(docs, benchmark, window, name=name, **options).where(F.size(f"{name}.hits") == 0).drop(name)
