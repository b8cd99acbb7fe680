"""Fuzzy repeated passages: shared word k-mers, collinear chains by a Fenwick tree, and alignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, alnum_words, by_batch, raw_texts, stored
from .ngram_join import mix

C1 = np.uint64(0x9E3779B97F4A7C15)
C1_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def sliding(f: np.ufunc, x: np.ndarray, w: int) -> np.ndarray:
    """``f`` over each ``w`` neighbours."""
    out, width = x, 1
    while width < w:
        step = min(width, w - width)
        out = f(out[:-step], out[step:])
        width += step
    return out


def minima(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes that are smallest in some ``window`` neighbouring ones, and their places; of a run of equal ones the first."""
    w = min(window, len(h))
    lows = sliding(np.minimum, h, w)
    ends = np.zeros(w - 1, dtype=np.uint64)
    chosen = h == sliding(np.maximum, np.concatenate((ends, lows, ends)), w)
    chosen[1:] &= h[1:] != h[:-1]
    at = np.flatnonzero(chosen)
    return h[at], at


def rolled(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all ``size`` words in a row, from one running sum: polynomials of the words' hashes."""
    n = len(words)
    if n < size:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        up, down = (np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(n, c)))) for c in (C1, C1_INVERSE))
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(words.astype(np.uint64)) * down[:n])))
        return mix((sums[size:] - sums[: n - size + 1]) * up[: n - size + 1])


def kmers(words: np.ndarray, k: int) -> np.ndarray:
    n = max(0, len(words) - k + 1)
    h = words[:n].copy()
    for j in range(1, k if n else 1):
        h *= C1
        h += words[j : j + n]
    return mix(h)


def seeds(words: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the k-mers that are smallest in some ``window`` neighbouring ones.

    So two texts that share ``k + window - 1`` words in a row share a seed. Of a run of equal
    k-mers only the first counts.
    """
    h = kmers(words, k)
    return minima(h, window) if len(h) else (h, np.empty(0, dtype=np.int64))


def first_minima(h: np.ndarray, window: int) -> np.ndarray:
    """The place of the smallest hash in each ``window`` neighbouring ones, the first of equal ones."""
    out, width = np.arange(len(h)), 1
    while width < window:
        step = min(width, window - width)
        left, right = out[:-step], out[step:]
        out = np.where(h[right] < h[left], right, left)
        width += step
    return out


def told_windows(words: np.ndarray, k: int, window: int, size: int, at: np.ndarray, origin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At which places ``size`` words in a row start that can stand elsewhere: those whose seeds all
    have the same ``origin`` (numbers from 0; one for each seed match ``at`` a place), that origin, and those whose seeds don't.

    The seeds of ``size`` words are the smallest k-mers of every ``window`` neighbouring ones within them, so they
    depend on these words only. Words with a k-mer directly after an equal one count with the second kind.
    """
    n = len(words) - size + 1
    h = kmers(words, k)
    code = np.full(len(h), -1)
    code[at] = origin
    again = np.concatenate(([False], h[1:] == h[:-1]))
    reach = size - k + 1
    low = first_minima(h, window)
    told, within = code[low], reach - window
    low_again = again[low]
    count = lambda flags, width: np.concatenate(([0], np.cumsum(flags)))[width:] - np.concatenate(([0], np.cumsum(flags)))[: len(flags) - width + 1]
    equal = count(again[1:], reach - 1)[:n] > 0
    unknown = count((told < 0) & ~low_again, within + 1)[:n] > 0
    mixed = count(told[1:] != told[:-1], within)[:n] > 0 if within else np.zeros(n, dtype=bool)
    one = np.flatnonzero(~unknown & ~mixed & ~equal)
    return one, told[one], np.flatnonzero(~unknown & (mixed | equal))


def chains(points: list[tuple[int, int]], k: int, gap: float, most_gap: int) -> list[list[tuple[int, int]]]:
    """Collinear chains of seed matches (place here, place there), the best first; each match is in one.

    A match adds ``k``; going from one to the next costs ``gap`` for each word between on either side.
    As that cost is linear, a Fenwick tree over the places there gives each match its best
    predecessor with smaller places on both sides. Chains are cut at gaps of more than ``most_gap`` words.
    """
    points = sorted(set(points))
    out = []
    if len({p - q for p, q in points}) == 1:  # all on one diagonal: the order is the chain
        found = [points]
    else:
        spots = {q: i + 1 for i, q in enumerate(sorted({q for _, q in points}))}
        size = len(spots)
        tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (size + 1)
        score, before = [0.0] * len(points), [-1] * len(points)
        waiting: list[int] = []  # matches at the same place here can't precede each other
        for j, (p, q) in enumerate(points):
            if waiting and points[waiting[0]][0] < p:
                for w in waiting:
                    value, i = (score[w] + gap * sum(points[w]), w), spots[points[w][1]]
                    while i <= size:
                        if tree[i] < value:
                            tree[i] = value
                        i += i & -i
                waiting = []
            best, i = (float("-inf"), -1), spots[q] - 1
            while i > 0:
                best = max(best, tree[i])
                i -= i & -i
            gained = best[0] - gap * (p + q)
            score[j] = k + max(0.0, gained)
            if gained > 0:
                before[j] = best[1]
            waiting.append(j)
        used, found = [False] * len(points), []
        for j in sorted(range(len(points)), key=lambda j: -score[j]):
            chain = []
            while j >= 0 and not used[j]:
                used[j] = True
                chain.append(points[j])
                j = before[j]
            if chain:
                found.append(chain[::-1])
    for chain in found:
        cut = 0
        for i in range(1, len(chain) + 1):
            if i == len(chain) or max(chain[i][0] - chain[i - 1][0], chain[i][1] - chain[i - 1][1]) > most_gap:
                out.append(chain[cut:i])
                cut = i
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Words that an alignment of two short stretches matches (longest common subsequence)."""
    if len(a) == len(b) and (a == b).all():
        return len(a)
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for x in a:
        row = np.maximum.accumulate(np.maximum(row, np.concatenate(([0], row[:-1] + (b == x)))))
    return int(row[-1])


def reach(a: np.ndarray, b: np.ndarray, drop: int = 4) -> tuple[int, int]:
    """How far two stretches match from their start: +1 for a match, -1 for a mismatch, until ``drop`` below the best."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    same = a[:n] == b[:n]
    score = np.cumsum(np.where(same, 1, -1))
    low = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score >= drop)
    end = int(low[0]) if len(low) else n
    if not end or score[:end].max() <= 0:
        return 0, 0
    best = int(np.argmax(score[:end])) + 1
    return best, int(same[:best].sum())


def align(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int]], k: int) -> tuple[int, int, int, int, int]:
    """Start and end here, start and end there, and matched words of a chain, stretches between seeds aligned and both ends extended."""
    (p, q), matched = chain[0], 0
    left, m = reach(a[:p][::-1], b[:q][::-1])
    start, start_b, matched = p - left, q - left, m
    i, j = p, q
    for x, y in chain:
        d = max(i - x, j - y, 0)
        if d >= k:
            continue
        matched += common(a[i : x + d], b[j : y + d]) + k - d
        i, j = x + k, y + k
    right, m = reach(a[i:], b[j:])
    return start, i + right, start_b, j + right, matched + m


def runs(x: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the runs of consecutive numbers."""
    if not len(x):
        return []
    cuts = np.flatnonzero(np.diff(x) != 1) + 1
    return [(int(part[0]), int(part[-1]) + 1) for part in np.split(x, cuts)]


class Passages:
    """What is done with one text and the matches of its seeds, and then with the text that they lead to."""

    def __init__(self, k: int, window: int, gap: float, most_gap: int, least_words: int, identity: float, margin: int):
        self.k, self.window, self.gap, self.most_gap, self.least, self.identity, self.margin = k, window, gap, most_gap, least_words, identity, margin
        self.hashes = WordHashes()
        self.last: tuple[int | None, np.ndarray] = None, np.empty(0, dtype=np.uint32)

    def here(self, key: int, raw: bytes | None, source: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[list[tuple], tuple[np.ndarray, np.ndarray]]:
        """For each text to compare with: its key, a chain's places here and there (none: just a check), from where on and which
        words go along, and runs (from, to, how far it is off there) of windows to be checked; and windows to be matched by themselves."""
        words = self.hashes.of(alnum_words(raw or b""))
        brief = words.astype(np.uint32)
        off = q - p
        order = np.lexsort((source, off, p))
        p, off, source = p[order], off[order], source[order]
        fresh = np.concatenate(([True], (np.diff(p) != 0) | (np.diff(off) != 0) | (np.diff(source) != 0)))
        p, off, source = p[fresh], off[fresh], source[fresh]
        checks: dict[int, list[tuple[int, int, int]]] = {}
        lone, h = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        if len(words) >= self.least:
            keys, code = np.unique(source, return_inverse=True)
            same, number = np.unique((code << 32) + off, return_inverse=True)
            first = np.concatenate(([True], p[1:] != p[:-1]))  # a seed leads to one place
            told, origin, lone = told_windows(words, self.k, self.window, self.least, p[first], number[first])
            for c in np.unique(origin).tolist():
                some = np.flatnonzero(number == c)[0]
                to, shift = int(source[some]), int(off[some])
                if to != key or shift:
                    checks.setdefault(to, []).extend((a, b, shift) for a, b in runs(told[origin == c]))
            if len(lone):
                h = rolled(brief, self.least)[lone]
        out = []
        for to in np.unique(source).tolist():
            mine = (source == to) & ((off != 0) if to == key else True)
            waiting = checks.get(to, [])
            for c in chains(list(zip(p[mine].tolist(), (p + off)[mine].tolist())), self.k, self.gap, self.most_gap) if mine.any() else ():
                if len(c) > 1 and c[-1][0] - c[0][0] + self.k + 2 * self.window >= self.least:
                    begin, stop = max(0, c[0][0] - self.margin), c[-1][0] + self.k + self.margin
                    inside = [x for x in waiting if begin <= x[0] and x[1] + self.least - 1 <= stop]
                    waiting = [x for x in waiting if x not in inside]
                    out.append((to, [x for x, _ in c], [y for _, y in c], begin, brief[begin:stop].tobytes(), inside))
            out += [(to, [], [], a, brief[a : b + self.least - 1].tobytes(), [(a, b, shift)]) for a, b, shift in waiting]
        return out, (h, lone)

    def equal(self, a: np.ndarray, b: np.ndarray, i: int, j: int, shift: int, begin: int) -> np.ndarray:
        """Whether the windows from ``i`` to before ``j`` stand ``shift`` words on in ``b``; ``a`` starts at ``begin``."""
        other = b[max(0, i + shift) : max(0, j + self.least - 1 + shift)]
        mine = a[i - begin : j + self.least - 1 - begin]
        same = np.zeros(len(mine), dtype=bool)
        lead = max(0, -(i + shift))
        same[lead : lead + len(other)] = mine[lead : lead + len(other)] == other
        sums = np.concatenate(([0], np.cumsum(~same)))
        return sums[self.least :] == sums[: -self.least]

    def there(self, source: int, raw: bytes | None, ps: list[int], qs: list[int], begin: int, data: bytes, checks: list[tuple[int, int, int]]) -> tuple[tuple | None, list[int], tuple[np.ndarray, np.ndarray]]:
        """The passage that a chain leads to, if it is one, with runs (from, to) of windows that stand there
        exactly; and windows that should stand there and don't."""
        if self.last[0] != source:
            self.last = source, self.hashes.of(alnum_words(raw or b"")).astype(np.uint32)
        a, b = np.frombuffer(data, dtype=np.uint32), self.last[1]
        found, exact, lost = None, [], [np.empty(0, dtype=np.int64)]
        for i, j, shift in checks:
            lost.append(i + np.flatnonzero(~self.equal(a, b, i, j, shift, begin)))
        if ps:
            back = max(0, qs[0] - self.margin)
            s, e, t, u, m = align(a, b[back : qs[-1] + self.k + self.margin], [(x - begin, y - back) for x, y in zip(ps, qs)], self.k)
            share = m / max(e - s, u - t)
            if e - s >= self.least and share >= self.identity:
                found = (s + begin, e + begin, t + back, u + back, m, share)
                for shift in {y - x for x, y in zip(ps, qs)}:
                    if e - s >= self.least:
                        exact += [x + s + begin for run in runs(np.flatnonzero(self.equal(a, b, s + begin, e + begin - self.least + 1, shift, begin))) for x in run]
        at = np.concatenate(lost)
        return found, exact, (rolled(a, self.least)[at - begin] if len(at) else np.empty(0, dtype=np.uint64), at)


def stars(places: DataFrame, name: str, *more: str, only: str = "true") -> DataFrame:
    """Each occurrence (key, p) of what ``name`` holds with the smallest one (source, q), where there are two or more; those with ``only``."""
    firsts = places.groupBy(name).agg(F.min(F.struct("key", "p", *more)).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select(name, F.col("first.key").alias("source"), F.col("first.p").alias("q"), *[F.col(f"first.{c}").alias(f"source_{c}") for c in more])
    return places.where(only).join(firsts, name).drop(name)


def repeated_passages(docs: DataFrame, k: int = 6, window: int = 16, gap: float = 0.1, most_gap: int = 60, least_words: int = 40, identity: float = 0.75, margin: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of ``least_words`` words or more that stand, with few changes, in another place.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Each text is sampled
    for seeds (see ``seeds``). A seed's first occurrence is its smallest by a hash of the document; every
    other occurrence is matched with it, never with each other, so a passage in a third of all documents costs a row for each
    of them. The matches of two documents are chained (see ``chains``) and the chains aligned
    on the words of both texts; what has ``identity`` matched words for each word of the longer side
    is a passage. It ends ``margin`` words past the chain's outer seeds at most: of a long passage with changes whose other seeds stand
    first elsewhere, a part is told (exact words are not concerned, see below).

    The seeds of a passage may each stand first in other documents. So whatever ``least_words`` words in a row have
    only seeds that stand elsewhere, too, are followed up: if their seeds lead to one place, they are compared with
    the words there, and if these are others, or the seeds lead to several places, all those words are matched as a whole
    with their own first occurrence. Both depend on these words only (see ``told_windows``), so all documents
    with the same ``least_words`` words in a row are linked through one that has them, too. (Words are 32-bit hashes there.)

    Returns doc_id, source_id, start, end, source_start, source_end (in words, ends exclusive),
    matched and identity; both ids are the same for a repetition within one text. Null and empty texts have no words. Rows with
    equal id and text are one document; a null id is an id like others. An empty table gives no
    rows; other columns are ignored.
    """
    if least_words < k + window - 1:
        raise ValueError("a passage holds a seed: least_words is at least k + window - 1")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    options = (k, window, gap, most_gap, least_words, identity, margin)

    def sample():
        hashes = WordHashes()

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            each = [seeds(hashes.of(alnum_words(raw or b"")), k, window) for raw in raw_texts(batch.column("text"))]
            keys = np.repeat(batch.column("key").to_numpy(), [len(h) for h, _ in each])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h for h, _ in each]).view(np.int64)), pa.array(keys), pa.array(np.concatenate([p for _, p in each]).astype(np.int32))], ["seed", "key", "p"])

        return f

    matches = stars(by_batch(rows.select("key", "text"), sample, "seed long, key long, p int"), "seed")
    together = matches.repartition("key").groupBy("key").agg(F.collect_list("source").alias("source"), F.collect_list("p").alias("p"), F.collect_list("q").alias("q"))
    # joined twice as it is, so that both joins read one shuffle of the texts
    texts = rows.select("key", "doc_id", "text")

    def packed(h: np.ndarray, at: np.ndarray) -> bytes:
        keep = np.concatenate((h[:1] == h[:1], (h[1:] != h[:-1]) | (np.diff(at) != 1)))
        return np.stack((h[keep].view(np.int64), at[keep])).tobytes()

    def start():
        work = Passages(*options)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            done = []
            arrays = [batch.column(c) for c in ("source", "p", "q")]  # each text's, by its place in the batch
            for i, (raw, key) in enumerate(zip(raw_texts(batch.column("text")), batch.column("key").to_pylist())):
                found, (h, at) = work.here(key, raw, *(x[i].values.to_numpy().astype(np.int64) for x in arrays))
                done += [(i, to, ps, qs, begin, data, [list(c) for c in checks], None) for to, ps, qs, begin, data, checks in found]
                if len(at):  # they go to the text itself, and on from there
                    done.append((i, key, [], [], 0, b"", [], packed(h, at)))
            if not done:
                return None
            columns = list(zip(*done))
            own = pa.array(columns[0], pa.int32())
            ints = pa.list_(pa.int32())
            types = [pa.int64(), ints, ints, pa.int32(), pa.binary(), pa.list_(ints), pa.binary()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id").take(own), batch.column("key").take(own), *(pa.array(c, t) for c, t in zip(columns[1:], types))], ["here_id", "here", "source", "ps", "qs", "begin", "words", "checks", "lone"])

        return f

    here = by_batch(together.join(texts, "key"), start, f"here_id {kind}, here long, source long, ps array<int>, qs array<int>, begin int, words binary, checks array<array<int>>, lone binary", 1000)

    def end():
        work = Passages(*options)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("here_id", "here", "doc_id", "source", "ps", "qs", "begin", "words", "checks", "lone")]
            for here_id, key, doc_id, source, ps, qs, begin, data, checks, lone, raw in zip(*columns, raw_texts(batch.column("text"))):
                if lone is not None:
                    out.append((here_id, None, *[None] * 6, key, None, None, lone))
                    continue
                found, exact, (h, at) = work.there(source, raw, ps, qs, begin, data, checks)
                if found:
                    out.append((here_id, doc_id, *found, key, source, exact, None))
                if len(at):
                    out.append((here_id, None, *[None] * 6, key, None, None, packed(h, at)))
            types = [batch.schema.field("doc_id").type] * 2 + [pa.int64()] * 5 + [pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["doc_id", "source_id", "start", "end", "source_start", "source_end", "matched", "identity", "key", "source", "exact", "lone"])

        return f

    there = here.join(texts, F.col("source") == F.col("key"))
    found = stored(by_batch(there, end, f"doc_id {kind}, source_id {kind}, start long, end long, source_start long, source_end long, matched long, identity double, key long, source long, exact array<int>, lone binary", 1000), "passages")

    def unpack():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            out, sizes = [], []
            for lone, exact in zip(batch.column("lone").to_pylist(), batch.column("exact").to_pylist()):
                h, at = np.concatenate([np.frombuffer(x, dtype=np.int64).reshape(2, -1) for x in lone], axis=1)
                order = np.lexsort((at, h))
                fresh = np.concatenate(([True], (np.diff(h[order]) != 0) | (np.diff(at[order]) != 0)))
                h, at = h[order][fresh], at[order][fresh]
                inside = np.zeros(int(at.max()) + 2, dtype=np.int64)
                for i, j in (pair for x in exact for pair in zip(x[::2], x[1::2])):
                    if i < len(inside):
                        inside[i] += 1
                        inside[min(j, len(inside) - 1)] -= 1
                told = (np.cumsum(inside)[at] > 0).astype(np.int64)
                new = np.concatenate(([True], np.diff(h) != 0))
                # within the text: the latest equal words that don't overlap these
                code = np.cumsum(new) * (int(at.max()) + 1)
                near = np.searchsorted(code + at, code + at - least_words, side="right") - 1
                back = (near >= 0) & (code[near] == code) & (told == 0)
                out.append(np.concatenate((np.stack((h, at, told, np.full(len(h), -1)))[:, new], np.stack((h, at, told, at[near]))[:, back]), axis=1))
                sizes.append(out[-1].shape[1])
            own = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            h, at, told, q = np.concatenate(out, axis=1)
            return pa.RecordBatch.from_arrays([pa.array(h), batch.column("key").take(own), pa.array(at), batch.column("doc_id").take(own), pa.array(told > 0), pa.array(q)], ["own", "key", "p", "doc_id", "told", "q"])

        return f

    # words that stand in a passage found already, exactly, lead on to one with a smaller key: others can refer to them, but they need no more
    alone = found.select("key", "doc_id", "lone", "exact").repartition("key").groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.collect_list("lone").alias("lone"), F.collect_list("exact").alias("exact")).where(F.size("lone") > 0)
    lone = by_batch(alone, unpack, f"own long, key long, p long, doc_id {kind}, told boolean, q long")
    inside = lone.where("q >= 0").select("key", "p", F.col("key").alias("source"), "q", "doc_id", F.col("doc_id").alias("source_doc_id"))
    # of equal words in one text the first are matched with those of others
    exact = stars(lone.where("q < 0").drop("q"), "own", "doc_id", only="not told").where("key != source").drop("told").unionByName(inside).withColumn("off", F.col("q") - F.col("p"))
    beside = Window.partitionBy("key", "source", "off").orderBy("p")
    parts = exact.withColumn("new", F.when(F.col("p") - F.lag("p").over(beside) <= least_words, 0).otherwise(1)).withColumn("part", F.sum("new").over(beside))
    begin, stop = F.min("p"), F.max("p") + least_words
    whole = parts.groupBy("key", "source", "off", "part").agg(F.first("doc_id").alias("doc_id"), F.first("source_doc_id").alias("source_id"), begin.alias("start"), stop.alias("end"))
    whole = whole.select("doc_id", "source_id", "start", "end", (F.col("start") + F.col("off")).alias("source_start"), (F.col("end") + F.col("off")).alias("source_end"), (F.col("end") - F.col("start")).alias("matched"), F.lit(1.0).alias("identity"), "key", "source")
    chained = found.where("lone is null").drop("lone", "exact").distinct()
    known = chained.select(F.col("key").alias("_k"), F.col("source").alias("_s"), F.col("start").alias("_a"), F.col("end").alias("_b"), F.col("source_start").alias("_c"), F.col("source_end").alias("_d"))
    within = (F.col("_a") <= F.col("start")) & (F.col("_b") >= F.col("end")) & (F.col("_c") <= F.col("source_start")) & (F.col("_d") >= F.col("source_end"))
    whole = whole.join(known, (F.col("key") == F.col("_k")) & (F.col("source") == F.col("_s")) & within, "left_anti")
    return chained.unionByName(whole).drop("key", "source")
