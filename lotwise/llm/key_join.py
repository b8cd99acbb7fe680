"""Connected classes of similar shingle sets: candidates by common keys, links confirmed on full sets, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, by_batch, by_task, drop_stored, plain_words, raw_texts, stored
from .components import components

C1, C2, C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Sets whose keys a task remembers to have given.
SEEN = 200_000
#: Rows that are compared with one copy of their centre.
FAN = 500


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * C2
        h = (h ^ (h >> np.uint64(27))) * C3
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sets of 64-bit shingle hashes."""

    def __init__(self, size: int):
        self.size = size
        self.hashes = WordHashes()

    def set(self, raw: bytes | None) -> np.ndarray:
        """The sorted distinct shingles; fewer words than a shingle has make one of all."""
        w = self.hashes.of(plain_words(raw or b""))
        if not len(w):
            return w
        s = min(self.size, len(w))
        h = np.full(len(w) - s + 1, s, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(s):
                h = mix(h * C1 + w[j : len(w) - s + 1 + j])
        return np.unique(h)


def most_apart(n: int, percent: int) -> int:
    """How many shingles two linked sets can differ by, if one has ``n``: union - intersection <= n (100 - p) / p."""
    return n * (100 - percent) // percent


def trie_links(sets: list[np.ndarray], percent: int, known: np.ndarray | None = None, frequency: Callable[[np.ndarray], np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links that connect all sets which are connected by links at all, as pairs of positions; sets with equal ``known`` are so already.

    The sets are put in one order of shingles, the most frequent ones first (by ``frequency`` of the whole corpus; among these sets without it), and stored in a
    prefix tree, which is walked depth first. Each node keeps the overlaps of its path with all
    sets at once, so that sets with a common prefix share that work. A subtree goes unvisited
    when for every set that isn't connected to it yet, the path has too many foreign shingles or the
    remaining lengths leave too small an overlap.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, inverse, shared = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), dtype=np.int64)
    often = shared if frequency is None else frequency(values).astype(np.int64)
    rank[np.lexsort((values, -often))] = np.arange(len(values))
    owner = np.repeat(np.arange(m), sizes)
    ranks = rank[inverse]
    by_rank = np.lexsort((owner, ranks))
    holders = owner[by_rank]  # of each shingle in turn
    starts = np.concatenate(([0], np.cumsum(np.bincount(ranks, minlength=len(values)))))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    paths = [np.sort(ranks[bounds[i] : bounds[i + 1]]) for i in range(m)]
    order = sorted(range(m), key=lambda i: paths[i].astype(">u4").tobytes())
    common = []  # with the next path
    for i, j in zip(order, order[1:]):
        k = min(len(paths[i]), len(paths[j]))
        differ = np.flatnonzero(paths[i][:k] != paths[j][:k])
        common.append(int(differ[0]) if len(differ) else k)
    common.append(0)
    allowed = np.array([most_apart(int(n), percent) for n in sizes])
    least = -(-percent * sizes // 100)  # of a linked set's size
    group = np.arange(m) if known is None else np.unique(known, return_inverse=True)[1]
    links: list[tuple[int, int]] = []

    def overlaps(before: np.ndarray, path: np.ndarray, a: int, b: int) -> np.ndarray:
        if a == b:
            return before
        spans = [holders[starts[r] : starts[r + 1]] for r in path[a:b].tolist()]
        return before + np.bincount(np.concatenate(spans), minlength=m)

    def alive(depth: int, found: np.ndarray, shortest: int, longest: int) -> np.ndarray:
        rest = np.minimum(sizes - found, longest - depth)
        return (depth - found <= allowed) & (longest >= least) & (100 * (found + rest) >= percent * (np.maximum(sizes, shortest)))

    stack = [(0, np.zeros(m, dtype=np.int64))]
    at = 0
    while at < m:
        i = order[at]
        path = paths[i]
        depth, found = stack[-1]
        branch = common[at]
        if branch > depth:  # the node that this path shares with the next ones
            end = at
            while end < m - 1 and common[end] >= branch:
                end += 1
            below = np.array(order[at : end + 1])
            found = overlaps(found, path, depth, branch)
            lengths = sizes[below]
            may = alive(branch, found, int(lengths.min()), int(lengths.max()))
            one = group[below[0]] if (group[below] == group[below[0]]).all() else -1
            if not may.any() or one >= 0 and (group[may] == one).all():
                back = common[end]
                while stack[-1][0] > back:
                    stack.pop()
                at = end + 1
                continue
            stack.append((branch, found))
            depth = branch
        may = alive(depth, found, len(path), len(path)) & (group != group[i])
        if may.any():
            full = overlaps(found, path, depth, len(path))
            hit = np.flatnonzero(may & (100 * full >= percent * (sizes + len(path) - full)))
            for j in hit.tolist():
                if group[i] != group[j]:
                    links.append((i, j))
                    group[group == group[j]] = group[i]
            if (group == group[0]).all():
                break
        while stack[-1][0] > branch:
            stack.pop()
        at += 1
    return links


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted distinct sets have 100 * intersection >= ``percent`` * union."""
    small, large = sorted((len(x), len(y)))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets are linked.

    Each u is the centre of a star. A task reads the centre's text, then one after the other those that are compared with
    it, so it holds two sets; stars of more than ``FAN`` rows are dealt to several tasks.
    """
    fans = pairs.groupBy("u").agg(F.ceil(F.count("*") / FAN).alias("fans"))
    dealt = pairs.join(fans, "u").select("u", "v", F.pmod(F.xxhash64("v"), "fans").alias("fan"))
    sides = dealt.join(texts.withColumnRenamed("k", "v"), "v").select("u", "fan", "v", "text")
    centres = dealt.select("u", "fan").distinct().join(texts.withColumnRenamed("k", "u"), "u").select("u", "fan", F.lit(None).cast(dealt.schema["v"].dataType).alias("v"), "text")
    rows = centres.unionByName(sides).repartition("u", "fan").sortWithinPartitions("u", "fan", F.asc_nulls_first("v"))

    def make():
        shingler, held = Shingler(size), [None]

        def add(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            u, v, hit = batch.column("u"), batch.column("v"), []
            for alone, raw in zip(v.is_null().to_pylist(), raw_texts(batch.column("text"))):
                s = shingler.set(raw)
                if alone:
                    held[0] = s
                hit.append(not alone and linked(held[0], s, percent))
            yield batch.select(["u", "v"]).filter(pa.array(hit))

        return add, lambda: iter(())

    return by_task(rows.select("u", "v", "text"), make, "u binary, v binary")


def meeting(size: int, percent: int) -> Callable[[pa.Table], pa.Table]:
    """What makes the links of a group (k, label, text) by a prefix tree of its sets; sets with equal labels are connected already."""

    def meet(group: pa.Table) -> pa.Table:
        shingler = Shingler(size)
        k, label = group.column("k").to_pylist(), np.unique(np.array(group.column("label").to_pylist(), dtype=object), return_inverse=True)[1]
        found = trie_links([shingler.set(raw) for raw in raw_texts(group.column("text").combine_chunks())], percent, label) if len(np.unique(label)) > 1 else []
        return pa.table({"u": pa.array([k[a] for a, _ in found], pa.binary()), "v": pa.array([k[b] for _, b in found], pa.binary())})

    return meet


def key_classes(docs: DataFrame, make_keys: Callable[[], Callable[[np.ndarray], np.ndarray]], size: int, percent: int, block: int, id_col: str, text_col: str) -> DataFrame:
    """The id, n_shingles, component_id and kept of every row, by keys that each set (sorted shingle hashes) gives.

    Sets are linked when 100 * intersection >= ``percent`` * union. Rows with equal sets (128-bit digests) are one class. Classes with
    a key in common form a star around the key's smallest. Each class meets the smallest of its centres first,
    then those centres that it isn't connected to yet. Where other members of a key are still apart, all of them meet in a prefix tree that knows what is connected; keys
    with the same members count once, and more than ``block`` shingles are dealt into blocks, each pair of which is a task of bounded size. So no pair with a common key
    goes unconfirmed but those that are connected already.
    """
    kind = docs.schema[id_col].dataType
    table = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))

    def measure():
        shingler, seen, keys = Shingler(size), set(), make_keys()

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, k, sigs = [], [], []
            for raw in raw_texts(batch.column("text")):
                s = shingler.set(raw)
                n.append(len(s))
                digest = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                k.append(digest)
                new = digest is not None and digest not in seen
                sigs.append(keys(s).view(np.int64) if new else None)
                if new and len(seen) < SEEN:
                    seen.add(digest)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(k, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))], ["doc_id", "text_hash", "n", "k", "sigs"])

        return f

    measured = stored(by_batch(table, measure, f"doc_id {kind.simpleString()}, text_hash long, n long, k binary, sigs array<long>"), "measured")
    sets = stored(measured.drop("sigs"), "sets")  # what is needed to the end
    classes = sets.where("k is not null").groupBy("k").agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n"), F.min(F.struct(F.isnull("doc_id").alias("z"), "doc_id", "text_hash")).alias("row"))

    keyed = measured.where("sigs is not null").select("k", F.explode("sigs").alias("sig"))
    centres = keyed.groupBy("sig").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a < b").select("sig", "a")
    stars = stored(keyed.join(centres, "sig").distinct(), "stars")
    drop_stored(measured)
    mine = stars.select("k").distinct().join(classes, "k").select("k", F.col("row.doc_id").alias("d"), F.col("row.text_hash").alias("h"))
    texts = table.join(mine, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).select("k", "text")
    texts = stored(texts.dropDuplicates(["k"]), "texts")

    apart = stars.where("k != a")
    width = classes.select("k", "n")
    first = stored(verified(apart.groupBy(F.col("k").alias("v")).agg(F.min("a").alias("u")), texts, size, percent), "links")
    known = components(first)

    def named(df: DataFrame, node: str, name: str) -> DataFrame:
        return df.join(known.select(F.col("node").alias(node), F.col("label").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))

    least = apart.groupBy("k").agg(F.min("a").alias("done"))
    others = apart.select("k", "a").distinct().join(least, "k").where("a != done").select("k", "a")
    open_ = named(named(others, "k", "x"), "a", "y").where("x != y").select(F.col("a").alias("u"), F.col("k").alias("v"))
    links = stored(first.unionByName(verified(open_, texts, size, percent)), "links")
    drop_stored(first)
    known = components(links)

    members = named(apart, "k", "label")
    rest = members.groupBy("sig").agg(F.min("label").alias("p"), F.max("label").alias("q"), F.sum(F.xxhash64("k").cast("decimal(20,0)")).alias("same"), F.count("*").alias("m")).where("p != q")
    rest = rest.groupBy("same", "m", "p", "q").agg(F.min("sig").alias("sig")).select("sig")
    left = stored(members.join(rest, "sig").join(width, "k").select("sig", "k", "label", "n"), "left")
    total = left.groupBy("sig").agg(F.sum("n").alias("total"))
    blocks = F.ceil(F.col("total") / block)
    own = F.pmod(F.xxhash64("k"), blocks)
    no = F.lit(-1).cast("long")
    places = F.when(blocks <= 1, F.array(F.struct(no.alias("i"), no.alias("j")))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: j != own), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    )
    placed = left.join(total, "sig").select("sig", "k", "label", F.explode(places).alias("p")).select("sig", "k", "label", "p.*").join(texts, "k")

    late = placed.select("sig", "i", "j", "k", "label", "text").groupBy("sig", "i", "j").applyInArrow(meeting(size, percent), "u binary, v binary")
    grouped = components(links.unionByName(late))
    for old in (stars, texts, left, links):
        drop_stored(old)
    of_class = classes.join(grouped, classes["k"] == grouped["node"], "left").select("k", "first_id", F.coalesce("label", "k").alias("c"))
    ids = of_class.groupBy("c").agg(F.min("first_id").alias("component_id"))
    out = sets.select("doc_id", "n", "k").join(of_class.join(ids, "c").select("k", "component_id"), "k", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


