"""Near-duplicate classes by an exact n-gram Jaccard join over prefix trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from .common import by_batch, by_task, drop_stored, new_name, raw_texts, stored
from .components import components
from .key_join import C1, C2, C3, SEEN, Shingler, mix, most_apart, trie_links

#: Each scheme is for sets up to so many times as large as the one before.
RATIO = 1.5
#: A task sorts its keys in runs of so many, of so many sets at most (a set's place in a run is two bytes).
RUN, RUN_SETS = 500_000, 1 << 16
#: Keys meet in parts of about so many.
PART = 2_000_000
#: Bytes of a key that go to its part.
WIDTH = 6
#: Bits of the filter of texts that are read again, 1 MB, and of each of its rows.
FILTER, FILTER_ROW = 1 << 23, 1 << 15


def schemes(n: int, percent: int) -> list[tuple[int, int]]:
    """(number, segments) of the segmentations a set of ``n`` takes part in.

    Scheme c is for sets of up to 10 * RATIO^c. A set uses the one for its size and that of the
    largest set it can be linked with, so that any two linked sets share one.
    """
    def number(size: int) -> int:
        c = 0
        while int(10 * RATIO**c) < size:
            c += 1
        return c

    return [(c, -(-13 * (most_apart(int(10 * RATIO**c), percent) + 1) // 10)) for c in range(number(n), number(n * 100 // percent) + 1)]


def keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Keys of which any two linked sets share one.

    Hash ranges cut each set into segments. Two linked sets differ in at most d shingles, which spoil at most d
    segments; each set gives the keys of its d + 1 fullest segments and of all that are as full,
    so one unspoiled segment is given by both. The fullest are taken as a rare segment of
    several shingles is seldom shared by chance.
    """
    n = len(shingles)
    apart = most_apart(n, percent)
    if not apart:  # only equal sets can be linked
        return np.empty(0, dtype=np.uint64)
    out = []
    with np.errstate(over="ignore"):
        spread, content = mix(shingles ^ C3), mix(shingles * C1)
        for c, k in schemes(n, percent):
            part = (spread % np.uint64(k)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            full = np.bincount(part, minlength=k)
            sums = np.zeros(k, dtype=np.uint64)
            some = np.flatnonzero(full)
            sums[some] = np.add.reduceat(content[order], np.concatenate(([0], np.cumsum(full[some])[:-1])))
            least = np.sort(full)[::-1][apart]
            take = np.flatnonzero(full >= least)
            out.append(mix(sums[take] + mix(take.astype(np.uint64) * C2 + np.uint64(c * 1_000_003 + 1))))
    return np.concatenate(out)


def key_stars(runs: DataFrame, part: int) -> DataFrame:
    """(g, u, a, b) for each set u that shares a key with a set of a smaller number: the smallest and the largest with that key.

    Keys of the same sets have the same g, and most of them are told once.

    ``runs`` are sorted keys (64 bits) and whose they are (first + a place, 16 bits). What goes to a part of the keys, of about ``part``, is a row
    for each run, 8 bytes a key: key, its number of bytes cut to ``WIDTH``, and place. A part's number tells more of a key's bits, and where
    two keys are still alike, their sets are candidates for nothing, which the links sort out.
    """
    parts = max(1, -(-(runs.agg(F.sum("m").alias("m")).first().m or 0) // part))

    def deal():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: tuple[list, ...] = ([], [], [], [])
            for first, data, owners in zip(batch.column("no").to_pylist(), batch.column("keys").to_pylist(), batch.column("owners").to_pylist()):
                sigs, owners = np.frombuffer(data, dtype="<u8"), np.frombuffer(owners, dtype="<u2")
                bounds = np.searchsorted((sigs >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
                cut = sigs.view(np.uint8).reshape(-1, 8)[:, :WIDTH]
                for i in np.flatnonzero(np.diff(bounds)).tolist():
                    x, y = bounds[i], bounds[i + 1]
                    for column, value in zip(out, (i, first, cut[x:y].tobytes(), owners[x:y].tobytes())):
                        column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["part", "first", "sig", "own"])

        return f

    def meet(table: pa.Table) -> pa.Table:
        cut = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint8).reshape(-1, WIDTH)
        sig = np.zeros((len(cut), 8), dtype=np.uint8)
        sig[:, :WIDTH] = cut
        sig = sig.view("<u8").ravel()
        no = np.concatenate([first + np.frombuffer(own, dtype="<u2").astype(np.int64) for first, own in zip(table.column("first").to_pylist(), table.column("own").to_pylist())])
        order = np.lexsort((no, sig))
        sig, no = sig[order], no[order]
        starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        sizes = np.diff(np.append(starts, len(sig)))
        with np.errstate(over="ignore"):
            same = np.add.reduceat(mix(no.astype(np.uint64) * C1), starts)
        once = np.zeros(len(starts), dtype=bool)
        once[np.unique(same, return_index=True)[1]] = True
        g, a, b = (np.repeat(x, sizes) for x in (same.view(np.int64), no[starts], no[starts + sizes - 1]))
        take = np.repeat(once, sizes) & (no != a)
        return pa.table({c: pa.array(x[take], pa.int64()) for c, x in (("g", g), ("u", no), ("a", a), ("b", b))})

    dealt = by_batch(runs.select("no", "keys", "owners"), deal, "part long, first long, sig binary, own binary", most=1)
    ship(runs.sparkSession)
    return dealt.groupBy("part").applyInArrow(meet, "g long, u long, a long, b long")


def odd_bits(shingles: np.ndarray) -> np.ndarray:
    """A bit for each residue of the shingles' hashes, set if an odd number has it: some two bits a shingle, 64 at least.

    Two sets' bits differ in at most as many places as the sets do, and so do their halves laid over each other.
    """
    width = 1 << max(6, int(2 * len(shingles) - 1).bit_length())
    at = (mix(shingles ^ C2) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=width) & 1).astype(np.uint8), bitorder="little").view("<u8")


def sifted(n: np.ndarray, odd: list[np.ndarray], percent: int) -> list[tuple[int, np.ndarray]]:
    """Links (one, others) that connect all of a key's sets which sizes and ``odd_bits`` don't tell apart, and any that are linked."""
    width = min(map(len, odd))
    bits = np.stack([np.bitwise_xor.reduce(x.reshape(-1, width), axis=0) for x in odd])
    allowed = n * (100 - percent) // percent
    out, rest = [], np.arange(len(n))
    while len(rest) > 1:
        reached, rest = [int(rest[0])], rest[1:]
        while reached and len(rest):
            x = reached.pop()
            near = np.minimum(allowed[rest], allowed[x])
            hit = np.abs(n[rest] - n[x]) <= near
            hit[hit] = np.bitwise_count(bits[rest[hit]] ^ bits[x]).sum(axis=1) <= near[hit]
            if hit.any():
                out.append((x, rest[hit]))
                reached.extend(rest[hit].tolist())
                rest = rest[~hit]
    return out


def maybe_among(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Those of ``rows`` whose ``text_hash`` may be an ``h`` of ``members``: all that are, and few others.

    What is broadcast is a bitmap of a fixed size, so the other texts are never shuffled, however many members there are.
    """
    place = lambda c: F.pmod(F.col(c), F.lit(FILTER))
    bits = members.select(place("h").alias("p")).groupBy(F.expr(f"p div {FILTER_ROW}").alias("_at")).agg(F.bitmap_construct_agg(F.expr(f"p % {FILTER_ROW}")).alias("_bits"))
    names = rows.columns
    asked = rows.withColumn("_p", place("text_hash")).withColumn("_at", F.expr(f"_p div {FILTER_ROW}"))
    byte = F.expr(f"cast(conv(hex(substring(_bits, cast(_p % {FILTER_ROW} div 8 as int) + 1, 1)), 16, 10) as long)")
    return asked.join(F.broadcast(bits), "_at").where(F.getbit(byte, F.expr("cast(_p % 8 as int)")) == 1).select(*names)


def jaccard_classes(docs: DataFrame, size: int = 3, percent: int = 90, block: int = 2_000_000, digest_bits: int = 64, id_col: str = "doc_id", text_col: str = "text", part: int = PART) -> DataFrame:
    """The id, n_shingles and component_id of every row.

    Words are runs of anything but white space, A-Z lower-cased; a text's set is its distinct
    shingles of ``size`` words, or all its words as one if they are fewer. Two rows are linked when 100 *
    intersection >= ``percent`` * union; component_id is the smallest id that links reach, the row's
    own included. The join is exact, up to 64-bit hashes of shingles; a set goes by a hash of ``digest_bits``, and where two sets with
    different second hashes have the same, by one of both:

    1. Rows with equal sets become one class, so exact copies cost a row each and nothing more.
    2. Each class gives keys of which any two linked classes share one (see ``keys``). A star joins
       each key's classes to the first (see ``key_stars``); the components of these candidates are families.
       A family of more than ``block`` shingles, mostly chains of keys shared by chance, is sifted first: sets with a key in common
       stay together only if their sizes and ``odd_bits`` leave it open that they, or others in between, are linked.
    3. Each family's sets meet in a prefix tree (``trie_links``), small families many to a task. In one with more than
       ``block`` shingles, the first and the last set of each key are first compared with the key's others, a row each. Only if these links
       don't connect the family, it is dealt into blocks, and every pair of blocks that isn't connected yet is a task of bounded size.
    4. The components of the links are the result.

    Null and empty texts have no shingles, are linked with nothing, and are their own component.
    Rows with a null id take part and get their component's id, null if it has none. Repeated ids
    are rows of their own. Other columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))

    def measure():
        shingler, seen = Shingler(size), set()
        first = at = TaskContext.get().partitionId() << 40  # numbers of sets with keys
        held: list[np.ndarray] = []
        id_type = [pa.null()]
        names = ["doc_id", "text_hash", "n", "k1", "k2", "no", "m", "keys", "owners"]
        types = [pa.int64()] * 6 + [pa.binary()] * 2

        def run() -> Iterator[pa.RecordBatch]:
            nonlocal first
            if held:
                sigs, owners = np.concatenate(held), np.repeat(np.arange(len(held), dtype="<u2"), [len(x) for x in held])
                order = np.argsort(sigs)
                values = [None, None, None, None, None, first, len(sigs), sigs[order].astype("<u8").tobytes(), owners[order].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, id_type + types)], names)
                held.clear()
            first = at

        def add(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal at
            id_type[0] = batch.schema.field("doc_id").type
            n, k1, k2, no, total = [], [], [], [], sum(map(len, held))
            for raw in raw_texts(batch.column("text")):
                s = shingler.set(raw)
                n.append(len(s))
                if not len(s):
                    k1.append(None), k2.append(None), no.append(None)
                    continue
                data = s.tobytes()
                a = xxhash.xxh64_intdigest(data, 1) >> 64 - digest_bits
                k1.append(a)
                k2.append(xxhash.xxh64_intdigest(data, 2))
                sigs = keys(s, percent) if (a, k2[-1]) not in seen else ()
                if len(seen) < SEEN:
                    seen.add((a, k2[-1]))
                no.append(at if len(sigs) else None)
                if len(sigs):
                    held.append(sigs)
                    at += 1
                    total += len(sigs)
                    if total >= RUN or len(held) == RUN_SETS:
                        yield from run()
                        total = 0
            as_long = lambda x: pa.array([None if v is None else v - (v >> 63 << 64) for v in x], pa.int64())
            none = [pa.nulls(len(n), t) for t in types[-3:]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), as_long(k1), as_long(k2), pa.array(no, pa.int64()), *none], names)

        return add, run

    measured = stored(by_task(rows, measure, f"doc_id {kind.simpleString()}, text_hash long, n long, k1 long, k2 long, no long, m long, keys binary, owners binary"), "measured")
    sets = stored(measured.where("m is null").select("doc_id", "text_hash", "n", "k1", "k2", "no"), "sets")  # what is needed to the end
    shared = sets.where("k1 is not null").groupBy("k1").agg(F.min("k2").alias("k2"), F.max("k2").alias("other")).where("k2 != other").select(F.col("k1").alias("twice"))
    if not shared.isEmpty():  # some three of 10^10 sets
        shared = stored(shared, "twice")

        def apart(df: DataFrame) -> DataFrame:
            named = df.join(shared, F.col("k1") == F.col("twice"), "left")
            return named.withColumn("k1", F.when(F.col("twice").isNotNull(), F.xxhash64("k1", "k2")).otherwise(F.col("k1"))).drop("twice")

        sets = stored(apart(sets), "sets")
    classes = sets.where("k1 is not null").groupBy("k1").agg(F.min("doc_id").alias("first_id"), F.min(F.struct(F.isnull("doc_id").alias("z"), "doc_id", "text_hash")).alias("row"))

    stars = stored(key_stars(measured.where("m is not null"), part), "stars")
    drop_stored(measured)  # much of the disk that this takes
    named = sets.where("no is not null").select("no", "k1")
    for c in "uab":
        stars = stars.join(named.withColumnsRenamed({"no": c, "k1": f"{c}_"}), c).drop(c).withColumnRenamed(f"{c}_", c)
    families = components(stars.select("u", F.col("a").alias("v")))
    width = sets.select("k1", "n").where("k1 is not null").groupBy("k1").agg(F.max("n").alias("n"))
    members = families.join(classes, families["node"] == classes["k1"]).join(width, "k1").select("k1", F.col("label").alias("family"), "n", F.col("row.doc_id").alias("d"), F.col("row.text_hash").alias("h"))
    members = stored(members, "members")

    def weigh() -> tuple[DataFrame, DataFrame]:
        weights = stored(members.groupBy("family").agg(F.sum("n").alias("n")), "families")
        return weights, weights.where(F.col("n") > block).select("family")

    def texts_of(some: DataFrame) -> DataFrame:
        return maybe_among(rows, some).join(some, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).select("k1", "family", "text")

    def gather():
        shingler = Shingler(size)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("family"), pa.array([shingler.set(raw).tobytes() for raw in raw_texts(batch.column("text"))], pa.binary())], ["k1", "family", "s"])

        return f

    def describe():
        shingler = Shingler(size)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            known = [shingler.set(raw) for raw in raw_texts(batch.column("text"))]
            return pa.RecordBatch.from_arrays([batch.column("k1"), pa.array([len(x) for x in known], pa.int64()), pa.array([odd_bits(x).tobytes() for x in known], pa.binary())], ["k1", "n", "odd"])

        return f

    def sift(table: pa.Table) -> pa.Table:
        g, k1, n = (table.column(c).to_numpy() for c in ("g", "k1", "n"))
        odd, order, u, v = table.column("odd").to_pylist(), np.argsort(g, kind="stable"), [], []
        for part in np.split(order, np.flatnonzero(np.diff(g[order])) + 1):
            for one, others in sifted(n[part], [np.frombuffer(odd[i], dtype="<u8") for i in part], percent):
                u.append(np.full(len(others), k1[part[one]]))
                v.append(k1[part[others]])
        return pa.table({c: pa.array(np.concatenate(x) if x else [], pa.int64()) for c, x in (("u", u), ("v", v))})

    weights, large = weigh()
    if not large.isEmpty():
        some = members.join(large, "family", "left_semi")
        known = stored(by_batch(texts_of(some), describe, "k1 long, n long, odd binary").dropDuplicates(["k1"]), "bits")
        inside = stars.join(some.select(F.col("k1").alias("u")), "u", "left_semi")
        shared = stored(inside.select("g", F.col("u").alias("k1")).union(inside.select("g", "a")).distinct(), "keys")
        groups = max(1, -(-10 * shared.count() // part))
        ship(docs.sparkSession)
        sieve = shared.join(known, "k1").withColumn("p", F.pmod(F.xxhash64("g"), F.lit(groups))).groupBy("p").applyInArrow(sift, "u long, v long")
        kept = components(sieve)
        sure = members.join(large, "family", "left_anti").unionByName(members.join(kept, F.col("k1") == F.col("node")).withColumn("family", F.col("label")).select(members.columns))
        members = stored(sure, "members")
        for old in (known, shared, weights):
            drop_stored(old)
        weights, large = weigh()
    dealt = by_batch(texts_of(members), gather, "k1 long, family long, s binary").join(weights, "family")
    early = None
    if large.isEmpty():
        dealt = dealt.withColumn("known", F.col("k1"))
    else:
        mine = members.join(large, "family", "left_semi").select(F.col("k1").alias("u"))
        ends = stars.join(mine, "u", "left_semi").select("u", F.explode(F.array("a", "b")).alias("v")).where("u != v").distinct()
        own = stored(dealt.join(large, "family", "left_semi").select("k1", "s").dropDuplicates(["k1"]), "large")

        def compare():
            def f(batch: pa.RecordBatch) -> pa.RecordBatch:
                hit = []
                for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                    x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    hit.append(100 * both >= percent * (len(x) + len(y) - both))
                return batch.select(["u", "v"]).filter(pa.array(hit))

            return f

        sides = ends.join(own.select(F.col("k1").alias("u"), F.col("s").alias("x")), "u").join(own.select(F.col("k1").alias("v"), F.col("s").alias("y")), "v")
        early = stored(by_batch(sides.select("u", "v", "x", "y"), compare, "u long, v long"), "links")
        drop_stored(own)
        met = components(early)
        dealt = dealt.join(met, F.col("k1") == F.col("node"), "left").withColumn("known", F.coalesce("label", "k1")).drop("node", "label")
        open_ = dealt.where(F.col("n") > block).select("family", "known").distinct().groupBy("family").agg(F.count("*").alias("parts")).where("parts = 1").select("family")
        dealt = dealt.join(open_, "family", "left_anti")  # connected already
    total = weights.agg(F.sum("n").alias("n")).first().n or 0
    tasks = max(1, -(-total // block))
    blocks = F.ceil(F.col("n") / block)
    own_block = F.pmod(F.xxhash64("k1"), blocks)
    places = F.when(blocks <= 1, F.array(F.struct(F.pmod(F.xxhash64("family"), F.lit(tasks)).alias("g"), F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j")))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: j != own_block), lambda j: F.struct(F.col("family").alias("g"), F.least(own_block, j).alias("i"), F.greatest(own_block, j).alias("j")))
    )
    placed = dealt.select("k1", "family", "s", "known", F.explode(places).alias("p")).select("k1", "family", "s", "known", "p.*")

    def link(table: pa.Table) -> pa.Table:
        u, v = [], []
        k1, family, known, data = (table.column(c).to_numpy(zero_copy_only=False) if c != "s" else table.column(c).to_pylist() for c in ("k1", "family", "known", "s"))
        order = np.lexsort((k1, family))
        for part in np.split(order, np.flatnonzero(np.diff(family[order])) + 1):
            part = part[np.concatenate(([True], np.diff(k1[part]) != 0))]  # repeated rows
            if len(part) > 1 and (known[part] != known[part[0]]).any():
                for a, b in trie_links([np.frombuffer(data[i], dtype=np.uint64) for i in part], percent, known[part]):
                    u.append(k1[part[a]])
                    v.append(k1[part[b]])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    links = placed.groupBy("g", "i", "j").applyInArrow(link, "u long, v long")
    linked = components(links if early is None else links.unionByName(early))
    drop_stored(weights)
    named = classes.join(linked, classes["k1"] == linked["node"], "left").select("k1", "first_id", F.coalesce("label", "k1").alias("c"))
    least = named.groupBy("c").agg(F.min("first_id").alias("component_id"))
    of_class = named.join(least, "c").select("k1", "component_id")
    out = sets.select("doc_id", "n", "k1").join(of_class, "k1", "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their class of near duplicates; all columns as they were.

    Rows without words and rows with a null id stay. Repeated ids stay or go together.
    """
    d = new_name(docs, "_gone")
    found = jaccard_classes(docs, size, percent, id_col=id_col, text_col=text_col)
    gone = found.where((F.col("n_shingles") > 0) & (F.col(id_col) != F.col("component_id"))).select(F.col(id_col).alias(d)).distinct()
    gone = stored(gone, "gone")  # its size is known before the join, so a small one shuffles no text
    return docs.join(gone, F.col(id_col) == F.col(d), "left_anti")
