"""I-Match fingerprints: hashes of a text's mid-frequency terms, over several randomised lexicon subsets."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, by_batch, by_task, drop_stored, raw_texts, stored
from .ngram_join import mix

#: How much of the lexicon each subset keeps, as powers of two. The first keeps all.
KEEP = [0] + [2] * 3 + [4] * 6 + [6] * 10 + [8] * 12
SEEDS = np.array([r * 0x9E3779B1 + 1 for r in range(len(KEEP))], dtype=np.uint64)
SHIFTS = np.array([64 - bits for bits in KEEP], dtype=np.uint64)
NONE = "0" * 8
MANY = 10_000
BLOCK = 500_000


def counted(rows: DataFrame, wanted: Broadcast | None, most: int = 1_000_000) -> DataFrame:
    """(term, n): in how many texts each term stands, of those ``wanted`` if that is given; partial counts by task."""

    def make():
        counts: Counter = Counter()

        def flush():
            terms = list(counts)
            for at in range(0, len(terms), 100_000):
                part = terms[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([counts[t] for t in part], pa.int64())], ["term", "n"])
            counts.clear()

        def add(batch: pa.RecordBatch):
            for raw in raw_texts(batch.column(0)):
                words = alnum_words(raw or b"")
                counts.update(wanted.value.intersection(words) if wanted else set(words))
                if len(counts) > most:
                    yield from flush()

        return add, flush

    return by_task(rows, make, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, least: float = 1e-3, most: float = 0.02, block: int = BLOCK, room: int = 1_000_000, text_col: str = "text") -> dict[bytes, int]:
    """Terms (and their hashes) that ``least`` to ``most`` of all documents hold, with exact document frequencies.

    A term in a share of all documents has that share in one part of them at least. So each task names those of
    its documents, or of the next ones each time it holds ``room`` terms, and a second pass counts these in all documents:
    up to ``block`` of them are broadcast for that, else it counts every term. At most (mean distinct terms of a
    document) / ``least`` terms can qualify: the bound of what comes to the driver. Terms of a single document never do.
    """
    rows = docs.select(F.col(text_col).alias("text"))

    def local():
        counts: Counter = Counter()
        seen = [0]

        def flush():
            need = least * seen[0]
            terms = [w for w, n in counts.items() if n >= need]
            counts.clear()
            seen[0] = 0
            for at in range(0, len(terms), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(terms[at : at + 100_000], pa.binary())], ["term"])

        def add(batch: pa.RecordBatch):
            for raw in raw_texts(batch.column("text")):
                counts.update(set(alnum_words(raw or b"")))
                seen[0] += 1
                if len(counts) > room:
                    yield from flush()

        return add, flush

    candidates = stored(by_task(rows, local, "term binary").distinct(), "candidates")
    n, count = docs.count(), candidates.count()
    low, high = max(2, math.ceil(least * n)), max(2, math.floor(most * n))
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r.term) for r in candidates.collect())) if count <= block else None
    found = counted(rows, shared).where(F.col("n").between(low, high)).collect()
    drop_stored(candidates)
    if shared:
        shared.unpersist()
    return {bytes(r.term): xxhash.xxh3_64_intdigest(bytes(r.term)) for r in found}


class Subsets(dict):
    """By the hash of a term: its eight bytes, and the lexicon subsets that keep it; for the terms seen last."""

    def learn(self, hashes: list[int]) -> None:
        new = [h for h in hashes if h not in self]
        if not new:
            return
        if len(self) + len(new) > 500_000:
            self.clear()
            new = hashes
        h = np.array(new, dtype=np.uint64)
        raw, kept = h.astype("<u8").tobytes(), [[0] for _ in new]
        for i, r in zip(*(x.tolist() for x in np.nonzero(mix(h[:, None] + SEEDS[1:]) >> SHIFTS[1:] == 0))):
            kept[i].append(r + 1)
        self.update((x, (raw[8 * i : 8 * i + 8], tuple(kept[i]))) for i, x in enumerate(new))


SUBSETS = Subsets()


def parts_of(hashes: list[int]) -> list[bytes]:
    """For each lexicon subset the sorted hashes it keeps, as bytes."""
    if len(hashes) > MANY:  # many terms by whole arrays, few by what is known of each
        h = np.sort(np.array(hashes, dtype=np.uint64))
        return [h.astype("<u8").tobytes()] + [h[mix(h + seed) >> shift == 0].astype("<u8").tobytes() for seed, shift in zip(SEEDS[1:], SHIFTS[1:])]
    SUBSETS.learn(hashes)
    parts: list[list[bytes]] = [[] for _ in KEEP]
    for h in sorted(hashes):
        raw, kept = SUBSETS[h]
        for r in kept:
            parts[r].append(raw)
    return [b"".join(p) for p in parts]


def fingerprint(raw: bytes, terms: dict[bytes, int]) -> str:
    """Eight hex digits for each lexicon subset; zeros where it holds none of the text's terms.

    A text with no term in the band is described by all its distinct words instead.
    """
    words = set(alnum_words(raw))
    inside = [h for h in map(terms.get, words) if h is not None] or [xxhash.xxh3_64_intdigest(w) for w in words]
    return "".join([f"{xxhash.xxh32_intdigest(part, r) or 1:08x}" if part else NONE for r, part in enumerate(parts_of(inside))])


def likeness(a: str, b: str) -> float:
    """Of the subsets that hold terms of either text, the share with equal hashes; 1 if there is none."""
    pairs = [(a[i : i + 8], b[i : i + 8]) for i in range(0, len(a), 8)]
    told = [x == y for x, y in pairs if x != NONE or y != NONE]
    return sum(told) / len(told) if told else 1.0


def fingerprints(docs: DataFrame, least: float = 1e-3, most: float = 0.02, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and fingerprint of every whole text; null and empty texts have all zeros. No shuffle after the lexicon's."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(lexicon(docs, least, most, text_col=text_col))

    def make():
        terms = shared.value
        return lambda batch: pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(raw or b"", terms) for raw in raw_texts(batch.column(1))])], ["doc_id", "fingerprint"])

    return by_batch(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make, f"doc_id {kind}, fingerprint string").withColumnRenamed("doc_id", id_col)


def edited_fingerprints(docs: DataFrame, least: float = 1e-3, most: float = 0.02, bucket_mb: float = 8, max_buckets: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of an edited one, and how like they and the next document's are.

    The next document is that of the next smaller id; after the smallest comes the largest (with
    equal ids, by text hash; null ids come last). The edited text has its last third
    (floor(n_chars / 3) code points) replaced by the first as many of the next document's. Ids are
    cut into ranges of about ``bucket_mb`` MB by quantiles; the largest id's rows of each range also go to
    the range above, so each range is sorted and read by itself, a row and its successor at a
    time, and the texts are shuffled once.

    Returns the id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next. Null texts count as empty; repeated rows are rows of their own; a single row is its own
    successor; an empty table gives none; other columns are ignored; ids that are no whole numbers raise a TypeError.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} orders the documents and must be a whole number, not {kind}")
    shared = spark.sparkContext.broadcast(lexicon(docs, least, most, text_col=text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    count = int(min(max_buckets, max(1, math.ceil(size / (bucket_mb * 1e6)))))
    bounds = np.unique(np.array(rows.stat.approxQuantile("doc_id", [i / count for i in range(1, count)], 0.2 / count) if count > 1 else [], dtype=np.float64))

    def bucket_of(ids: pa.Array) -> np.ndarray:
        known = ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False)
        return np.searchsorted(bounds, known, side="right").astype(np.int64)

    def tops():
        return lambda batch: pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()).fill_null(-(2**63)), pa.array(bucket_of(batch.column(0)))], ["top", "bucket"])

    top = {r.bucket: r.top for r in by_batch(rows.select("doc_id"), tops, "top long, bucket long").groupBy("bucket").agg(F.max("top").alias("top")).collect()}
    full = sorted(top)
    above = {b: full[(i + 1) % len(full)] for i, b in enumerate(full)}

    def deal():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            buckets = bucket_of(batch.column("doc_id"))
            ids = batch.column("doc_id").cast(pa.int64()).fill_null(-(2**63)).to_pylist()
            guests = [i for i, (b, x) in enumerate(zip(buckets.tolist(), ids)) if top[b] == x]
            own = pa.RecordBatch.from_arrays([*batch.columns, pa.array(buckets), pa.array([False] * batch.num_rows)], ["doc_id", "text", "bucket", "guest"])
            if not guests:
                return own
            more = batch.take(pa.array(guests))
            also = pa.RecordBatch.from_arrays([*more.columns, pa.array([above[int(buckets[i])] for i in guests], pa.int64()), pa.array([True] * len(guests))], ["doc_id", "text", "bucket", "guest"])
            return pa.Table.from_batches([own, also]).combine_chunks().to_batches()[0]

        return f

    dealt = by_batch(rows, deal, f"doc_id {kind}, text string, bucket long, guest boolean")
    ordered = dealt.repartition(max(1, len(full)), "bucket").sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), F.xxhash64("text"))

    def pair():
        terms = shared.value
        last: list = []  # bucket, id, text, fingerprint of a row whose successor hasn't come yet

        def close(text: str, mark: str) -> tuple:
            _, doc_id, own, own_mark = last.pop()
            cut = len(own) // 3
            edited = (own[: len(own) - cut] + text[:cut]).encode()
            edited_mark = own_mark if edited == own.encode() else fingerprint(edited, terms)
            return doc_id, len(own), hashlib.sha256(edited).hexdigest(), own_mark, edited_mark, likeness(own_mark, edited_mark), likeness(own_mark, mark)

        def add(batch: pa.RecordBatch):
            done = []
            for doc_id, text, bucket, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "guest"))):
                text = text or ""
                if guest and not (last and last[0][0] == bucket):
                    continue
                mark = fingerprint(text.encode(), terms)
                if last:
                    done.append(close(text, mark))
                if not guest:
                    last.append((bucket, doc_id, text, mark))
            if done:
                columns = list(zip(*done))
                types = [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        return add, lambda: iter(())

    out = by_task(ordered, pair, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("doc_id", id_col)
