"""A trie of conversations by chained digests: who shares which prefix, and what sharing saves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_task, stored

#: Turns are chained in blocks of so many, and blocks again, so that one conversation with much of the table takes many tasks.
BLOCK = 1024
#: Rows to a range of the sort.
RANGE = 50_000


def root_digest() -> Column:
    return F.unhex(F.lit(""))


def sha(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def ordered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, n_turns), and their turns (conv_id, depth from 1, digest, n_chars).

    Turns are in the order of ``turn``, null first; ties by role, then text, and repeated rows are turns of their own.
    Null roles and texts are empty; rows with a null id belong to no conversation. Only a digest of a turn is kept. The table is sorted in
    ranges over all these columns, so a long conversation takes several; places come from the ranges' counts.
    """
    known = conversations.where(F.col(conv).isNotNull())
    rows = known.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", "turn", "role", "text", "row"]
    parts = max(1, -(-known.count() // RANGE))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    digest = sha(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    placed = stored(ranged.select("conv_id", digest.alias("digest"), F.length("text").cast("long").alias("n_chars"), F.monotonically_increasing_id().alias("at")).withColumn("part", F.shiftright("at", 33)), "turns")
    spans = placed.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("conv_id", "part", (F.col("first") - before).alias("zero"))
    turns = placed.join(spans, ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("zero") + 1).alias("depth"), "digest", "n_chars")
    return placed.groupBy("conv_id").agg(F.count("*").alias("n_turns")), turns


def branched(convs: DataFrame, turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations as branches: each begins with the first h turns of conversation c - c % ``every`` (fewer if that has
    fewer, none if there is none) in place of its own first h; h = crc32(c) % ``most``. Every conversation stays, even without turns."""
    h = F.crc32(F.col("conv_id").cast("string")) % most
    known = convs.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    bases = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.col("n_turns").alias("there"))
    known = known.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    n = F.col("taken") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))
    known = stored(known.select("conv_id", "base", "h", "taken", n.alias("n_turns")), "branches")
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("depth") < most)).withColumnRenamed("conv_id", "base")
    head = known.where("taken > 0").join(heads, "base").where(F.col("depth") <= F.col("taken")).select("conv_id", "depth", "digest", "n_chars")
    own = turns.join(known, "conv_id").where(F.col("depth") > F.col("h")).select("conv_id", (F.col("depth") - F.col("h") + F.col("taken")).alias("depth"), "digest", "n_chars")
    return known.select("conv_id", "n_turns"), head.unionByName(own)


def chained(rows: DataFrame, by: list[str], at: str) -> DataFrame:
    """``rows`` with ``chain``, the digest of all their digests so far in their group, and ``before``, the same without their own.

    Rows of a group are read one by one in the order of ``at``: SHA-256 of the chain so far and the row's digest, from the empty chain on.
    """
    where = [rows.columns.index(c) for c in by]
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", chain binary, before binary"

    def make():
        state: list = [None, b""]

        def add(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            chain, before = [], []
            for *key, digest in zip(*(batch.column(i).to_pylist() for i in where), batch.column("digest").to_pylist()):
                if key != state[0]:
                    state[:] = [key, b""]
                before.append(state[1])
                state[1] = hashlib.sha256(state[1] + digest).digest()
                chain.append(state[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chain, pa.binary()), pa.array(before, pa.binary())], [*batch.schema.names, "chain", "before"])

        return add, lambda: iter(())

    return by_task(rows.repartition(*by).sortWithinPartitions(*by, at), make, schema)


def prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Every prefix of one turn or more: conv_id, depth, digest, parent (the digest one turn earlier), n_chars, last."""
    rows = turns.join(convs, "conv_id").select("conv_id", F.floor((F.col("depth") - 1) / BLOCK).cast("long").alias("block"), "depth", "digest", "n_chars", (F.col("depth") == F.col("n_turns")).alias("last"))
    inner = stored(chained(rows, ["conv_id", "block"], "depth").drop("digest"), "chains")
    whole = inner.where(F.col("depth") % BLOCK == 0).select("conv_id", "block", F.col("chain").alias("digest"))
    starts = chained(whole, ["conv_id"], "block").select("conv_id", (F.col("block") + 1).alias("block"), F.col("chain").alias("start"))
    later = inner.where("block > 0").join(starts, ["conv_id", "block"])
    every = inner.where("block = 0").withColumn("start", root_digest()).unionByName(later)
    parent = F.when(F.col("before") == root_digest(), F.col("start")).otherwise(sha(F.col("start"), F.col("before")))
    return stored(every.select("conv_id", "depth", sha(F.col("start"), F.col("chain")).alias("digest"), parent.alias("parent"), "n_chars", "last"), "prefixes")


def end_digests(ends: DataFrame) -> DataFrame:
    """(digest, ends_sha256): of each node's conv_ids in numeric order as decimals, comma-joined.

    Ids are joined in runs of up to 1024 first; a task then takes a node's runs one after the other, so that its memory
    doesn't depend on how many conversations end there.
    """
    runs = ends.groupBy("digest", F.floor(F.col("conv_id") / 1024).alias("run")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def make():
        state: list = [None, None]

        def out(done: list) -> Iterator[pa.RecordBatch]:
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in done], pa.binary()), pa.array([h for _, h in done])], ["digest", "ends_sha256"])

        def add(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            done = []
            for digest, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist()):
                if digest == state[0]:
                    state[1].update(b"," + ids.encode())
                else:
                    if state[1] is not None:
                        done.append((state[0], state[1].hexdigest()))
                    state[:] = [digest, hashlib.sha256(ids.encode())]
            yield from out(done)

        return add, lambda: out([(state[0], state[1].hexdigest())] if state[1] is not None else [])

    return by_task(runs.repartition("digest").sortWithinPartitions("digest", "run").select("digest", "ids"), make, "digest binary, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each distinct prefix: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``convs`` (conv_id, n_turns) has every conversation, ``turns`` (conv_id, depth, digest, n_chars) theirs, as
    ``ordered_turns`` gives them.

    1. Each conversation's turns are chained into digests, a row for each prefix; grouped by (depth, digest) these are the nodes, named by
       their smallest member.
    2. A conversation that names a node names all that it passes below it, so the nodes fall into paths, one for each conversation that
       names any. A path's sums run up from its deepest node by a window; a path's total goes to every prefix of its
       conversation above the path, which are all its ancestors, and is added up by node. That gives each node the sum over all its descendants,
       with no more rows than there are prefixes (a row for each node and ancestor would grow with the square of the depth).

    Conversations without turns are members of the root. Without conversations there are no rows.
    """
    steps = prefixes(convs, turns)
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if(F.col("n_turns") == 0).alias("n_ends")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), root_digest().alias("digest"), F.lit(None).cast("binary").alias("parent"), "conv_id", "n_convs", F.lit(0).cast("long").alias("n_chars"), "n_ends")
    grouped = steps.groupBy("depth", "digest").agg(F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_chars").alias("n_chars"), F.count_if("last").alias("n_ends"))
    nodes = stored(grouped.select(*root.columns).unionByName(root), "nodes")
    own = nodes.withColumns({"leaves": (F.col("n_convs") == F.col("n_ends")).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("n_chars"), "block": F.floor(F.col("depth") / BLOCK).cast("long")})

    paths = own.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    passed = steps.select("conv_id", "depth", "digest").unionByName(convs.select("conv_id", F.lit(0).cast("long").alias("depth"), root_digest().alias("digest")))
    below = passed.join(paths, "conv_id").where(F.col("depth") < F.col("top")).groupBy("digest").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))

    within = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy("conv_id", "block").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    sums = sums.select("conv_id", "block", F.sum("l").over(deeper).alias("l"), F.sum("s").over(deeper).alias("s")).where("l is not null")
    run = own.withColumns({"leaves": F.sum("leaves").over(within), "saved": F.sum("saved").over(within)}).join(sums, ["conv_id", "block"], "left")
    zero = F.lit(0)
    run = run.withColumns({"leaves": F.col("leaves") + F.coalesce("l", zero), "saved": F.col("saved") + F.coalesce("s", zero)}).drop("l", "s", "block")

    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    ends = steps.where("last").select("digest", "conv_id").unionByName(convs.where("n_turns = 0").select(root_digest().alias("digest"), "conv_id"))
    about = below.join(children, "digest", "full").join(end_digests(ends), "digest", "full")
    # nodes of one turn, of which there may be as many as conversations, take theirs from that one row
    above = run.where("depth > 1").join(nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    top = run.where("depth <= 1").join(F.broadcast(root.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))), "parent", "left")  # a row
    out = above.unionByName(top).join(about, "digest", "left")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", zero).cast("long").alias("n_children"),
        (F.col("leaves") + F.coalesce("more_leaves", zero)).cast("long").alias("n_leaves"),
        (F.col("saved") + F.coalesce("more_saved", zero)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """``trie`` of a table of conversations as they are."""
    return trie(*ordered_turns(conversations, **columns))


def branched_trie(conversations: DataFrame, every: int = 100, most: int = 6, **columns: str) -> DataFrame:
    """``trie`` of the conversations rebuilt as branches (``branched``)."""
    return trie(*branched(*ordered_turns(conversations, **columns), every, most))


#: CRC-32 of a decimal number, bit by bit (polynomial 0xEDB88320).
CRC_SQL = """xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda z: CAST(0 AS BIGINT))), lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END))))"""

#: The rebuilt branches' trie, nodes keyed by the digests of all their turns, and every node with all below it.
BRANCHED_TRIE_SQL = f"""
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, count(*) AS n, {CRC_SQL} % 6 AS h FROM t GROUP BY conv_id),
rb AS (SELECT c.conv_id, least(c.h, coalesce(b.n, 0)) + pos - c.h AS d, role, text FROM t JOIN c USING (conv_id) LEFT JOIN c b ON b.conv_id = c.base WHERE pos > c.h
       UNION ALL SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= c.h),
q AS (SELECT c.conv_id, coalesce(s, []) AS s, coalesce(ch, []) AS ch FROM c LEFT JOIN (SELECT conv_id, list(sha256(length(role) || ':' || role || text) ORDER BY d) AS s, list(length(text) ORDER BY d) AS ch FROM rb GROUP BY conv_id) USING (conv_id)),
pre AS (SELECT conv_id, d, array_to_string(s[1:d], '') AS k, CASE WHEN d = 0 THEN 0 ELSE ch[d] END AS ch, d = len(s) AS ends FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM q)),
node AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(ch) AS ch, bool_and(ends) AS leaf, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS e FROM pre GROUP BY k, d)
SELECT any_value(a.conv_id) AS conv_id, a.d AS depth, any_value(p.conv_id) AS parent_conv_id, any_value(a.n_convs) AS n_convs, count(*) FILTER (b.d = a.d + 1) AS n_children, count(*) FILTER (b.leaf) AS n_leaves,
       CAST(sum((b.n_convs - 1) * b.ch) AS BIGINT) AS saved_tokens, sha256(any_value(a.e)) AS ends_sha256
FROM node a JOIN node b ON starts_with(b.k, a.k) LEFT JOIN node p ON a.d > 0 AND p.d = a.d - 1 AND p.k = left(a.k, 64 * (a.d - 1)) GROUP BY a.k, a.d
"""
