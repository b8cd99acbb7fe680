"""A dynamic index on Parquet: an append buffer, levels of sorted shards, and an atomically replaced manifest."""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.records import OP
from ..functions.rng import below
from ..operators import bloom, resolve
from ..operators.metrics import aux_bytes, observed
from ..operators.sample import dealt, fallen, numbered, sample, sent
from ..operators.shards import positions
from ..sources.shared import drop_written, written
from .layout import Config, File, Levels, Shard, closed_form, flushes

#: What a shard stores besides the op: its file's place in the shard's order, and the weight before it there.
STORED = T.StructType([*OP.fields, T.StructField("part", T.LongType()), T.StructField("lo", T.LongType())])
#: So many folders of the buffer are folded into one.
FOLD = 16
#: Scans that the files a sample needs are read in, each of another stretch of them.
SCANS = 16
#: Rows to a page of a file, about.
PAGE = 20_000


def folder() -> Column:
    """The name of the folder that a row was read from."""
    return F.element_at(F.split(F.input_file_name(), "/"), -2)


class Index:
    """Inserts, tombstones and tag deletes over a folder that any Hadoop file system can hold.

    One writer; a second one is told so. Everything on disk is an op log: shards hold live inserts and those deletes that
    haven't met their insert yet, in the order of (key, value, seq) over all their files. Driver-side state is the
    manifest: a few numbers for each shard and each of its files. Data moves only in flushes and merges, as Spark jobs.
    """

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        #: What each kept version names.
        self.named: dict[int, set[str]] = {}
        versions = self._versions()
        self.version = versions[-1] if versions else 0
        for v in versions[:-1]:
            self.named[v] = set(self._read_manifest(v)["names"])
        held = self._read_manifest(self.version) if versions else None
        self.config = Config(**held["config"]) if held else config or Config()
        self.state = Levels(self.config, [[self._shard(s) for s in lv] for lv in held["levels"]] if held else [])
        self.buffers: list[Shard] = [self._shard(b) for b in held["buffers"]] if held else []
        #: Batches up to a number, and those beyond it.
        self.upto, self.beyond = (held["upto"], set(held["beyond"])) if held else (-1, set())
        #: Snapshots and answers that have been handed out, with their version.
        self.handed: list[list] = held["handed"] if held else []
        #: Rejected draws by cause.
        self.rejects: dict[str, int] = held["rejects"] if held else {"tombstone": 0, "tag": 0, "range": 0}
        self.seconds = {"flush": 0.0, "merge": 0.0, "sample": 0.0, "load": 0.0}
        if held:
            self.named[self.version] = set(held["names"])
        else:
            self._write_manifest()

    # -- manifest ---------------------------------------------------------------------------------
    def _p(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _shard(self, held: dict) -> Shard:
        return Shard(**{**held, "files": [File(*f) for f in held["files"]]})

    def _list(self, name: str = "") -> dict[str, float]:
        """What is in a folder, with its time in seconds."""
        return {f.getPath().getName(): f.getModificationTime() / 1000 for f in self.fs.listStatus(self._p(name))} if self.fs.exists(self._p(name)) else {}

    def _versions(self) -> list[int]:
        return sorted(int(n[9:-5]) for n in self._list() if n.startswith("manifest-") and n.endswith(".json"))

    def _read_manifest(self, version: int) -> dict:
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.path}/manifest-{version}.json", wholetext=True).collect()))

    def _write_manifest(self) -> None:
        """The version after the one that this writer knows, under a name that nobody else has taken: written aside, then
        renamed without overwriting, so readers see all or nothing and two writers can't lose each other's ops."""
        version = self.version + 1
        self.handed = [h for h in self.handed if h[1] >= version - self.config.retain]
        shards = [s for lv in self.state.levels for s in lv] + self.buffers
        names = {s.path[len(self.path) + 1 :] for s in shards} | {name for name, _ in self.handed}
        text = json.dumps({"config": vars(self.config), "levels": [[vars(s) for s in lv] for lv in self.state.levels], "buffers": [vars(b) for b in self.buffers], "upto": self.upto, "beyond": sorted(self.beyond), "handed": self.handed, "rejects": self.rejects, "names": sorted(names)})
        jvm, aside = self.spark._jvm, self._p(f".manifest-{uuid.uuid4().hex}")
        out = self.fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self.fs.makeQualified(aside), self.fs.makeQualified(self._p(f"manifest-{version}.json")), options)
        except Exception as e:
            self.fs.delete(aside, True)
            if "FileAlreadyExists" in str(e):
                raise RuntimeError("another writer has changed the index") from e
            raise
        self.version = version
        self.named[version] = names

    def _current(self) -> None:
        """Stop early where another writer has gone on."""
        versions = self._versions()
        if versions and versions[-1] != self.version:
            raise RuntimeError("another writer has changed the index")

    def _has(self, batch: int | None) -> bool:
        return batch is not None and (batch <= self.upto or batch in self.beyond)

    def _done(self, batch: int | None) -> None:
        if batch is not None:
            self.beyond.add(batch)
            while self.upto + 1 in self.beyond:
                self.upto += 1
                self.beyond.discard(self.upto)

    def _sweep(self) -> None:
        """Delete manifests but this one and the ``retain`` before it, then what none of the kept ones names: retired shards, snapshots
        and answers of old, and what failed writes have left, once it is ``orphan_seconds`` old. Open readers of a kept version go on."""
        kept = self.version - self.config.retain
        for v in [v for v in self.named if v < kept]:
            self.fs.delete(self._p(f"manifest-{v}.json"), True)
            del self.named[v]
        alive = set().union(*self.named.values())
        alive |= {f"{name}-bloom" for name in alive}
        tops = {name.partition("/")[0] for name in alive}
        now = time.time()
        for name, at in self._list().items():
            if name.startswith("manifest-") or now - at < self.config.orphan_seconds:
                continue
            if name not in tops:
                self.fs.delete(self._p(name), True)
            elif name.startswith("load-"):
                for inner in self._list(name):
                    if f"{name}/{inner}" not in alive and not inner.startswith(("_", ".")):
                        self.fs.delete(self._p(f"{name}/{inner}"), True)

    # -- reading ----------------------------------------------------------------------------------
    def _paths(self, shards: list[Shard]) -> list[str]:
        return [s.path for s in shards if s.rows]

    def _read(self, paths: list[str], schema: T.StructType = OP) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _all(self) -> list[Shard]:
        """All shards from the deepest level up, then the buffer: the order of the line of draws."""
        return [s for lv in reversed(self.state.levels) for s in lv] + self.buffers

    def _parts(self, rows: int) -> int:
        """Ranges to deal so many ops to: files of ``file_rows``, or fewer for as many tasks as Spark's shuffles have."""
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return max(1, -(-rows // self.config.file_rows), min(tasks, rows // 20_000))

    def log(self) -> DataFrame:
        """All ops that count: shards and buffer."""
        return self._read(self._paths(self._all()))

    def live(self) -> DataFrame:
        return resolve.live(self.log(), self._parts(sum(s.rows for s in self._all())), True).select("key", "value", "weight", "seq")

    @contextmanager
    def _timed(self, what: str):
        began = time.time()
        yield
        self.seconds[what] += time.time() - began

    def sample(self, k: int, seed: int = 1, low: int | None = None, high: int | None = None, shards: int = 8, passes: int = 4, at_once: int = 250_000) -> DataFrame:
        """Weighted draws over what lives, of a key range or all: draw, key, value, weight.

        Draws fall on the line of all stored weight, dead records included: the shards from the deepest level up, each in its
        order of (key, value, seq), then the buffer in that order. A file's weight is in the manifest and a record's place in its file
        is stored with it, so only the files that a draw falls into are read, and the line is the same however many files a
        shard has. Of a key range, at most two files of each shard are looked into for where it begins and ends. The drawn
        (key, value)s are looked up among the deletes of files that may hold them; dead draws are drawn again, in
        ``passes`` passes that are made at once, and what is left after these is drawn from the resolved records, as are more than
        ``at_once`` draws. Each draw is exact. Rejections are counted by cause, and look-ups and rejections at the level with the delete, and
        compact where the index is set to do so (``max_rejection_rate`` below 1).
        """
        if k > at_once:
            return sample(self._ranged(self.live(), low, high), k, seed, shards, ("seq",))
        with self._timed("sample"):
            return self._sample_stored(k, seed, low, high, shards, passes)

    @staticmethod
    def _ranged(rows: DataFrame, low: int | None, high: int | None) -> DataFrame:
        if low is not None:
            rows = rows.where(F.col("key") >= low)
        return rows if high is None else rows.where(F.col("key") <= high)

    def _line(self, low: int | None, high: int | None) -> list[tuple[int, Shard, File, int, int]]:
        """The files that the line consists of, as (level, shard, file, from, to): all of a file's weight, or the stretch with the range's keys."""
        out, cut = [], []
        for level in reversed(range(len(self.state.levels))):
            for s in self.state.levels[level]:
                for f in s.files:
                    inside = f.within(low, high)
                    if f.weight and inside is not False:
                        if inside is None:
                            cut.append(f"{s.path}/{f.name}")
                        out.append([level, s, f, 0, f.weight if inside else 0])
        if cut:
            rows = self._ranged(self._read(cut, STORED).withColumn("folder", folder()), low, high).where("weight > 0")
            ends = {(r.folder, r.part): (r.a, r.b) for r in rows.groupBy("folder", "part").agg(F.min("lo").alias("a"), F.max(F.col("lo") + F.col("weight")).alias("b")).collect()}
            for x in out:
                if not x[4]:
                    x[3:] = ends.get((x[1].path.rpartition("/")[2], x[2].part), (0, 0))
        return [tuple(x) for x in out if x[4] > x[3]]

    def _deletes_of(self, drawn: DataFrame, keys: np.ndarray) -> DataFrame:
        """The drawn (key, value)s that deletes are stored for: the newest level with one (-1: the buffer), and a delete's kind.

        Files are left out whose keys can't be among the drawn, or, with filters, whose shard's filter has none of them.
        """
        may = self._may_delete(keys)
        found = []
        for level, s in [(i, s) for i, lv in enumerate(self.state.levels) for s in lv if s.path in may]:
            found += [(level, f"{s.path}/{f.name}") for f in s.files if f.deletes and f.covers(may[s.path])]
        found += [(-1, b.path) for b in self.buffers if b.path in may]
        parts = [self._read([p for i, p in found if i == level]).where("op != 'I'").select("key", "value", "op", F.lit(level).alias("level")) for level in sorted({i for i, _ in found})]
        deletes = self.spark.createDataFrame([], "key long, value long, op string, level int")
        for p in parts:
            deletes = deletes.unionByName(p)
        return written(deletes.join(drawn.select("key", "value").distinct(), ["key", "value"], "left_semi").groupBy("key", "value").agg(F.min("level").alias("at"), F.max("op").alias("kind")), "deletes")

    def _may_delete(self, keys: np.ndarray) -> dict[str, np.ndarray]:
        """The shards and buffers that may hold deletes of the sorted ``keys``, with the keys: all with deletes, or what one probe of all their filters tells."""
        some = [s for s in self._all() if s.tombstones]
        if not self.config.filters or not some or not len(keys):
            return {s.path: keys for s in some}
        source = {s.path.rpartition("/")[2] + "-bloom": s.path for s in some}
        filters = self.spark.read.parquet(*[f"{s.path}-bloom" for s in some]).withColumn("source", folder())
        asked = self.spark.createDataFrame(pa.table({"key": pa.array(keys)})).select("key", F.explode(F.array(*[F.lit(x) for x in source])).alias("source"))
        out: dict[str, list[int]] = {}
        for r in bloom.may_hold(asked, filters, source="source").where("may").select("source", "key").collect():
            out.setdefault(source[r.source], []).append(r.key)
        return {path: np.sort(np.array(x, dtype=np.int64)) for path, x in out.items()}

    def _fallen(self, placed: DataFrame, line: list[tuple[int, Shard, File, int, int]]) -> DataFrame:
        """The records that draws (draw, shard: the place in ``line``, at) fall on, with their level.

        Reads the files in question only, and little of each: the draws, ``at_once`` * ``passes`` of 24 bytes at most, are put in order of their place
        in the file and taken in ``SCANS`` groups; a group's scan has that stretch of ``lo`` as a filter, which skips the pages
        of a file that are elsewhere. The draws then meet the records in the records' tasks.
        """
        shard, at, draw = sent(placed.where(F.col("shard") < len(line)))
        if not len(shard):
            return self.spark.createDataFrame([], "draw long, level int, key long, value long, weight long, seq long")
        at = at + np.array([x[3] for x in line])[shard]
        draws = self.spark.sparkContext.broadcast((shard, at, draw))
        known = self.spark.createDataFrame([(x[1].path.rpartition("/")[2], x[2].part, i, x[0]) for i, x in ((i, line[i]) for i in np.unique(shard).tolist())], "folder string, part long, place int, level int")
        rows, pages = None, max(line[i][2].rows for i in np.unique(shard).tolist()) // PAGE + 1
        for group in np.array_split(np.argsort(at, kind="stable"), min(SCANS, pages, len(at))):
            files = [line[i] for i in np.unique(shard[group]).tolist()]
            low = int(at[group].min()) - max(x[2].most for x in files)
            scan = self._read([f"{x[1].path}/{x[2].name}" for x in files], STORED).where((F.col("lo") > low) & (F.col("lo") <= int(at[group].max())))
            scan = scan.withColumn("folder", folder())
            rows = scan if rows is None else rows.unionByName(scan)
        # a record may come in two groups' scans: each draw falls on it once
        found = fallen(rows.join(F.broadcast(known), ["folder", "part"]), draws, ["level", "key", "value", "weight", "seq"])
        return found.dropDuplicates(["draw"])

    def _sample_stored(self, k: int, seed: int, low: int | None, high: int | None, shards: int, passes: int) -> DataFrame:
        spark, pair = self.spark, ["key", "value"]
        line = self._line(low, high)
        buffer = self._ranged(self._read(self._paths(self.buffers)), low, high).where("op = 'I' and weight > 0")
        ends = np.cumsum([0, *(b - a for *_, a, b in line)]).tolist()
        places = [(i, ends[i], ends[i + 1]) for i in range(len(line))]
        pieces, known = None, []
        if self.buffers:  # sorted ranges, each a place, however large the buffer is
            parts = self._parts(sum(b.rows for b in self.buffers))
            ranged = buffer.repartitionByRange(parts, *pair, "seq").sortWithinPartitions(*pair, "seq").withColumn("slice", F.lit(0).cast("long"))
            pieces = written(numbered(ranged, "slice"), "pieces")
            for r in pieces.groupBy("part").agg(F.sum("weight").alias("w")).orderBy("part").collect():
                before = places[-1][2] if places else 0
                known.append((r.part, len(places)))
                places.append((len(places), before, before + r.w))
        if not places:
            return spark.createDataFrame([], "draw long, key long, value long, weight long")
        tries = spark.range(k).select(F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"), F.col("id").alias("d"))
        tries = tries.select((F.col("d") * passes + F.col("pass")).alias("draw"), below(F.lit(places[-1][2]), seed, F.col("d"), F.col("pass")).alias("r"))
        placed = written(dealt(tries, places).select("draw", "shard", "at"), "tries")
        hits = self._fallen(placed, line)
        if known:
            rows = pieces.join(F.broadcast(spark.createDataFrame(known, "part long, place int")), "part")
            late = fallen(rows, spark.sparkContext.broadcast(sent(placed.where(F.col("shard") >= len(line)))), ["key", "value", "weight", "seq"])
            hits = hits.unionByName(late.withColumn("level", F.lit(-1)))
        drawn = written(hits, "drawn")
        deletes = self._deletes_of(drawn, self._keys(drawn)) if any(s.tombstones for s in self._all()) else None
        if deletes is not None:
            dubious = self._keys(deletes)
            paths = [f"{s.path}/{f.name}" for lv in self.state.levels for s in lv for f in s.files if f.covers(dubious)] + self._paths(self.buffers)
            alive = resolve.live(self._read(paths if len(dubious) else []).join(deletes, pair, "left_semi"), self._parts(len(dubious))).select(*pair, "seq", F.lit(True).alias("lives"))
            told = drawn.join(deletes, pair, "left").join(alive, [*pair, "seq"], "left")
            told = written(told.withColumn("dead", F.col("at").isNotNull() & F.col("lives").isNull()).drop("lives"), "told")
            drop_written(deletes)
        else:
            told = drawn.withColumns({"dead": F.lit(False), "at": F.lit(None).cast("int"), "kind": F.lit(None).cast("string")})
        first = told.where("not dead").withColumn("d", F.expr(f"draw div {passes}")).groupBy("d").agg(F.min_by(F.struct("key", "value", "weight"), "draw").alias("x"))
        first = written(first.select(F.col("d").alias("draw"), "x.*"), "sample")
        # look-ups go from the newest level down to the one with the delete
        dead = {(r["at"], r["kind"]): r["count"] for r in told.where("dead").groupBy("at", "kind").count().collect()}
        for (_, kind), n in dead.items():
            self.rejects["tag" if kind == "D" else "tombstone"] += n
        if self.config.max_rejection_rate < 1:
            at = lambda level: sum(n for (i, _), n in dead.items() if i == level)
            asked = told.count() - at(-1)
            for level in range(len(self.state.levels)):
                self._count_rejections(level, asked, at(level))
                asked -= at(level)
            self._enforce_rejections()
        for old in (placed, drawn, told, *([pieces] if pieces is not None else [])):
            drop_written(old)
        if first.count() == k:
            return first
        rest = spark.range(k).select(F.col("id").alias("draw")).join(first.select("draw"), "draw", "left_anti")
        return first.unionByName(sample(self._ranged(self.live(), low, high), k, seed, shards, ("seq",)).join(rest, "draw", "left_semi"))

    def _keys(self, drawn: DataFrame) -> np.ndarray:
        """Their distinct keys in order: as many as there are draws at most."""
        return np.sort(drawn.where("key is not null").select("key").distinct().toArrow().column("key").to_numpy())

    # -- writing ----------------------------------------------------------------------------------
    def _store_buffer(self, ops: DataFrame) -> Shard:
        path = f"{self.path}/buffer-{uuid.uuid4().hex}"
        seen, counted = observed(ops.select(*OP.names), f"stored-{uuid.uuid4().hex}")  # counted as it is written
        seen.write.parquet(path)
        r = counted.get
        return self._filtered(Shard(path, r["ops"], r["deletes"], r["weight"] or 0))

    def _filtered(self, shard: Shard) -> Shard:
        if self.config.filters and shard.tombstones:
            bloom.build(self._read([shard.path]).where("op != 'I'"), shard.tombstones, path=f"{shard.path}-bloom")
        return shard

    def _store(self, sorted_ops: DataFrame, path: str, sliced: str | None = None) -> None:
        """Ops that come in order, range by range, with the range and the weight before each op in it; ``sliced``: by the column slice, in folders with that prefix."""
        slices = F.col("slice") if sliced else F.lit(0)
        stored = numbered(sorted_ops.select(*OP.names, slices.cast("long").alias("slice")), "slice")
        if sliced:
            stored.withColumn("slice", F.concat(F.lit(f"{sliced}-"), "slice")).write.partitionBy("slice").parquet(path)
        else:
            stored.drop("slice").write.parquet(path)

    def _described(self, paths: list[str]) -> list[Shard]:
        """Shards as they stand on disk: a row for each file."""
        paths = [p for p in paths if self.fs.exists(self._p(p[len(self.path) + 1 :]))]
        files: dict[str, list[File]] = {}
        if paths:
            rows = self._read(paths, STORED).withColumn("folder", folder()).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
            whole = F.count_if(F.col("key").isNull()) == 0
            counts = rows.groupBy("folder", "file", "part").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.count_if(F.col("op") != "I").alias("t"), F.when(whole, F.min("key")).alias("a"), F.when(whole, F.max("key")).alias("b"), F.max("weight").alias("m"))
            for r in counts.orderBy("part").collect():
                files.setdefault(r.folder, []).append(File(r.file, r.part, r.n, r.w, r.t, r.a, r.b, r.m))
        out = []
        for p in paths:
            mine = files.get(p.rpartition("/")[2], [])
            out.append(self._filtered(Shard(p, sum(f.rows for f in mine), sum(f.deletes for f in mine), sum(f.weight for f in mine), files=mine)))
        return out

    def _merge(self, shards: list[Shard], bottom: bool) -> Shard:
        """One sorted shard; met pairs vanish, and at the bottom so do deletes, as nothing older can meet them.

        A shard that comes alone and has nothing to lose only changes its level: no file is written.
        """
        some = [s for s in shards if s.rows]
        if len(some) <= 1 and not (bottom and some and some[0].tombstones):
            return replace((some or shards)[0], checks=0, rejections=0)
        with self._timed("merge"):
            path = f"{self.path}/shard-{uuid.uuid4().hex}"
            marked = resolve.brackets(self._read(self._paths(some)), self._parts(sum(s.rows for s in some)), ordered=True).where("alive")
            self._store(marked.where("op = 'I'") if bottom else marked, path)
            return self._described([path])[0]

    def _flush(self, ops: DataFrame, bounds: list[tuple[int, int]], bottom: bool) -> tuple[list[Shard], list[Shard]]:
        """Shards of the ops from one place to another in the order of seq, and the buffer of those of the last bounds: all in one job,
        each shard's pairs that have met left out, and where the first is the bottom, its deletes."""
        n, size = bounds[-1][1], bounds[0][1]
        placed = positions(ops, "seq", "key", "value", per_range=max(1000, min(1_000_000, size)))
        last = len(bounds) - 1
        if all(b - a == size for a, b in bounds[:-1]):
            number = F.least(F.expr(f"pos div {size}L"), F.lit(last))
        else:  # as many as there are shards
            number = F.lit(0)
            for i, (a, _) in enumerate(bounds):
                number = F.when(F.col("pos") >= a, i).otherwise(number)
        marked = resolve.brackets(placed.select(*OP.names, number.cast("long").alias("slice")), self._parts(n), ("slice", "key", "value"), True)
        kept = marked.where(F.col("alive") | (F.col("slice") == last))
        if bottom:
            kept = kept.where((F.col("slice") > 0) | (F.col("op") == "I") | F.lit(last == 0))
        tag = uuid.uuid4().hex
        self._store(kept, f"{self.path}/load-{tag}", tag)
        paths = [f"{self.path}/load-{tag}/slice={tag}-{i}" for i in range(len(bounds))]
        there = {s.path: s for s in self._described(paths)}
        made = [there.get(p, Shard(p, 0)) for p in paths]
        return made[:last], [replace(s, files=[]) for s in made[last:] if s.rows]

    def append(self, ops: DataFrame, batch: int | None = None) -> None:
        """Add ops (seq, key, value, weight, op). A batch number that has been added is skipped, so replays do nothing.

        The buffer is flushed in slices of ``buffer_cap`` ops in the order of seq, each by the append that comes after it is
        full; however many slices a batch has, one job makes all their shards. Many small appends are folded into one folder of the buffer.
        """
        self._current()
        if self._has(batch):
            return
        new = self._store_buffer(ops)
        if new.rows:
            self.buffers.append(new)
        held, cap = sum(b.rows for b in self.buffers), self.config.buffer_cap
        if held > cap:
            with self._timed("flush"):
                n = flushes(held, cap)
                made, self.buffers = self._flush(self._read(self._paths(self.buffers)), [(i * cap, (i + 1) * cap) for i in range(n)] + [(n * cap, held)], False)
                for s in made:
                    self.state.add(s, self._merge)
        elif len(self.buffers) >= FOLD:
            self.buffers = [self._store_buffer(self._read(self._paths(self.buffers)).coalesce(self._parts(held)))]
        self._done(batch)
        self._write_manifest()
        self._sweep()

    def bulk_load(self, ops: DataFrame, batch: int | None = None) -> None:
        """Add ops to an empty index at once: they are put in order and each goes straight into the shard it would
        end up in, or the buffer, so that nothing is merged. One job makes all shards."""
        self._current()
        if self.state.levels or self.buffers:
            raise ValueError("the index holds something already: append")
        if self._has(batch):
            return
        with self._timed("load"):
            n = ops.count()
            bounds = []
            for lv in reversed(closed_form(n, self.config)):
                size = lv["rows"] // lv["shards"]
                bounds += [(lv["level"], lv["first"] + i * size, lv["first"] + (i + 1) * size) for i in range(lv["shards"])]
            if n:
                made, self.buffers = self._flush(ops, [(a, b) for _, a, b in bounds] + [(bounds[-1][2] if bounds else 0, n)], bool(bounds))
                self.state.levels = [[] for _ in range(bounds[0][0] + 1)] if bounds else []
                for (level, _, _), s in zip(bounds, made, strict=True):
                    self.state.levels[level].append(s)
            self._done(batch)
        self._write_manifest()
        self._sweep()

    def delete(self, requests: DataFrame, batch: int | None = None) -> DataFrame:
        """Delete (seq, key, value); returns the requests with ``found``: 1 where a live record of its own was met.

        Of two requests for one record, the first finds it. With a batch number, a replay deletes nothing and is told the same, for
        ``retain`` versions.
        """
        name = f"found-{uuid.uuid4().hex if batch is None else batch}"
        if not self._has(batch):
            resolve.met(requests, self.live()).write.mode("overwrite").parquet(f"{self.path}/{name}")
            self.handed.append([name, self.version + 1])
            self.append(requests.select("seq", "key", "value", F.lit(0).cast("long").alias("weight"), F.lit("D" if self.config.deletes == "tag" else "T").alias("op")), batch)
        return self.spark.read.parquet(f"{self.path}/{name}")

    def erase(self, requests: DataFrame, batch: int | None = None) -> DataFrame:
        """Delete one live record for each (seq, key), as a tree does: the smallest value and seq first. Like ``delete``."""
        nth = F.row_number()
        there = self.live().join(requests.select("key").distinct(), "key", "left_semi").select("key", "value", nth.over(Window.partitionBy("key").orderBy("value", "seq")).alias("nth"))
        asked = requests.select("seq", "key", nth.over(Window.partitionBy("key").orderBy("seq")).alias("nth"))
        return self.delete(written(asked.join(there, ["key", "nth"], "left").select("seq", "key", "value"), "erase"), batch)

    def _count_rejections(self, level: int, checks: int, rejections: int) -> None:
        for s in self.state.levels[level][:1]:
            s.checks += checks
            s.rejections += rejections

    def _enforce_rejections(self) -> None:
        self._current()
        self.state.enforce_rejections(self._merge)
        self._write_manifest()
        self._sweep()

    def observe_rejections(self, level: int, checks: int, rejections: int) -> None:
        """Count look-ups against a level, and compact what rejects too often."""
        self._count_rejections(level, checks, rejections)
        self._enforce_rejections()

    def compact_all(self) -> DataFrame:
        """A static snapshot: everything that lives, written as sorted ranges beside the shards, which stay. It is kept for ``retain`` versions."""
        name = f"static-{uuid.uuid4().hex}"
        self.live().write.parquet(f"{self.path}/{name}")  # in order, range by range
        self.handed.append([name, self.version + 1])
        return self.spark.read.parquet(f"{self.path}/{name}")

    def destroy(self) -> None:
        """Delete everything that is stored; the index is empty then, and its folder gone."""
        self.fs.delete(self._p(""), True)
        self.state, self.buffers, self.handed, self.upto, self.beyond = Levels(self.config), [], [], -1, set()
        self.version, self.named = 0, {}

    # -- metrics ----------------------------------------------------------------------------------
    def metrics(self) -> dict:
        shards = [s for lv in self.state.levels for s in lv]
        held = self.buffers
        length = lambda s: self.fs.getContentSummary(self._p(s.path[len(self.path) + 1 :])).getLength()
        blooms = [self._p(f"{s.path[len(self.path) + 1 :]}-bloom") for s in shards + held]
        return {
            "records": sum(s.rows for s in shards + held),
            "tombstones": sum(s.tombstones for s in shards + held),
            "height": len(self.state.levels),
            "shards": [len(lv) for lv in self.state.levels],
            "weight": sum(s.weight for s in shards + held),
            "buffered": sum(s.rows for s in held),
            "deletes_over_cap": max(0, sum(s.tombstones for s in held) - self.config.tombstone_cap),
            "proportions": [sum(s.tombstones for s in lv) / max(1, sum(s.tombstones + s.rows for s in lv)) for lv in self.state.levels],
            "checks": [sum(s.checks for s in lv) for lv in self.state.levels],
            "rejections": [sum(s.rejections for s in lv) for lv in self.state.levels],
            "rejects": dict(self.rejects),
            "aux_bytes": sum(aux_bytes(s.tombstones) for s in shards + held) if self.config.filters else 0,
            "stored_aux_bytes": sum(self.fs.getContentSummary(p).getLength() for p in blooms if self.fs.exists(p)),
            "seconds": dict(self.seconds),
            "tombstones_valid": all(p <= self.config.max_tombstone_prop for p in self.state.tombstone_props()),
            "bytes": sum(length(s) for s in shards + held if s.rows),
            "files": sum(len(s.files) for s in shards),
        }
