"""The registered queries over the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import OP, coerce_weight, coordinate_key, op_log, records
from ..functions.rng import bits_sql
from ..operators import bloom, metrics, resolve, shards, weights
from ..operators import sample as sampling
from ..sources import tsv, workload
from ..sources.shared import work_path
from ..streaming.ingest import ingest, ingest_lines, interleave
from .layout import Config, closed_form, digits, flushes, level_capacity
from .store import Index

SHARDS, SEED, DRAWS = 8, 7, 2000
CAP, SCALE = 100, 2


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def orders(spark: SparkSession, d: str) -> DataFrame:
    """The main weighted set: orders by price in cents."""
    return records(table(spark, d, "orders"), "o_orderkey", "o_custkey", coerce_weight(F.col("o_totalprice"), 100))


def graded(spark: SparkSession, d: str) -> DataFrame:
    return records(table(spark, d, "orders"), "o_orderkey", "o_custkey", coerce_weight(F.col("o_totalprice"), 100), F.col("o_orderpriority").alias("grade"))


def ops(spark: SparkSession, d: str) -> DataFrame:
    """The op log: events by user, errors are tombstones."""
    value = F.get_json_object("props", "$.k").cast("long") % 4
    op = F.when(F.col("event_type") == "error", "T").otherwise("I")
    return op_log(table(spark, d, "events"), "event_id", F.col("user_id"), value, coerce_weight(F.col("value"), 100), op)


def documents(spark: SparkSession, d: str) -> DataFrame:
    return records(table(spark, d, "documents"), "doc_id", "n_chars", F.col("n_chars"))


def toxic(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("key"))


def leveled(spark: SparkSession, d: str) -> DataFrame:
    """The op log placed in levels and shards as after that many appends; what is still buffered has level and shard -1."""
    log = ops(spark, d)
    config = Config(buffer_cap=CAP, scale_factor=SCALE)
    levels = closed_form(log.count(), config)
    level, shard = F.lit(-1), F.lit(-1)
    for lv in levels:
        inside = (F.col("seq") >= lv["first"]) & (F.col("seq") < lv["end"])
        level = F.when(inside, lv["level"]).otherwise(level)
        shard = F.when(inside, F.floor((F.col("seq") - lv["first"]) / (lv["rows"] // lv["shards"])).cast("int")).otherwise(shard)
    return log.select("*", level.alias("level"), shard.alias("shard"), (F.col("op") == "T").alias("is_tombstone"), F.lit(False).alias("is_deleted"))


R_ = "SELECT o_orderkey AS key, o_custkey AS value, CAST(round(o_totalprice * 100) AS BIGINT) AS weight, o_orderpriority AS grade, o_orderstatus AS status FROM orders"
O_ = "SELECT event_id AS seq, user_id AS key, CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS value, CASE WHEN event_type = 'error' THEN 0 ELSE CAST(round(value * 100) AS BIGINT) END AS weight, CASE WHEN event_type = 'error' THEN 'T' ELSE 'I' END AS op FROM events"
W_ = f"""WITH rec AS ({R_}), ops AS ({O_}),
run AS (SELECT *, sum(CASE op WHEN 'I' THEN 1 ELSE -1 END) OVER (PARTITION BY key, value ORDER BY seq) AS run FROM ops),
br AS (SELECT *, CASE WHEN op = 'I' THEN min(run) OVER (PARTITION BY key, value ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) >= run
       ELSE run < 0 AND run < coalesce(min(run) OVER (PARTITION BY key, value ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS alive FROM run),
live AS (SELECT seq, key, value, weight FROM br WHERE op = 'I' AND alive),
docs AS (SELECT doc_id AS key, n_chars AS value, n_chars AS weight FROM documents),
tox AS (SELECT doc_id AS key FROM labels WHERE toxic = 1)
"""


def lookup_sql(source: str, draws: str = "", k: int = DRAWS, order: str = f"key % {SHARDS}, key, value", hash_: str = "", columns: str = "draw, key, value, weight") -> str:
    """Draws over the line of all weight of ``source``, by an interval join."""
    h = hash_ or bits_sql(f"'{SEED}'", "draw")
    return f""", cdf AS (SELECT *, CAST(sum(weight) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi FROM ({source}) WHERE weight > 0),
tot AS (SELECT CAST(sum(weight) AS BIGINT) AS w FROM cdf),
dr AS (SELECT draw, {h} % w AS r FROM (SELECT unnest(range({k})) AS draw), tot WHERE w > 0)
SELECT {columns} FROM dr JOIN cdf ON r >= hi - weight AND r < hi"""


Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def seq_of(df: DataFrame) -> DataFrame:
    """Orders as inserts; order keys stand for the sequence."""
    return df.withColumn("seq", F.col("key"))


# -- ingest ---------------------------------------------------------------------------------------
query("record_normalize", W_ + "SELECT key, value, weight FROM rec")(orders)
query("tombstone_weight_zero", W_ + "SELECT seq, key, value, weight, op FROM ops")(ops)
query("buffer_tombstone_cap", W_ + "SELECT seq, op <> 'T' OR sum(CASE op WHEN 'T' THEN 1 ELSE 0 END) OVER (PARTITION BY seq // 1000 ORDER BY seq) <= 150 AS accepted FROM ops")(
    lambda s, d: resolve.accept(ops(s, d), 1000, 150).select("seq", "accepted")
)
query("coord_key", "SELECT c_custkey, CAST(trunc((c_acctbal / 100 + 180) * 1e7) AS BIGINT) AS key FROM customer")(lambda s, d: table(s, d, "customer").select("c_custkey", coordinate_key(F.col("c_acctbal") / 100).alias("key")))


@query("tsv_scan", W_ + "SELECT count(*) AS n, min(key) AS min_key, max(key) AS max_key FROM rec")
def tsv_scan(spark: SparkSession, d: str) -> DataFrame:
    """Records written as tab-separated text to the shared folder and read again."""
    path = work_path(spark, "tsv")
    tsv.write_records(orders(spark, d), path)
    return tsv.key_bounds(tsv.read_records(spark, path))


query("batched_reader", W_ + "SELECT seq // 1000 AS batch, count(*) AS n, CAST(sum(weight) AS BIGINT) AS weight FROM ops GROUP BY 1")(
    lambda s, d: tsv.batches(ops(s, d), 1000).groupBy("batch").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
)
query("key_weight_reader", W_ + "SELECT key, weight FROM rec")(lambda s, d: tsv.pairs(orders(s, d), with_value=False))
query("pair_reader", W_ + "SELECT key, value, weight FROM rec")(lambda s, d: tsv.pairs(orders(s, d)).select("pair.key", "pair.value", "weight"))
query(
    "mixed_workload",
    W_ + f"SELECT seq * 2 AS seq, key, value, weight, 'I' AS op FROM (SELECT *, key AS seq FROM rec) UNION ALL SELECT key * 2 + 1, key, value, 0, 'T' FROM rec WHERE key >= 1000 AND {bits_sql('1', 'key')} % 1000 < 50",
)(lambda s, d: workload.mixed_log(seq_of(orders(s, d)), 50, after=1000))
query(
    "selectivity_range",
    W_ + f", b AS (SELECT min(key) AS lo, max(key) AS hi FROM rec), l AS (SELECT *, CAST(trunc((hi - lo) * 100 / 1000.0) AS BIGINT) AS n FROM b) SELECT lo + {bits_sql('1', chr(39) + 'range' + chr(39))} % (hi - lo - n + 1) AS low, lo + {bits_sql('1', chr(39) + 'range' + chr(39))} % (hi - lo - n + 1) + n AS high FROM l",
)(lambda s, d: workload.key_range(tsv.key_bounds(orders(s, d)), 100))

# -- deletes --------------------------------------------------------------------------------------
query("tag_delete_live", W_ + "SELECT key, value, weight FROM docs ANTI JOIN tox USING (key)")(lambda s, d: resolve.drop_tagged(documents(s, d), toxic(s, d), ["key"]))
query("tag_delete_found", W_ + "SELECT r.key, CAST(r.key IN (SELECT key FROM docs) AS INTEGER) AS found FROM (SELECT key FROM tox UNION ALL SELECT key + 10000000 FROM tox) r")(
    lambda s, d: resolve.found(toxic(s, d).unionByName(toxic(s, d).select((F.col("key") + 10_000_000).alias("key"))), documents(s, d), ["key"])
)
query("tombstone_live", W_ + "SELECT seq, key, value, weight FROM live")(lambda s, d: resolve.live(ops(s, d)).select("seq", "key", "value", "weight"))
query("tombstone_unmatched", W_ + "SELECT seq, key, value FROM br WHERE op = 'T' AND alive")(lambda s, d: resolve.unmatched(ops(s, d)).select("seq", "key", "value"))
query("anti_lookup", W_ + "SELECT seq, NOT alive AS deleted FROM br WHERE op = 'I'")(
    lambda s, d: resolve.deleted_later(ops(s, d)).select("seq", "deleted")
)
query("buffer_flush", W_ + "SELECT * FROM (SELECT seq, key, value, op, CASE WHEN op = 'I' THEN min(run) OVER w1 >= run ELSE run < 0 AND run < coalesce(min(run) OVER w2, 0) END AS alive FROM (SELECT *, sum(CASE op WHEN 'I' THEN 1 ELSE -1 END) OVER (PARTITION BY buffer, key, value ORDER BY seq) AS run FROM (SELECT *, seq // 1000 AS buffer FROM ops)) WINDOW w1 AS (PARTITION BY buffer, key, value ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), w2 AS (PARTITION BY buffer, key, value ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE alive")(
    lambda s, d: resolve.brackets(tsv.batches(ops(s, d), Config().buffer_cap), by=("batch", "key", "value")).where("alive").select("seq", "key", "value", "op", "alive")
)

# -- sort and merge -------------------------------------------------------------------------------
query("sorted_run", W_ + f"SELECT CAST(key % {SHARDS} AS INTEGER) AS shard, row_number() OVER (PARTITION BY key % {SHARDS} ORDER BY key, value) - 1 AS pos, key, value FROM rec")(
    lambda s, d: shards.sorted_run(orders(s, d), SHARDS).select("shard", "pos", "key", "value")
)
query("kway_merge", W_ + "SELECT row_number() OVER (ORDER BY key, value) - 1 AS pos, key, value, weight FROM rec")(
    lambda s, d: shards.positions(shards.merge(*(orders(s, d).where(f"key % 3 = {i}") for i in range(3))), "key", "value").select("pos", "key", "value", "weight")
)
query("merge_cancel", W_ + "SELECT seq, key, value, op = 'T' AS is_tombstone FROM br WHERE alive")(
    lambda s, d: resolve.brackets(shards.merge(*(resolve.brackets(ops(s, d).where(c)).where("alive").drop("alive") for c in ("seq < 5000", "seq >= 5000")))).where("alive").select("seq", "key", "value", (F.col("op") == "T").alias("is_tombstone"))
)
query("drop_tagged", W_ + "SELECT key, value, weight FROM rec WHERE status <> 'F'")(
    lambda s, d: resolve.drop_tagged(orders(s, d), table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key")), ["key"])
)
query("static_snapshot", W_ + "SELECT row_number() OVER (ORDER BY key, value, seq) - 1 AS pos, key, value, weight FROM live")(
    lambda s, d: shards.positions(resolve.live(ops(s, d)), "key", "value", "seq").select("pos", "key", "value", "weight")
)


def probes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select((F.col("c_custkey") % SHARDS).cast("int").alias("shard"), (F.col("c_custkey") * 13).alias("x"))


query(
    "lower_bound",
    W_ + f", run2 AS (SELECT key % {SHARDS} AS shard, key, row_number() OVER (PARTITION BY key % {SHARDS} ORDER BY key, value) - 1 AS pos FROM rec), p AS (SELECT c_custkey % {SHARDS} AS shard, c_custkey * 13 AS x FROM customer) SELECT CAST(p.shard AS INTEGER) AS shard, x, (SELECT min(pos) FROM run2 WHERE run2.shard = p.shard AND run2.key >= x) AS pos FROM p",
)(lambda s, d: shards.lower_bound(shards.sorted_run(orders(s, d), SHARDS), probes(s, d)).select("shard", "x", "pos"))
query("record_at", W_ + f"SELECT * FROM (SELECT CAST(key % {SHARDS} AS INTEGER) AS shard, row_number() OVER (PARTITION BY key % {SHARDS} ORDER BY key, value) - 1 AS pos, key, value, weight FROM rec)")(
    lambda s, d: shards.record_at(shards.sorted_run(orders(s, d), SHARDS), shards.sorted_run(orders(s, d), SHARDS).select("shard", "pos")).select("shard", "pos", "key", "value", "weight")
)

# -- layout ---------------------------------------------------------------------------------------
DIGITS = f"""WITH RECURSIVE f(i, rest, d) AS (
  SELECT -1, CASE WHEN n = 0 THEN 0 ELSE (n - 1) // {CAP} END, 0 FROM (SELECT count(*) AS n FROM orders)
  UNION ALL SELECT i + 1, (rest - CASE WHEN rest % {SCALE} = 0 THEN {SCALE} ELSE rest % {SCALE} END) // {SCALE}, CASE WHEN rest % {SCALE} = 0 THEN {SCALE} ELSE rest % {SCALE} END FROM f WHERE rest > 0),
lv AS (SELECT i AS level, d, CAST(d * power({SCALE}, i) * {CAP} AS BIGINT) AS n FROM f WHERE i >= 0)
"""


def loaded(spark: SparkSession, d: str, policy: str = "tiering") -> Index:
    """All orders loaded at once into an index."""
    index = Index(spark, work_path(spark, "index"), Config(CAP, SCALE, layout=policy))
    index.bulk_load(seq_of(orders(spark, d)).withColumn("op", F.lit("I")))
    return index


def layout(policy: str):
    """The levels and shards that appends would make, as they stand in the manifest after a load."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        levels = loaded(spark, d, policy).state.levels
        return spark.createDataFrame([(i, len(lv), sum(x.rows for x in lv)) for i, lv in enumerate(levels)], "level int, shards int, n long")

    return run


query("layout_tiering", DIGITS + "SELECT CAST(level AS INTEGER) AS level, CAST(d AS INTEGER) AS shards, n FROM lv")(layout("tiering"))
query("layout_leveling", DIGITS + "SELECT CAST(level AS INTEGER) AS level, CAST(1 AS INTEGER) AS shards, n FROM lv")(layout("leveling"))
query("level_capacity", DIGITS + f"SELECT CAST(level AS INTEGER) AS level, CAST({CAP} * power({SCALE}, level + 1) AS BIGINT) AS capacity FROM lv")(
    lambda s, d: s.createDataFrame([(i, level_capacity(Config(CAP, SCALE), i)) for i in range(len(loaded(s, d).state.levels))], "level int, capacity long")
)
query("height", DIGITS + "SELECT CAST(count(*) AS INTEGER) AS height FROM lv")(lambda s, d: s.createDataFrame([(loaded(s, d).metrics()["height"],)], "height int"))
query("flush_count", f"SELECT CASE WHEN count(*) = 0 THEN 0 ELSE (count(*) - 1) // {CAP} END AS flushes FROM orders")(
    lambda s, d: s.createDataFrame([(sum(f.rows for lv in loaded(s, d).state.levels for x in lv for f in x.files) // CAP,)], "flushes long")
)

# -- weights --------------------------------------------------------------------------------------
query("shard_weights", W_ + f"SELECT CAST(key % {SHARDS} AS INTEGER) AS shard, count(*) AS n, CAST(sum(weight) AS BIGINT) AS weight FROM rec GROUP BY 1")(lambda s, d: weights.shard_weights(orders(s, d), SHARDS))
query("total_weight", W_ + "SELECT CAST(sum(weight) AS BIGINT) AS weight FROM live")(lambda s, d: resolve.live(ops(s, d)).agg(F.sum("weight").alias("weight")))
query("max_weight", W_ + "SELECT max(weight) AS weight FROM live")(lambda s, d: resolve.live(ops(s, d)).agg(F.max("weight").alias("weight")))
query("cdf_intervals", W_ + f"SELECT key, value, CAST(sum(weight) OVER w - weight AS BIGINT) AS lo, CAST(sum(weight) OVER w AS BIGINT) AS hi FROM rec WHERE weight > 0 WINDOW w AS (PARTITION BY key % {SHARDS} ORDER BY key, value)")(
    lambda s, d: weights.intervals(orders(s, d).withColumn("shard", shards.shard_of(SHARDS)), "shard").select("key", "value", "lo", "hi")
)
query("normalized_weights", W_ + "SELECT key, CAST(CAST(weight AS HUGEINT) * 1000000000000 // (SELECT CAST(sum(weight) AS BIGINT) FROM rec) AS BIGINT) AS parts FROM rec")(
    lambda s, d: (lambda o: o.crossJoin(F.broadcast(o.agg(F.sum("weight").alias("w")))).select("key", F.expr("cast(weight as decimal(38,0)) * 1000000000000 div nullif(w, 0)").alias("parts")))(orders(s, d))  # one row
)
query("alias_reconstruct", W_ + f"SELECT CAST(key % {SHARDS} AS INTEGER) AS shard, key, value, weight FROM rec WHERE weight > 0")(lambda s, d: weights.alias_mass(weights.alias_tables(orders(s, d), SHARDS)))

# -- samples --------------------------------------------------------------------------------------
query("sample_wr", W_ + lookup_sql("SELECT * FROM rec"))(lambda s, d: sampling.sample(orders(s, d), DRAWS, SEED, SHARDS))
query("sample_arrow", W_ + lookup_sql("SELECT * FROM rec"))(lambda s, d: sampling.sample_arrow(orders(s, d), DRAWS, SEED, SHARDS))
query("sample_range", W_ + lookup_sql("SELECT * FROM rec WHERE key BETWEEN 1000 AND 5000"))(lambda s, d: sampling.sample(orders(s, d).where("key between 1000 and 5000"), DRAWS, SEED, SHARDS))
query("sample_empty", W_ + lookup_sql("SELECT * FROM rec WHERE false"))(lambda s, d: sampling.sample(orders(s, d).where("false"), DRAWS, SEED, SHARDS))
query("sample_after_delete", W_ + lookup_sql("SELECT * FROM docs ANTI JOIN tox USING (key)"))(lambda s, d: sampling.sample(resolve.drop_tagged(documents(s, d), toxic(s, d), ["key"]), DRAWS, SEED, SHARDS))
query(
    "source_counts",
    W_ + f", sh AS (SELECT key % {SHARDS} AS shard, CAST(sum(sum(weight)) OVER (ORDER BY key % {SHARDS}) AS BIGINT) AS hi, CAST(sum(weight) AS BIGINT) AS w FROM rec GROUP BY 1), dr AS (SELECT {bits_sql(repr(str(SEED)), 'draw')} % (SELECT CAST(sum(w) AS BIGINT) FROM sh) AS r FROM (SELECT unnest(range({DRAWS})) AS draw)) SELECT CAST(shard AS INTEGER) AS shard, count(*) AS n FROM dr JOIN sh ON r >= hi - w AND r < hi GROUP BY 1",
)(lambda s, d: sampling.source_counts(orders(s, d), DRAWS, SEED, SHARDS))
query(
    "sample_two_stage",
    W_ + f""", sh AS (SELECT key % {SHARDS} AS shard, CAST(sum(sum(weight)) OVER (ORDER BY key % {SHARDS}) AS BIGINT) AS hi, CAST(sum(weight) AS BIGINT) AS w FROM rec GROUP BY 1),
dr AS (SELECT draw, {bits_sql(repr(str(SEED)), 'draw')} % (SELECT CAST(sum(w) AS BIGINT) FROM sh) AS r FROM (SELECT unnest(range({DRAWS})) AS draw)),
st AS (SELECT draw, shard, {bits_sql(repr(str(SEED)), "'inner'", 'draw')} % w AS x FROM dr JOIN sh ON r >= hi - w AND r < hi),
cdf AS (SELECT *, key % {SHARDS} AS shard, CAST(sum(weight) OVER (PARTITION BY key % {SHARDS} ORDER BY key, value) AS BIGINT) AS hi FROM rec WHERE weight > 0)
SELECT draw, key, value, weight FROM st JOIN cdf ON st.shard = cdf.shard AND x >= hi - weight AND x < hi""",
)(lambda s, d: sampling.two_stage(orders(s, d), DRAWS, SEED, SHARDS))
#: How many of a table's rows are flushed, so that the rest are in the buffer.
FLUSHED = f"((SELECT count(*) FROM {{}}) - 1) // {Config().buffer_cap} * {Config().buffer_cap}"


def buffered(df: DataFrame, order: str) -> DataFrame:
    """The rows that are still in the write buffer after ``df`` has been appended by ``order``."""
    cap = Config().buffer_cap
    return shards.positions(df, order).where(F.col("pos") >= flushes(df.count(), cap) * cap).drop("pos")


query(
    "sample_buffer_reject",
    W_ + f""", b AS (SELECT key, value, weight, row_number() OVER (ORDER BY key, value) - 1 AS slot FROM (SELECT *, row_number() OVER (ORDER BY key) - 1 AS pos FROM rec) WHERE pos >= {FLUSHED.format("rec")}),
t AS (SELECT count(*) AS n, max(weight) AS m, CAST(sum(weight) AS BIGINT) AS w FROM b), c AS (SELECT *, CAST(sum(weight) OVER (ORDER BY key, value) AS BIGINT) AS hi FROM b WHERE weight > 0),
a AS (SELECT draw, tr, {bits_sql(repr(str(SEED)), 'draw', 'tr', "'slot'")} % n AS slot, {bits_sql(repr(str(SEED)), 'draw', 'tr', "'coin'")} % m AS coin FROM t, (SELECT unnest(range(500)) AS draw), (SELECT unnest(range(2)) AS tr)),
k AS (SELECT draw, key, value, weight, row_number() OVER (PARTITION BY draw ORDER BY tr) AS i FROM a JOIN b USING (slot) WHERE coin < weight),
r AS (SELECT draw, {bits_sql(repr(str(SEED)), 'draw', "'rest'")} % w AS x FROM t, (SELECT unnest(range(500)) AS draw) WHERE draw NOT IN (SELECT draw FROM k))
SELECT draw, key, value, weight FROM k WHERE i = 1 UNION ALL SELECT draw, key, value, weight FROM r JOIN c ON x >= hi - weight AND x < hi""",
)(lambda s, d: sampling.sample_rejecting(buffered(orders(s, d), "key"), 500, SEED, attempts=2))
query("sample_buffer_scan", W_ + lookup_sql(f"SELECT seq, key, value, weight FROM live WHERE seq >= {FLUSHED.format('ops')}", order=f"key % {SHARDS}, key, value, seq"))(
    lambda s, d: sampling.sample(resolve.live(ops(s, d)).where(F.col("seq") >= flushes(ops(s, d).count(), Config().buffer_cap) * Config().buffer_cap), DRAWS, SEED, SHARDS, ("seq",))
)
query(
    "sample_retry",
    W_ + lookup_sql("SELECT * FROM rec", k=DRAWS * 8, hash_=bits_sql(repr(str(SEED)), "draw // 8", "draw % 8"), columns="*").replace("SELECT * FROM dr", ", one AS (SELECT draw // 8 AS draw, CAST(arg_min(draw % 8, draw) AS INTEGER) AS pass, arg_min(key, draw) AS key, arg_min(value, draw) AS value, arg_min(weight, draw) AS weight FROM dr") + f""" WHERE key % 3 <> 0 GROUP BY 1),
lc AS (SELECT *, CAST(sum(weight) OVER (ORDER BY key % {SHARDS}, key, value) AS BIGINT) AS lhi FROM rec WHERE weight > 0 AND key % 3 <> 0),
rest AS (SELECT draw, {bits_sql(repr(str(SEED)), 'draw', "'rest'")} % (SELECT CAST(sum(weight) AS BIGINT) FROM lc) AS x FROM (SELECT unnest(range({DRAWS})) AS draw) WHERE draw NOT IN (SELECT draw FROM one))
SELECT draw, pass, key, value, weight FROM one UNION ALL SELECT draw, CAST(8 AS INTEGER), key, value, weight FROM rest JOIN lc ON x >= lhi - weight AND x < lhi""",
)(lambda s, d: sampling.sample_retrying(orders(s, d), F.col("key") % 3 == 0, DRAWS, 8, SEED, SHARDS))
query(
    "sample_alias",
    W_ + f""", sl AS (SELECT CAST(key % {SHARDS} AS INTEGER) AS shard, key, value, weight, row_number() OVER w - 1 AS slot, CAST(count(*) OVER (PARTITION BY key % {SHARDS}) AS BIGINT) AS n, CAST(sum(weight) OVER (PARTITION BY key % {SHARDS}) AS BIGINT) AS t FROM rec WHERE weight > 0 WINDOW w AS (PARTITION BY key % {SHARDS} ORDER BY key, value)),
sm AS (SELECT *, CAST(sum(t - weight * n) OVER (PARTITION BY shard ORDER BY slot) AS BIGINT) AS lack FROM sl WHERE weight * n < t),
lg AS (SELECT *, CAST(sum(weight * n - t) OVER (PARTITION BY shard ORDER BY slot) AS BIGINT) AS spare, lead(slot) OVER (PARTITION BY shard ORDER BY slot) AS nxt FROM sl WHERE weight * n >= t),
ends AS (SELECT shard, max(slot) AS last FROM lg GROUP BY 1),
al AS (SELECT s.shard, s.slot, s.key, s.value, s.weight, (s.weight * s.n)::DOUBLE / s.t AS prob, coalesce(min(l.slot), any_value(e.last)) AS alias FROM sm s JOIN ends e USING (shard) LEFT JOIN lg l ON l.shard = s.shard AND l.spare > s.lack - (s.t - s.weight * s.n) GROUP BY 1, 2, 3, 4, 5, 6
       UNION ALL SELECT l.shard, l.slot, l.key, l.value, l.weight, CASE WHEN l.nxt IS NULL THEN 1.0::DOUBLE ELSE greatest(0, least(1, 1 - (coalesce(max(s.lack), 0) - l.spare)::DOUBLE / l.t)) END, coalesce(l.nxt, l.slot) FROM lg l LEFT JOIN sm s ON s.shard = l.shard AND s.lack - (s.t - s.weight * s.n) < l.spare GROUP BY 1, 2, 3, 4, 5, l.nxt, l.spare, l.t),
sh AS (SELECT shard, count(*) AS n, CAST(sum(weight) AS BIGINT) AS w, CAST(sum(sum(weight)) OVER (ORDER BY shard) AS BIGINT) AS hi FROM sl GROUP BY shard),
dr AS (SELECT draw, {bits_sql(repr(str(SEED)), 'draw')} % (SELECT CAST(sum(w) AS BIGINT) FROM sh) AS r FROM (SELECT unnest(range({DRAWS})) AS draw)),
st AS (SELECT draw, shard, {bits_sql(repr(str(SEED)), "'slot'", 'draw')} % n AS slot, (CAST({bits_sql(repr(str(SEED)), "'coin'", 'draw')} AS DOUBLE) + 1) / 1152921504606846976.0::DOUBLE AS u FROM dr JOIN sh ON r >= hi - w AND r < hi),
tk AS (SELECT draw, shard, CASE WHEN u <= prob THEN slot ELSE alias END AS slot FROM st JOIN al USING (shard, slot))
SELECT draw, key, value, weight FROM tk JOIN sl USING (shard, slot)""",
)(lambda s, d: sampling.sample_alias(orders(s, d), DRAWS, SEED, SHARDS))
query(
    "sample_share_error",
    W_ + lookup_sql("SELECT * FROM rec", columns="*").replace("SELECT * FROM dr", ", got AS (SELECT grade, count(*) AS n FROM dr") + f" GROUP BY 1), want AS (SELECT grade, CAST(sum(weight) AS BIGINT) AS w FROM rec GROUP BY 1) SELECT grade, coalesce(n, 0) AS n, CAST(floor(abs(coalesce(n, 0) * 1000.0::DOUBLE / {DRAWS} - w * 1000.0::DOUBLE / (SELECT w FROM tot))) AS BIGINT) AS off FROM want LEFT JOIN got USING (grade)",
)(lambda s, d: (lambda g: sampling.share_error(sampling.sample(g, DRAWS, SEED, SHARDS).join(g.select("key", "grade"), "key"), g, "grade"))(graded(s, d)))

# -- metrics --------------------------------------------------------------------------------------
query("record_count", W_ + "SELECT count(*) AS records FROM ops")(lambda s, d: metrics.totals(leveled(s, d)).select("records"))
query("tombstone_count", W_ + "SELECT count(*) FILTER (op = 'T') AS tombstones FROM ops")(lambda s, d: metrics.totals(leveled(s, d)).select("tombstones"))
query("deleted_count", "SELECT count(*) AS deleted FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id)")(
    lambda s, d: metrics.totals(resolve.found(documents(s, d), toxic(s, d), ["key"]).select("*", F.lit(False).alias("is_tombstone"), (F.col("found") == 1).alias("is_deleted"))).select("deleted")
)
query("memory_usage", W_ + "SELECT count(*) * 24 AS bytes FROM ops")(lambda s, d: metrics.totals(leveled(s, d)).select("bytes"))
LEVELED = (
    W_.replace("WITH rec", "WITH RECURSIVE f(i, rest, d) AS (SELECT -1, (n - 1) // 100, 0 FROM (SELECT count(*) AS n FROM events) UNION ALL SELECT i + 1, (rest - CASE WHEN rest % 2 = 0 THEN 2 ELSE rest % 2 END) // 2, CASE WHEN rest % 2 = 0 THEN 2 ELSE rest % 2 END FROM f WHERE rest > 0), rec", 1)
    + ", lv AS (SELECT i AS level, d, CAST(d * power(2, i) * 100 AS BIGINT) AS n, CAST(power(2, i) * 100 AS BIGINT) AS part FROM f WHERE i >= 0), le AS (SELECT *, CAST(sum(n) OVER (ORDER BY level DESC) AS BIGINT) AS e FROM lv), placed AS (SELECT ops.*, coalesce(level, -1) AS level, coalesce((seq - (e - n)) // part, -1) AS shard FROM ops LEFT JOIN le ON seq >= e - n AND seq < e)\n"
)
query("tombstone_prop", LEVELED + "SELECT CAST(level AS INTEGER) AS level, count(*) AS records, count(*) FILTER (op = 'T') AS tombstones, count(DISTINCT shard) AS shards, CAST(100 * power(2, level + 1) AS BIGINT) AS capacity, CAST(floor(count(*) FILTER (op = 'T') * 1000000 / CAST(100 * power(2, level + 1) AS BIGINT)) AS BIGINT) AS ppm, count(*) FILTER (op = 'T') <= 0.15 * CAST(100 * power(2, level + 1) AS BIGINT) AS valid FROM placed WHERE level >= 0 GROUP BY level")(
    lambda s, d: metrics.by_level(leveled(s, d).where("level >= 0"), CAP, SCALE, 0.15)
)
query("tombstone_valid", LEVELED + "SELECT bool_and(v) AS valid FROM (SELECT count(*) FILTER (op = 'T') <= 0.15 * CAST(100 * power(2, level + 1) AS BIGINT) AS v FROM placed WHERE level >= 0 GROUP BY level)")(
    lambda s, d: metrics.by_level(leveled(s, d).where("level >= 0"), CAP, SCALE, 0.15).agg(F.bool_and("valid").alias("valid"))
)
query("shards_by_level", LEVELED + "SELECT CAST(level AS INTEGER) AS level, CAST(shard AS INTEGER) AS shard, count(*) AS n, CAST(sum(weight) AS BIGINT) AS weight FROM placed GROUP BY level, shard")(
    lambda s, d: leveled(s, d).groupBy("level", "shard").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
)
query(
    "rejection_rate",
    LEVELED + "SELECT CAST(level AS INTEGER) AS level, count(*) AS checks, count(*) FILTER (rejected) AS rejections, CASE WHEN count(*) FILTER (rejected) > 16 THEN CAST(floor(count(*) FILTER (rejected) * 1000000 / count(*)) AS BIGINT) ELSE 0 END AS rate_ppm FROM (SELECT level, NOT alive AS rejected FROM placed JOIN br USING (seq) WHERE br.op = 'I') GROUP BY level",
)(lambda s, d: metrics.rejections(resolve.deleted_later(leveled(s, d)).select("level", F.col("deleted").alias("rejected")), 16))

# -- approximate structures -----------------------------------------------------------------------
query("bloom_no_false_negative", W_ + "SELECT count(DISTINCT key) AS keys, CAST(0 AS BIGINT) AS missed FROM ops WHERE op = 'T'")(
    lambda s, d: (lambda t: bloom.may_hold(t, bloom.build(t, t.count())).agg(F.count("*").alias("keys"), F.count_if(~F.col("may")).alias("missed")))(ops(s, d).where("op = 'T'").select("key").distinct())
)
query("bloom_size", W_ + "SELECT CAST(greatest(8, 8 * ceil(-count(*) * ln(0.01) / power(ln(2), 2) / 8)) AS BIGINT) AS bits FROM ops WHERE op = 'T'")(lambda s, d: s.createDataFrame([(bloom.size_bits(ops(s, d).where("op = 'T'").count()),)], "bits long"))
query("bloom_gated_lookup", W_ + "SELECT seq, EXISTS (SELECT 1 FROM ops t WHERE t.op = 'T' AND t.key = o.key AND t.value = o.value) AS deleted FROM ops o WHERE op = 'I'")(
    lambda s, d: (lambda o: bloom.gated_deleted(o.where("op = 'I'"), o.where("op = 'T'"), 10_000).select("seq", "deleted"))(ops(s, d))
)

# -- beyond ---------------------------------------------------------------------------------------
query("sample_wor", W_ + f"SELECT key, value, weight FROM rec WHERE weight > 0 ORDER BY -ln((CAST({bits_sql(repr(str(SEED)), 'key', 'value')} AS DOUBLE) + 1) / 1152921504606846976.0::DOUBLE) / weight, key, value LIMIT 1000")(
    lambda s, d: sampling.sample_without(orders(s, d), 1000, SEED)
)
query(
    "sample_stratified",
    W_ + f""", cdf AS (SELECT *, CAST(sum(weight) OVER (PARTITION BY grade ORDER BY key % {SHARDS}, key, value) AS BIGINT) AS hi FROM rec WHERE weight > 0), tot AS (SELECT grade, CAST(sum(weight) AS BIGINT) AS w FROM cdf GROUP BY 1),
dr AS (SELECT grade, draw, {bits_sql(repr(str(SEED)), 'grade', 'draw')} % w AS r FROM tot, (SELECT unnest(range(200)) AS draw)) SELECT dr.grade, draw, key, value, weight FROM dr JOIN cdf ON dr.grade = cdf.grade AND r >= hi - weight AND r < hi""",
)(lambda s, d: sampling.sample_by_group(graded(s, d), "grade", 200, SEED, SHARDS))
query("doc_mix", W_ + lookup_sql("SELECT * FROM docs"))(lambda s, d: sampling.sample(documents(s, d), DRAWS, SEED, SHARDS))


@query("index_live", W_ + "SELECT seq, key, value, weight FROM live")
def index_live(spark: SparkSession, d: str) -> DataFrame:
    """The op log through a stored index in three appends with flushes and merges; what lives is the same."""
    log = ops(spark, d)
    n = log.count()
    index = Index(spark, work_path(spark, "index"), Config(buffer_cap=max(100, n // 7), scale_factor=2))
    for i in range(3):
        index.append(log.where((F.col("seq") >= n * i // 3) & (F.col("seq") < n * (i + 1) // 3)), i)
    return index.live().select("seq", "key", "value", "weight")


@query("stream_ingest", W_ + "SELECT key, value, count(*) AS n, CAST(sum(weight) AS BIGINT) AS weight FROM live GROUP BY key, value")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The op log as a stream of files into a stored index, each micro-batch once."""
    source = work_path(spark, "stream")
    log = ops(spark, d)
    n = log.count()
    for i in range(2):
        log.where((F.col("seq") >= n * i // 2) & (F.col("seq") < n * (i + 1) // 2)).coalesce(1).write.mode("append").parquet(source)
    index = Index(spark, work_path(spark, "index"), Config(buffer_cap=max(100, n // 3), scale_factor=2))
    ingest(tsv.table_stream(spark, source, OP), index, work_path(spark, "offsets")).awaitTermination()
    return index.live().groupBy("key", "value").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))




def in_index(spark: SparkSession, d: str, config: Config, appends: int = 3) -> Index:
    """The op log in a stored index."""
    log = ops(spark, d)
    n = log.count()
    index = Index(spark, work_path(spark, "index"), config)
    for i in range(appends):
        index.append(log.where((F.col("seq") >= n * i // appends) & (F.col("seq") < n * (i + 1) // appends)), i)
    return index


def seventh(spark: SparkSession, d: str) -> int:
    return max(100, ops(spark, d).count() // 7)


@query("index_leveling", W_ + "SELECT seq, key, value, weight FROM live")
def index_leveling(spark: SparkSession, d: str) -> DataFrame:
    """As ``index_live``, with one shard for each level."""
    return in_index(spark, d, Config(seventh(spark, d), 2, layout="leveling")).live().select("seq", "key", "value", "weight")


@query("index_compaction", W_ + "SELECT seq, key, value, weight FROM live")
def index_compaction(spark: SparkSession, d: str) -> DataFrame:
    """With few deletes and few rejections allowed: levels are merged down for both, and what lives is the same."""
    index = in_index(spark, d, Config(seventh(spark, d), 2, max_tombstone_prop=0.05, max_rejection_rate=0.001, rejection_floor=0))
    index.sample(DRAWS, SEED).count()
    assert index.metrics()["tombstones_valid"]
    return index.live().select("seq", "key", "value", "weight")


@query("index_delete", W_ + "SELECT seq, key, value, CAST(NOT alive AS INTEGER) AS found FROM br WHERE op = 'T'")
def index_delete(spark: SparkSession, d: str) -> DataFrame:
    """The log's inserts in an index and its deletes as requests: each is told whether it found a record of its own."""
    log = ops(spark, d)
    index = Index(spark, work_path(spark, "index"), Config(seventh(spark, d), 2, deletes="tag"))
    index.bulk_load(log.where("op = 'I'"))
    return index.delete(log.where("op = 'T'").select("seq", "key", "value"), 1)


@query("index_bulk_load", DIGITS + "SELECT CAST(level AS INTEGER) AS level, CAST(d AS INTEGER) AS shards, n FROM lv")
def index_bulk_load(spark: SparkSession, d: str) -> DataFrame:
    """All orders loaded at once: levels, shards and rows, counted from what is stored."""
    index = loaded(spark, d)
    kept = None
    for level, shard in [(i, x) for i, lv in enumerate(index.state.levels) for x in lv]:
        part = spark.read.parquet(shard.path).select(F.lit(level).alias("level"), F.lit(shard.path).alias("shard"))
        kept = part if kept is None else kept.unionByName(part)
    if kept is None:
        return spark.createDataFrame([], "level int, shards int, n long")
    return kept.groupBy("level").agg(F.count_distinct("shard").cast("int").alias("shards"), F.count("*").alias("n"))


@query("index_erase", W_ + ", r AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY seq) AS i, seq FROM ops WHERE op = 'T'), l AS (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY value, seq) AS i FROM ops WHERE op = 'I') SELECT r.seq + 1000000000 AS seq, r.key, l.value, CAST(l.value IS NOT NULL AS INTEGER) AS found FROM r LEFT JOIN l ON r.key = l.key AND r.i = l.i")
def index_erase(spark: SparkSession, d: str) -> DataFrame:
    """A delete by key alone for each of the log's deletes, after all inserts: the key's records go one by one."""
    log = ops(spark, d)
    index = Index(spark, work_path(spark, "index"), Config(seventh(spark, d), 2))
    index.bulk_load(log.where("op = 'I'"))
    return index.erase(log.where("op = 'T'").select((F.col("seq") + 1_000_000_000).alias("seq"), "key"))


query("index_snapshot_sample", W_ + lookup_sql("SELECT * FROM live", order=f"key % {SHARDS}, key, value, seq"))(
    lambda s, d: sampling.sample(in_index(s, d, Config(seventh(s, d), 2)).compact_all(), DRAWS, SEED, SHARDS, ("seq",))
)
query("sample_static", W_ + lookup_sql("SELECT * FROM rec"))(
    lambda s, d: (lambda index: (index.bulk_load(seq_of(orders(s, d)).withColumn("op", F.lit("I"))), sampling.sample(index.compact_all(), DRAWS, SEED, SHARDS))[1])(Index(s, work_path(s, "index"), Config()))
)


#: The op log as a load stores it with a buffer of a seventh of it: ``st`` are the inserts that are left in their shard, ``sd`` the deletes.
STORED = (
    W_.replace(
        "WITH rec",
        f"""WITH RECURSIVE p AS (SELECT count(*) AS n, greatest(100, count(*) // 7) AS cap FROM events),
f(i, rest, d) AS (SELECT -1, CASE WHEN n = 0 THEN 0 ELSE (n - 1) // cap END, 0 FROM p
  UNION ALL SELECT i + 1, (rest - CASE WHEN rest % {SCALE} = 0 THEN {SCALE} ELSE rest % {SCALE} END) // {SCALE}, CASE WHEN rest % {SCALE} = 0 THEN {SCALE} ELSE rest % {SCALE} END FROM f WHERE rest > 0), rec""",
        1,
    )
    + f""", lv AS (SELECT i AS level, CAST(d * power({SCALE}, i) * cap AS BIGINT) AS n, CAST(power({SCALE}, i) * cap AS BIGINT) AS part FROM f, p WHERE i >= 0),
le AS (SELECT *, CAST(sum(n) OVER (ORDER BY level DESC) AS BIGINT) AS e FROM lv),
mixed AS (SELECT seq, key, value, weight, CASE WHEN op = 'T' AND seq % 2 = 0 THEN 'D' ELSE op END AS op FROM ops),
placed AS (SELECT o.*, coalesce(level, -1) AS level, coalesce((seq - (e - n)) // part, -1) AS shard FROM mixed o LEFT JOIN le ON seq >= e - n AND seq < e),
r2 AS (SELECT *, sum(CASE op WHEN 'I' THEN 1 ELSE -1 END) OVER (PARTITION BY level, shard, key, value ORDER BY seq) AS run FROM placed),
m2 AS (SELECT * EXCLUDE run, CASE WHEN op = 'I' THEN min(run) OVER (PARTITION BY level, shard, key, value ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) >= run
       ELSE run < 0 AND run < coalesce(min(run) OVER (PARTITION BY level, shard, key, value ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS kept FROM r2),
st AS (SELECT * FROM m2 WHERE op = 'I' AND (kept OR level = -1)),
sd AS (SELECT * FROM m2 WHERE op <> 'I' AND (level = -1 OR kept AND NOT (level = (SELECT max(level) FROM lv) AND shard = 0)))
"""
)
PASSES = 4


def stored_draws(where: str = "true") -> str:
    """Draws over the line of what is stored (deepest level first), dead ones told: ``tries``; the first that lives of each draw: ``one``."""
    return f""", cdf AS (SELECT *, CAST(sum(weight) OVER (ORDER BY level DESC, shard, key, value, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi FROM st WHERE weight > 0 AND {where}),
tot AS (SELECT CAST(sum(weight) AS BIGINT) AS w FROM cdf),
dr AS (SELECT draw, pass, {bits_sql(repr(str(SEED)), 'draw', 'pass')} % w AS r FROM (SELECT unnest(range({DRAWS})) AS draw), (SELECT unnest(range({PASSES})) AS pass), tot WHERE w > 0),
tries AS (SELECT draw, pass, c.key, c.value, c.weight, br.alive FROM dr JOIN cdf c ON r >= hi - c.weight AND r < hi JOIN br USING (seq)),
one AS (SELECT draw, arg_min(key, pass) AS key, arg_min(value, pass) AS value, arg_min(weight, pass) AS weight FROM tries WHERE alive GROUP BY draw),
lc AS (SELECT *, CAST(sum(weight) OVER (ORDER BY key % {SHARDS}, key, value, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS lhi FROM live WHERE weight > 0 AND {where}),
late AS (SELECT draw, {bits_sql(repr(str(SEED)), 'draw')} % (SELECT CAST(sum(weight) AS BIGINT) FROM lc) AS x FROM (SELECT unnest(range({DRAWS})) AS draw) WHERE draw NOT IN (SELECT draw FROM one))
"""


DRAWN = "SELECT draw, key, value, weight FROM one UNION ALL SELECT draw, key, value, weight FROM late JOIN lc ON x >= lhi - weight AND x < lhi"


def stored_index(spark: SparkSession, d: str, **more) -> Index:
    """The op log, half of its deletes as tags, loaded at once; flushed but for a buffer."""
    index = Index(spark, work_path(spark, "index"), Config(seventh(spark, d), SCALE, **more))
    tag = (F.col("op") == "T") & (F.col("seq") % 2 == 0)
    index.bulk_load(ops(spark, d).withColumn("op", F.when(tag, "D").otherwise(F.col("op"))))
    return index


query("index_sample", STORED + stored_draws() + DRAWN)(lambda s, d: stored_index(s, d).sample(DRAWS, SEED, passes=PASSES))
query("index_filters", STORED + stored_draws() + DRAWN)(lambda s, d: stored_index(s, d, filters=True).sample(DRAWS, SEED, passes=PASSES))
query("index_range_sample", STORED + stored_draws("key BETWEEN 3 AND 9") + DRAWN)(lambda s, d: stored_index(s, d).sample(DRAWS, SEED, low=3, high=9, passes=PASSES))


@query("index_rejects", STORED + stored_draws() + """SELECT cause, coalesce(n, 0) AS n FROM (SELECT unnest(['tombstone', 'tag', 'range']) AS cause) LEFT JOIN (
  SELECT CASE kind WHEN 'T' THEN 'tombstone' ELSE 'tag' END AS cause, count(*) AS n FROM tries JOIN (SELECT key, value, max(op) AS kind FROM sd GROUP BY key, value) USING (key, value) WHERE NOT alive GROUP BY 1) USING (cause)""")
def index_rejects(spark: SparkSession, d: str) -> DataFrame:
    """How many draws a sample has rejected, by cause; a range's draws never fall outside it."""
    index = stored_index(spark, d)
    index.sample(DRAWS, SEED, passes=PASSES)
    return spark.createDataFrame(list(index.metrics()["rejects"].items()), "cause string, n long")


@query("index_levels", STORED + f""", h AS (SELECT level, shard, op, weight FROM st UNION ALL SELECT level, shard, op, weight FROM sd)
SELECT CAST(level AS INTEGER) AS level, count(DISTINCT shard) AS shards, count(*) AS records, count(*) FILTER (op <> 'I') AS tombstones, CAST(floor(count(*) FILTER (op <> 'I') * 1000000 / (count(*) FILTER (op <> 'I') + count(*))) AS BIGINT) AS proportion_ppm FROM h WHERE level >= 0 GROUP BY level""")
def index_levels(spark: SparkSession, d: str) -> DataFrame:
    """Each level's shards, records, deletes and proportion of deletes, from the manifest."""
    index = stored_index(spark, d)
    told = index.metrics()
    rows = [(i, len(lv), sum(x.rows for x in lv), sum(x.tombstones for x in lv), int(p * 1_000_000 + 1e-6)) for i, (lv, p) in enumerate(zip(index.state.levels, told["proportions"]))]
    return spark.createDataFrame(rows, "level int, shards long, records long, tombstones long, proportion_ppm long")


@query(
    "index_metrics",
    STORED
    + """, h AS (SELECT level, shard, op, weight FROM st UNION ALL SELECT level, shard, op, weight FROM sd), t AS (SELECT level, shard, count(*) AS t FROM sd GROUP BY level, shard)
SELECT count(*) AS records, count(*) FILTER (op <> 'I') AS tombstones, CAST(sum(weight) AS BIGINT) AS weight, count(*) FILTER (level = -1) AS buffered, CAST(floor((SELECT cap FROM p) * 0.05::DOUBLE) AS BIGINT) AS tombstone_cap,
  greatest(0, count(*) FILTER (level = -1 AND op <> 'I') - CAST(floor((SELECT cap FROM p) * 0.05::DOUBLE) AS BIGINT)) AS deletes_over_cap, (SELECT CAST(sum(greatest(1, ceil(-t * ln(0.01) / power(ln(2), 2) / 8))) AS BIGINT) FROM t) AS aux_bytes,
  count(*) FILTER (level >= 0) AS in_files, true AS bytes_stored, true AS filters_stored FROM h""",
)
def index_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Counts, weight, the buffer and its cap, the size of the filters, and that bytes of both are on disk, of a flushed index."""
    index = stored_index(spark, d, filters=True, max_tombstone_prop=0.05)
    m = index.metrics()
    in_files = sum(f.rows for lv in index.state.levels for x in lv for f in x.files)
    row = (m["records"], m["tombstones"], m["weight"], m["buffered"], index.config.tombstone_cap, m["deletes_over_cap"], m["aux_bytes"], in_files, m["bytes"] > 0, m["stored_aux_bytes"] >= m["aux_bytes"])
    return spark.createDataFrame([row], "records long, tombstones long, weight long, buffered long, tombstone_cap long, deletes_over_cap long, aux_bytes long, in_files long, bytes_stored boolean, filters_stored boolean")


@query("index_destroy", "SELECT count(*) AS before, CAST(0 AS BIGINT) AS after FROM orders")
def index_destroy(spark: SparkSession, d: str) -> DataFrame:
    """Records that an index reads from disk before and after it is destroyed."""
    index = loaded(spark, d)
    before = index.live().count()
    index.destroy()
    return spark.createDataFrame([(before, Index(spark, index.path).live().count())], "before long, after long")


#: Malformed lines stand between the records: every 50th order's weight is no number.
@query("tsv_stream", W_ + "SELECT key % 8 AS part, count(*) FILTER (key % 50 <> 0) AS n, CAST(coalesce(sum(weight) FILTER (key % 50 <> 0), 0) AS BIGINT) AS weight, count(*) FILTER (key % 50 = 0) AS malformed FROM rec GROUP BY 1")
def tsv_stream(spark: SparkSession, d: str) -> DataFrame:
    """Files of tab-separated lines as a stream into an index; what doesn't parse is kept aside and counted."""
    source, aside = work_path(spark, "lines"), work_path(spark, "aside")
    weight = F.when(F.col("key") % 50 == 0, F.lit("none")).otherwise(F.col("weight").cast("string"))
    orders(spark, d).select(F.concat_ws("\t", "value", "key", weight)).repartition(2).write.text(source)
    index = Index(spark, work_path(spark, "index"), Config(buffer_cap=max(100, table(spark, d, "orders").count() // 3), scale_factor=2))
    ingest_lines(tsv.record_stream(spark, source), index, work_path(spark, "offsets"), aside).awaitTermination()
    good = index.live().groupBy((F.col("key") % 8).alias("part")).agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    bad = spark.read.parquet(aside).groupBy((F.split("line", "\t")[1].cast("long") % 8).alias("part")).agg(F.count("*").alias("malformed"))
    return good.join(bad, "part", "full").select("part", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "weight", "malformed")])


VICTIMS = 300


@query(
    "interleaved_workload",
    W_
    + f""", o AS (SELECT key, value, weight, least(2, key * 3 // ((SELECT max(key) FROM rec) + 1)) AS b FROM rec),
c1 AS (SELECT *, CAST(sum(weight) OVER (ORDER BY key, value) AS BIGINT) AS hi FROM o WHERE b = 0 AND weight > 0),
d1 AS (SELECT draw, min(pass) AS pass FROM (SELECT unnest(range({VICTIMS})) AS draw), (SELECT unnest(range(4)) AS pass) GROUP BY draw),
v1 AS (SELECT DISTINCT key, value FROM d1 JOIN c1 ON {bits_sql("'2'", 'draw', 'pass')} % (SELECT CAST(sum(weight) AS BIGINT) FROM c1) >= hi - weight AND {bits_sql("'2'", 'draw', 'pass')} % (SELECT CAST(sum(weight) AS BIGINT) FROM c1) < hi),
c2 AS (SELECT *, CAST(sum(weight) OVER (ORDER BY key, value) AS BIGINT) AS hi, EXISTS (SELECT 1 FROM v1 WHERE v1.key = o.key AND v1.value = o.value) AS dead FROM o WHERE b <= 1 AND weight > 0),
d2 AS (SELECT draw, pass, {bits_sql("'3'", 'draw', 'pass')} % (SELECT CAST(sum(weight) AS BIGINT) FROM c2) AS r FROM (SELECT unnest(range({VICTIMS})) AS draw), (SELECT unnest(range(4)) AS pass)),
h2 AS (SELECT draw, pass, key, value FROM d2 JOIN c2 ON r >= hi - weight AND r < hi WHERE NOT dead),
v2 AS (SELECT DISTINCT key, value FROM (SELECT draw, arg_min(key, pass) AS key, arg_min(value, pass) AS value FROM h2 GROUP BY draw))
SELECT CAST(1 AS BIGINT) AS batch, key, value, CAST(1 AS INTEGER) AS found FROM v1 UNION ALL SELECT CAST(2 AS BIGINT), key, value, CAST(1 AS INTEGER) FROM v2""",
)
def interleaved_workload(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a stream of three batches, each with deletes of records drawn from what lives before it: every delete, and
    whether it met a record. (That any draw of the last batch is rejected in all four passes has a chance of some 1e-4.)"""
    source, o = work_path(spark, "stream"), seq_of(orders(spark, d))
    last = o.agg(F.max("seq")).first()[0] or 0
    third = F.least(F.lit(2), F.expr(f"seq * 3 div {last + 1}"))
    for i in range(3):
        o.where(third == i).select("seq", "key", "value", "weight").coalesce(1).write.mode("append").parquet(source)
    index = Index(spark, work_path(spark, "index"), Config(buffer_cap=1 << 40, scale_factor=2))
    schema = "seq long, key long, value long, weight long"
    interleave(tsv.table_stream(spark, source, schema), index, work_path(spark, "offsets"), VICTIMS, batches_per_pool=1).awaitTermination()
    log = resolve.brackets(index.log())
    at = F.least(F.lit(2), F.expr(f"((seq + 1) div 2) * 3 div {last + 1}"))
    return log.where("op = 'T'").select(at.cast("long").alias("batch"), "key", "value", (~F.col("alive")).cast("int").alias("found"))


query(
    "sampled_workload",
    W_ + f""", o AS (SELECT *, key AS seq FROM rec), v AS (SELECT * FROM o WHERE weight > 0 ORDER BY -ln((CAST({bits_sql('1', 'key', 'value')} AS DOUBLE) + 1) / 1152921504606846976.0::DOUBLE) / weight, key, value LIMIT 1000)
SELECT seq * 2 AS seq, key, value, weight, 'I' AS op FROM o UNION ALL SELECT (seq + {bits_sql('1', "'when'", 'key', 'value')} % ((SELECT max(seq) FROM o) - seq + 1)) * 2 + 1, key, value, 0, 'T' FROM v""",
)(lambda s, d: workload.sampled_log(seq_of(orders(s, d)), 1000))
