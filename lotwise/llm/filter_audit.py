"""How quality filters interact: what each removes, repeats or alone catches, in every order of application."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a text: runs of anything but these characters.
SPACE = r"[\x20\x09-\x0D]+"
LETTERS = "ABCDE"


def own_failures(text: Column, min_words: int = 50, distinct_percent: int = 65, capital_percent: int = 5, marks: str = "#$%&*|") -> list[Column]:
    """Whether a text (not null) fails each filter that looks at it alone.

    Too few words; too few distinct words in percent of all; too many A-Z in percent of all code points; any of ``marks``.
    """
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    marked = F.length(F.translate(text, marks, "")) < F.length(text)
    return [n < min_words, 100 * F.size(F.array_distinct(words)) < distinct_percent * n, 100 * capitals > capital_percent * F.length(text), marked]


def failure_cells(docs: DataFrame, labels: DataFrame, part: str = "source", id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """Documents counted by ``part`` and ``mask``: n, good, toxic.

    Bit i of the mask says that filter i fails; the last filter fails for a text that a smaller id has as well,
    anywhere in the table, removed or not. Rows with a null id are never such repeats, and repeated rows of the smallest id neither. Null texts
    are empty texts, a null part is the empty string. A document is good (toxic) if any of its labels has quality
    (toxic) 1; labels with a null id count for nothing. Every document is reduced to a digest and a mask where it
    is read. Copies are counted for each (text, part, labels) first, so a text in a third of all rows is a few rows by the time its
    smallest id is looked for.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    mask = F.lit(0)
    for i, fails in enumerate(own_failures(F.col("_text"), **limits)):
        mask = mask.bitwiseOR(F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)))
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("_text"))
    slim = slim.select("id", "part", F.unhex(F.sha2("_text", 256)).alias("digest"), mask.cast("int").alias("mask"))
    flags = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    known = slim.join(flags, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    key = ["digest", "mask", "part", "good", "toxic"]
    rows = known.groupBy("id", *key).agg(F.count("*").alias("n"))  # by id as the join is
    copies = rows.groupBy(*key).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"))
    same = Window.partitionBy("digest")
    first = F.when(F.col("least.id") == F.min("least.id").over(same), F.col("least.n")).otherwise(0)
    split = copies.select("part", "mask", "good", "toxic", "n", (F.col("no_id") + first).alias("kept"))
    last = 1 << (len(LETTERS) - 1)
    sides = F.array(F.struct("mask", F.col("kept").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(last)).alias("mask"), (F.col("n") - F.col("kept")).alias("n")))
    long = split.select("part", "good", "toxic", F.explode(sides).alias("x")).select("part", "good", "toxic", "x.*").where("n > 0")
    return long.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def audit(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Every (part, filter_order, step) of all orders of the filters, from cells (part, mask, n, good, toxic).

    The cells are unpivoted against the steps of each order. A running bit-or over the steps before tells whether an
    earlier filter has removed a cell already; conditional sums give the metrics, and totals over all orders of a filter its
    Shapley count. At most 2^filters cells of a part take part, whatever its number of documents. No cells give no rows.
    """
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    steps = cells.select("*", F.explode(orders).alias("filter_order")).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter"))
    bit = F.call_function("shiftleft", F.lit(1), F.call_function("instr", F.lit(letters), F.col("letter")) - 1)
    failing = steps.withColumn("bit", bit).withColumn("hit", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "filter_order", "mask").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    told = failing.withColumn("earlier", F.coalesce(F.bit_or("hit").over(before), F.lit(0)) != 0).withColumn("fails", F.col("hit") != 0)
    here = F.col("fails") & ~F.col("earlier")

    def total(what: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")

    out = told.groupBy("part", "filter_order", (F.col("at") + 1).alias("step"), "letter").agg(
        total("n", ~F.col("fails") & ~F.col("earlier")).alias("kept"),
        total("n", here).alias("removed"),
        total("n", F.col("fails") & F.col("earlier")).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter"))
    return out.withColumn("shapley", shapley).select("part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_interactions(docs: DataFrame, labels: DataFrame, part: str = "source", id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``audit`` of the five filters over whole texts, zeros included: 600 rows for each part that has documents.

    A: under 50 words. B: distinct words under 65 % of all. C: A-Z over 5 % of the code points. D: any of ``#$%&*|``.
    E: the text of a smaller id. What nulls, repeats and empty tables give is said at ``failure_cells`` and ``audit``.
    """
    return audit(failure_cells(docs, labels, part, id_col, text_col, **limits))


#: The same from each document's five failures, without cells.
FILTER_AUDIT_SQL = r"""
WITH base AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lab AS (SELECT doc_id, max(CASE quality WHEN 1 THEN 1 ELSE 0 END) AS good, max(CASE toxic WHEN 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
low AS (SELECT t, min(doc_id) AS least FROM base GROUP BY t),
doc AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
          100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS f
        FROM base JOIN low USING (t) LEFT JOIN lab USING (doc_id)),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
ord AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
step AS (SELECT filter_order, step, strpos('ABCDE', substr(filter_order, CAST(step AS INTEGER), 1)) AS i FROM ord, (SELECT unnest(range(1, 6)) AS step)),
told AS (SELECT part, good, bad, f, filter_order, step, i, f[i] AS fails, len(list_filter(range(1, step), lambda k: f[strpos('ABCDE', substr(filter_order, CAST(k AS INTEGER), 1))])) > 0 AS earlier,
           len(list_filter(f, lambda y: y)) = 1 AND f[i] AS alone, n FROM (SELECT part, good, bad, f, count(*) AS n FROM doc GROUP BY ALL), step),
agg AS (SELECT part, filter_order, step, i, sum(CASE WHEN NOT fails AND NOT earlier THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT earlier THEN n ELSE 0 END) AS removed,
          sum(CASE WHEN fails AND earlier THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN fails AND NOT earlier THEN n * good ELSE 0 END) AS good_lost,
          sum(CASE WHEN fails AND NOT earlier THEN n * bad ELSE 0 END) AS toxic_lost FROM told GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, i) AS BIGINT) AS shapley FROM agg
"""
