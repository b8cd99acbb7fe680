"""Line deduplication by overlapping windows of consecutive lines, in built-in functions throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_name


def dedup_lines(docs: DataFrame, window: int = 3, name: str = "lines", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages removed from ``text_col``, and a struct ``name``: n_lines, n_removed, starts.

    Lines are what stands between line feeds. Every ``window`` consecutive lines are a window; a
    window's first occurrence is the one with the smallest id (null ids last), text hash and line.
    All later occurrences, in the same document or another, are found over the whole table, and
    the lines that they cover go; ``starts`` has the first line (from 0) of each such occurrence.
    The first occurrence of every line text stays somewhere, as the earliest of a chain of equal
    windows has nothing before it.

    Windows are compared by two 64-bit hashes. Occurrences are counted with partial aggregation;
    a window in a third of all documents makes one row for each occurrence in a join whose
    large partitions can be split, never pairs of occurrences. A document's marks and its text meet by
    id and text hash.

    A text of fewer than ``window`` lines is left as it is. A null text stays null with 0 lines.
    Rows with equal id and text are one document and get equal results. An empty table gives none. Other
    columns go through untouched.
    """
    row_hash, words, of, of_row, stretches, left = (new_name(docs, f"_line_dedup_{x}") for x in ("row", "marks", "of", "of_row", "stretches", "left"))
    rows = docs.withColumn(row_hash, F.xxhash64(F.col(text_col)))
    lines = F.split(F.col(text_col), "\n", -1)
    w = window

    def key(a, i):
        forth = [a[i + k] for k in range(w)]
        back = [x for k in reversed(range(w)) for x in (a[i + k], F.lit("\n"))]
        return F.struct(i.cast("int").alias("at"), F.xxhash64(*forth).alias("h"), F.xxhash64(*back).alias("g"))

    parts = rows.select(F.col(id_col).alias("d"), F.col(row_hash).alias("r"), lines.alias("a")).where(F.size("a") >= w)
    each = parts.select("d", "r", F.explode(F.transform(F.sequence(F.lit(0), F.size("a") - w), lambda i: key(F.col("a"), i))).alias("x")).select("d", "r", F.col("x.at").alias("at"), F.col("x.h").alias("h"), F.col("x.g").alias("g"))
    place = F.struct(F.isnull("d").alias("z"), F.col("d"), F.col("r"), F.col("at"))
    first = each.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = each.join(first, ["h", "g"]).where(place != F.col("first"))
    marks = later.groupBy(F.col("d").alias(of), F.col("r").alias(of_row)).agg(F.array_sort(F.collect_set("at")).alias(words))

    n, s = F.size(lines), F.col(words)
    # merged stretches: the places in s where a new one begins
    begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) - F.get(s, i - 1) > w))
    parts_kept = F.transform(
        F.sequence(F.lit(0), F.size(stretches)),
        lambda j: F.struct(
            F.when(j == 0, 0).otherwise(F.get(s, F.when(j < F.size(stretches), F.get(F.col(stretches), j)).otherwise(F.size(s)) - 1) + w).alias("from"),
            F.when(j < F.size(stretches), F.get(s, F.get(F.col(stretches), j))).otherwise(n).alias("to"),
        ),
    )
    kept = F.flatten(F.transform(parts_kept, lambda g: F.slice(lines, g["from"] + 1, F.greatest(g["to"] - g["from"], F.lit(0)))))
    joined = rows.join(marks, F.col(id_col).eqNullSafe(F.col(of)) & F.col(row_hash).eqNullSafe(F.col(of_row)), "left")
    joined = joined.withColumn(stretches, F.when(s.isNotNull(), begins)).withColumn(left, F.when(s.isNotNull(), kept))
    result = F.struct(
        F.coalesce(F.when(F.col(text_col).isNotNull(), n), F.lit(0)).cast("long").alias("n_lines"),
        F.when(s.isNotNull(), n - F.size(left)).otherwise(0).cast("long").alias("n_removed"),
        F.coalesce(s, F.array().cast("array<int>")).alias("starts"),
    )
    return joined.select(*[F.when(s.isNull(), F.col(c)).otherwise(F.array_join(left, "\n")).alias(c) if c == text_col else F.col(c) for c in docs.columns], result.alias(name))


#: The same in DuckDB's SQL.
LINE_DEDUP_SQL = """
WITH rows_ AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN NULL ELSE string_split(text, chr(10)) END AS a FROM documents),
w AS (SELECT doc_id, pos, a[pos + 1] || chr(10) || a[pos + 2] || chr(10) || a[pos + 3] AS k
      FROM (SELECT doc_id, a, unnest(range(0, len(a) - 2)) AS pos FROM rows_ WHERE len(a) >= 3)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS n FROM w),
gone AS (SELECT DISTINCT doc_id, pos + j AS line FROM ranked, (SELECT unnest([0, 1, 2]) AS j) WHERE n > 1),
each_ AS (SELECT doc_id, unnest(range(0, len(a))) AS line, unnest(a) AS x FROM rows_ WHERE a IS NOT NULL),
kept AS (SELECT e.doc_id, string_agg(e.x, chr(10) ORDER BY e.line) AS text, count(*) AS n
         FROM each_ e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.line = g.line GROUP BY e.doc_id)
SELECT r.doc_id, CAST(coalesce(len(r.a), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(r.a), 0) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       CASE WHEN r.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM rows_ r LEFT JOIN kept k ON r.doc_id = k.doc_id
"""
