"""Near-duplicate classes by SuperMinHash signatures, banding, verification on full sets and grouping."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_name
from .key_join import C1, key_classes, mix

#: Elements that are permuted at once.
CHUNK = 2048


def signature(shingles: np.ndarray, m: int) -> np.ndarray:
    """The SuperMinHash signature of a set of 64-bit hashes: ``m`` words, each a level (16 bits) and a fraction (48 bits).

    Every element walks through a random permutation of the components, one step (level) after the other, and leaves
    the level and a random fraction in the component it comes to; the smallest value stays. Levels are taken by all elements
    of a chunk at once. Once no component's value is above a level, later steps can't lower any, and the walk stops.
    """
    h = np.full(m, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), CHUNK):
        part = mix(shingles[at : at + CHUNK])
        places = np.broadcast_to(np.arange(m, dtype=np.uint16), (len(part), m)).copy()
        rows = np.arange(len(part))
        for level in range(m):
            if level > int(h.max() >> np.uint64(48)):
                break
            with np.errstate(over="ignore"):
                x = mix(part + C1 * np.uint64(level + 1))
            to = level + (((x & np.uint64(0xFFFF)) * np.uint64(m - level)) >> np.uint64(16)).astype(np.int64)
            hit = places[rows, to]
            places[rows, to] = places[:, level]
            np.minimum.at(h, hit, (x >> np.uint64(16)) | np.uint64(level << 48))
    return h


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each ``rows`` components in a row."""
    parts = sig.reshape(-1, rows)
    out = np.arange(1, len(parts) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(rows):
            out = mix(out * C1 + parts[:, j])
    return out


def minhash_classes(docs: DataFrame, size: int = 2, percent: int = 80, n_bands: int = 40, rows: int = 6, block: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_shingles, component_id and kept of every row.

    Words are runs of anything but white space, A-Z lower-cased; a text's set is its distinct shingles of ``size`` words,
    or all its words as one if they are fewer. Two rows are linked when 100 * intersection >= ``percent`` *
    union; component_id is the smallest id that links reach, the row's own included, and kept says whether that is its own.

    1. Rows with equal sets (128-bit digests) are one class, so exact copies cost a row each and nothing more.
    2. Each class has a SuperMinHash signature of ``n_bands`` * ``rows`` components and a key for each band. Two classes of
       similarity s share a key but for a chance of (1 - s^rows)^n_bands: 5e-6 at 0.8 with the defaults, 1e-9 at 0.87.
    3. Classes with a key in common form a star around the key's smallest class. Each class is compared on the full sets with the
       smallest of its centres first, then with those centres that it isn't connected to yet.
    4. Where other members of a key are still apart, all of them meet in a task that knows what is connected
       (``trie_links``); keys with the same members count once, and more than ``block`` shingles are dealt into blocks, each pair of which is
       a task of bounded size.
    5. The components of all links are the result.

    Null and empty texts have no shingles, are linked with nothing, and are their own component. Rows with a null id
    take part and get their component's id, null if it has none; they are kept only then. Repeated ids are rows of their own.
    Other columns are ignored; an empty table gives no rows.
    """

    def make_keys():
        return lambda s: bands(signature(s, n_bands * rows), rows)

    return key_classes(docs, make_keys, size, percent, block, id_col, text_col)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, **more) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their class of near duplicates; all columns as they were. Rows without
    words and rows with a null id stay, repeated ids stay or go together."""
    d = new_name(docs, "_gone")
    found = minhash_classes(docs, size, percent, id_col=id_col, text_col=text_col, **more)
    gone = found.where(~F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias(d)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(d), "left_anti")


#: The same by counting the shingles that any two different sets have in common, and following links.
MINHASH_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, unnest(CASE WHEN len(w) < 2 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS x FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT doc_id, md5(string_agg(x, chr(10) ORDER BY x)) AS k FROM s GROUP BY doc_id),
f AS (SELECT k, min(doc_id) AS doc_id FROM k GROUP BY k),
e AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM (s SEMI JOIN f USING (doc_id)) a JOIN (s SEMI JOIN f USING (doc_id)) b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM e JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM f UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a),
m AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN f USING (k) LEFT JOIN m ON m.a = f.doc_id
"""
