"""Token counts of whole texts, huge ones by overlapping chunks that are joined at proven boundaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_engine import Engine, engine
from .common import by_batch, id_text


def offsets(model: Engine, ids: list[int]) -> np.ndarray:
    """Byte offset in the chunk at which each token starts, and the end."""
    return np.concatenate(([0], np.cumsum(model.lengths[np.asarray(ids, dtype=np.int64)])))


def index_at(starts: np.ndarray, byte: int) -> int | None:
    """The number of tokens before byte offset ``byte``, or None where a token covers it."""
    i = int(np.searchsorted(starts, byte))
    return i if i < len(starts) and starts[i] == byte else None


def chunked_count(model: Engine, text: str, chunk: int, overlap: int) -> int:
    """Tokens of ``text``, encoding ``chunk`` characters at a time.

    Each chunk begins ``overlap`` characters before the last one's end. The two are spliced at a
    place in the overlap where both have a token boundary and which the model proves to be a
    boundary in the whole text: from there on both scans read the same pieces. Where there is
    none, the overlap is doubled; once it reaches the last splice, the two chunks become one of twice the
    length, so that a text without any such place is encoded in steps that double.
    """
    n, total = len(text), 0
    start = 0  # what stands before this splice is counted
    end = min(n, chunk)
    ids = model.encode(text[:end])
    while end < n:
        back, tried = overlap, end
        while True:
            begin = max(start, end - back)
            at = next((p for p in range(tried - 1, begin, -1) if model.is_joint(text, p)), None)
            if at is not None:
                stop = min(n, end + chunk)
                new = model.encode(text[begin:stop])
                left = index_at(offsets(model, ids), len(text[start:at].encode()))
                right = index_at(offsets(model, new), len(text[begin:at].encode()))
                if left is not None and right is not None:
                    total += left
                    start, end, ids = at, stop, new[right:]
                    break
            elif begin == start:  # nothing left to overlap: one chunk
                end = min(n, max(end + chunk, 2 * end - start))
                ids = model.encode(text[start:end])
                break
            else:
                tried = begin + 1  # what lies behind has none
            back *= 2
    return total + len(ids)


def count_tokens(docs: DataFrame, vocab_path: str, limit: int = 1024, chunk: int = 16384, overlap: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit.

    ``vocab_path`` names a tokenizers file that each worker can read. Texts longer than ``chunk``
    characters are encoded in overlapping chunks (see ``chunked_count``), so that memory and the
    cost of a retry stay bounded; the count is that of the whole text. A null text counts as
    empty: 0 bytes, 0 tokens. Repeated rows give repeated results; an empty table gives none;
    columns other than the two named are ignored. There is no shuffle.
    """

    def make():
        model = engine(vocab_path)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column("text")
            sizes, counts = [], []
            for text in texts.to_pylist():
                text = text or ""
                sizes.append(len(text.encode()))
                counts.append(chunked_count(model, text, chunk, overlap) if len(text) > chunk else len(model.encode(text)))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

        return f

    rows = id_text(docs, id_col, text_col)
    return by_batch(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
