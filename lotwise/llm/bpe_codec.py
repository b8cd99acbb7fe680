"""BPE encoding and decoding with content-defined chunks that are encoded once and repaired where they meet."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe_engine import Engine, engine, is_joint
from .common import by_batch, id_text

#: The multiplier of the rolling hash, any odd number.
BASE = np.uint64(0x9E3779B97F4A7C15)
WINDOW = 16


def cuts(text: str, mean: int, most: int) -> list[int]:
    """Where chunks end: places whose last WINDOW characters hash to 0 modulo ``mean``, and no more than ``most`` apart.

    A place depends on the characters near it only, so that a passage is cut alike in every
    document that holds it. The hash of all windows is built by doubling: four vector steps.
    """
    n = len(text)
    if n <= mean:
        return [n]
    h = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    factor, width = BASE, 1
    with np.errstate(over="ignore"):
        while width < WINDOW:
            h[width:] = h[width:] + factor * h[:-width]
            factor, width = factor * factor, 2 * width
        h = (h ^ (h >> np.uint64(31))) * BASE
    found = np.flatnonzero((h >> np.uint64(40)) % np.uint64(mean) == 0) + 1
    out, last = [], 0
    for c in [*found[found >= WINDOW].tolist(), n]:
        while c - last > most:
            last += most
            out.append(last)
        if c > last:
            out.append(c)
            last = c
    return out


class Chunk:
    """A chunk's ids, encoded by itself, and where its first and last proven boundaries are.

    ``first``/``last``: characters before them; ``head``/``tail``: ids before the first and from the
    last boundary on. Without a boundary whose ids agree, ``last`` is None.
    """

    __slots__ = ("first", "head", "ids", "last", "tail")

    def __init__(self, model: Engine, text: str):
        self.ids = np.asarray(model.encode(text), dtype=np.uint32)
        self.first = next((p for p in range(1, len(text)) if is_joint(text, p)), None)
        self.last = self.head = self.tail = None
        if self.first is None:
            return
        last = next(p for p in range(len(text) - 1, 0, -1) if is_joint(text, p))
        head, tail = model.encode(text[: self.first]), model.encode(text[last:])
        if list(self.ids[: len(head)]) == head and list(self.ids[len(self.ids) - len(tail) :]) == tail:
            self.last, self.head, self.tail = last, len(head), len(self.ids) - len(tail)


class Memo:
    """The chunks that this worker process has encoded, the latest used ones up to ``room`` characters."""

    def __init__(self, model: Engine, room: int):
        self.model, self.room, self.held = model, room, 0
        self.chunks: OrderedDict[str, Chunk] = OrderedDict()

    def get(self, text: str) -> Chunk:
        found = self.chunks.get(text)
        if found is None:
            self.chunks[text] = found = Chunk(self.model, text)
            self.held += len(text)
            while self.held > self.room and len(self.chunks) > 1:
                self.held -= len(self.chunks.popitem(last=False)[0])
        else:
            self.chunks.move_to_end(text)
        return found


@lru_cache(maxsize=2)
def memo(vocab_path: str, room: int) -> Memo:
    return Memo(engine(vocab_path), room)


def encode(chunks: Memo, text: str, mean: int = 512, most: int = 8192) -> np.ndarray:
    """The ids of ``text``, exactly as of the whole text.

    Where two chunks meet, what lies between the last proven boundary of the left one and the
    first of the right one is encoded anew. Both chunks' own ids agree with a fresh encoding on
    the far sides of these boundaries (``Chunk`` verifies it), so the splice is exact. A chunk
    without such a boundary is taken into the repaired stretch, which widens until one is found.
    """
    bounds = cuts(text, mean, most)
    if len(bounds) == 1:
        return chunks.get(text).ids if text else np.empty(0, dtype=np.uint32)
    parts, since, begin = [], 0, 0  # text from ``since`` on has not been given ids yet
    open_ = True  # the text's own start is a true boundary: nothing to repair before it
    for end in bounds:
        c = chunks.get(text[begin:end])
        if c.last is not None:
            if begin == 0:
                parts.append(c.ids[: c.tail])
            else:
                parts.append(np.asarray(chunks.model.encode(text[since : begin + c.first]), dtype=np.uint32))
                parts.append(c.ids[c.head : c.tail])
            since, open_ = begin + c.last, False
        begin = end
    if open_:
        return np.asarray(chunks.model.encode(text), dtype=np.uint32)
    parts.append(np.asarray(chunks.model.encode(text[since:]), dtype=np.uint32))
    return np.concatenate(parts)


def encode_documents(docs: DataFrame, vocab_path: str, mean: int = 512, room: int = 16_000_000, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode its ids again.

    Returns doc_id, n_tokens, ids (array<int>), decoded, and digests of both: ids_sha256 over the
    ids as little-endian 32-bit integers and decoded_sha256 over the decoded text's UTF-8, both
    lowercase hex. ``with_ids=False`` leaves out ids and decoded. Chunks of about ``mean``
    characters are cut by a rolling hash and encoded once by each worker process, which keeps the
    ``room`` characters used last; results don't depend on what is kept. A null text counts as
    empty; repeated rows give repeated results; an empty table gives none; other columns are
    ignored. There is no shuffle.
    """

    def make():
        chunks = memo(vocab_path, room)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, all_ids, back, ids_sha, text_sha = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                ids = encode(chunks, text or "", mean)
                decoded = chunks.model.decode(ids.tolist())
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
                    back.append(decoded)
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha), "decoded_sha256": pa.array(text_sha)}
            if with_ids:
                columns |= {"ids": pa.array(all_ids, pa.list_(pa.int32())), "decoded": pa.array(back)}
            return pa.RecordBatch.from_pydict(columns)

        return f

    rows = id_text(docs, id_col, text_col)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return by_batch(rows, make, schema, 1000)  # so many texts' ids and decoded texts are held at once
