"""Exact substring dedup over words by fixed-block anchors.

The documents are cut into non-overlapping reference blocks of 25 words, so any window of 50 words
of a document holds one whole block. Blocks are indexed and every rolling window of 25 words probes
them. Block and window are found under the least hash of 6 words inside, which equal ones share and
which rolling neighbours mostly have in common: one probe row then stands for all of them. Hits are
extended to both sides and compared over whole windows of 50 words (see repeats.py), against blocks
of documents with a smaller doc_id.

Words are compared by 64-bit hashes, 32 bits of each in contexts of 50 and more.

Defined cases: null and empty texts have no words; documents under 50 words lose none; rows with
equal ids don't remove each other's words, null ids come after all others; very long texts are judged
whole; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import with_row_key

WINDOW, BLOCK, GRAM = 50, 25, 6
_rolls = (repeats.Roller(0xA0761D6478BD642F), repeats.Roller(0xE7037ED1A0B428DB))
_values = np.random.default_rng(4).integers(0, 2**64, 256, dtype=np.uint64)
_BLANK = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def split(data: bytes) -> list[bytes]:
    return [w for w in data.translate(_BLANK).split(b" ") if w]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and how many each text has."""
    h, _, counts = sized_word_hashes(texts)
    return h, counts


def sized_word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words, their bytes, and how many words each text has."""
    data = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    space = np.r_[True, _SPACE[data], True]
    edge = np.diff(space.astype(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.r_[0, np.searchsorted(start, ends)])
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), counts
    s = _rolls[0].prefix(_values[data])
    return _rolls[0].span(s, start, stop) ^ repeats.mix((stop - start).astype(np.uint64)), stop - start, counts


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """index of the text, packed place and offsets, h, ctx, whether a block's, of each anchor."""
    values, length = word_hashes(texts)
    n = len(values)
    if n < WINDOW:
        return (np.zeros(0, np.int64),) * 5
    start = np.cumsum(length) - length
    s, s2 = (r.prefix(values) for r in _rolls)
    h = _rolls[0].span(s, slice(0, n - GRAM + 1), slice(GRAM, n + 1))
    least = repeats.least_places(h, BLOCK - GRAM + 1)
    owner = np.repeat(np.arange(len(texts)), length)
    rolling = np.flatnonzero((owner[: n - BLOCK + 1] == owner[BLOCK - 1 :]) & (length[owner[: n - BLOCK + 1]] >= WINDOW))
    if not len(rolling):
        return (np.zeros(0, np.int64),) * 5
    p = least[rolling]  # ascending
    p = p[np.r_[True, p[1:] != p[:-1]]]
    blocks = rolling[(rolling - start[owner[rolling]]) % BLOCK == 0]
    ref = np.isin(p, least[blocks])
    doc = owner[p]
    pos = p - start[doc]
    low, high = np.maximum(0, pos - (length[doc] - WINDOW)), np.minimum(WINDOW - GRAM, pos)
    ctx = _rolls[1].span(s2, p - high, p - low + WINDOW) ^ repeats.mix((low << 10 | high).astype(np.uint64))
    return doc, repeats.packed(pos, low, high), h[p].view(np.int64), ctx.view(np.int64), ref


def _contexts(text: str, pos: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[bytes]:
    words = word_hashes([raw(text)])[0].astype(np.uint32)
    return [words[p - h : p - l + WINDOW].tobytes() for p, l, h in zip(pos.tolist(), low.tolist(), high.tolist(), strict=True)]


def _anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, docs, ids = [raw(t) for t in batch["text"]], batch["doc"].to_numpy(), batch["id"].to_numpy()
        for i, j in repeats.in_chunks(texts, 1 << 20):
            k, at, h, ctx, ref = anchors(texts[i:j])
            yield pd.DataFrame({"doc": docs[i:j][k], "id": ids[i:j][k], "at": at, "h": h, "ctx": ctx, "ref": ref.astype(bool)})


def _cut(batches: Iterator, with_text: bool) -> Iterator:
    import pyarrow as pa

    for b in batches:
        rows = []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
            words = split(raw(text))
            n = len(words)
            if spans is not None and len(spans):
                gone = repeats.covered(spans, n).tolist()
                words = [w for w, g in zip(words, gone, strict=True) if not g]
            kept = b" ".join(words)
            rows.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
        names = ["n_words", "n_removed", "kept_sha256", "kept_text"][: None if with_text else -1]
        columns = [pa.array([r[k] for r in rows], pa.int64() if n.startswith("n_") else pa.string()) for k, n in enumerate(names)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=["doc_id", *names])


def dedup(docs: DataFrame, with_text: bool = True, hot: int = repeats.HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and with_text kept_text, of every row."""
    rows = with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc")
    keyed = rows.select("doc", "text", F.coalesce("doc_id", F.lit(repeats.LAST)).alias("id"))
    found = keyed.mapInPandas(_anchor_rows, "doc long, id long, at long, h long, ctx long, ref boolean")
    spans = repeats.repeated_spans(rows, found, _contexts, WINDOW, np.uint32, ordered=True, hot=hot)
    return rows.join(spans, "doc", "left").select("doc_id", "text", "spans").mapInArrow(lambda b: _cut(b, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
