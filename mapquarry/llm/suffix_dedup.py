"""Exact substring dedup over bytes by a sparse suffix array.

Every string of 200 bytes that starts at two places is removed at all of them. Sorting all suffixes
would move each byte 200 times, so suffixes are taken at anchors only: in each window of 200 bytes
the place of the least hash of 32 bytes, which equal windows share. Anchors whose 32 bytes stand
nowhere else, or whose whole surroundings repeat, are settled by counts (see repeats.py). The
suffixes of the rest are range-partitioned by their 32 leading bytes with splitters sampled from
a bounded number of documents (they only even out the buckets); buckets
sort them by multikey quicksort, and neighbours' common prefixes give the repeated windows. Equal
keys never straddle a splitter: neighbours across a bucket's boundary differ in their 32 leading
bytes, so no window reaches over it. Where more suffixes share their 32 bytes than one task should
hold, their windows are counted by 128-bit hashes instead, pre-aggregated.

Defined cases: null and empty texts have no bytes; texts under 200 bytes lose none; repeated rows
and ids are documents of their own; very long texts are judged whole; an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import sample_texts, with_row_key

WINDOW, GRAM = 200, 32
_rolls = (repeats.Roller(0x9E3779B97F4A7C15), repeats.Roller(0xD1B54A32D192ED03))
_values = np.random.default_rng(3).integers(0, 2**64, 256, dtype=np.uint64)


def raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """index of the text, packed place and offsets, h, ctx of each anchor."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    length = np.array([len(t) for t in texts], dtype=np.int64)
    start = np.cumsum(length) - length
    if len(data) < WINDOW:
        return (np.zeros(0, np.int64),) * 4
    values = _values[data]
    s, s2 = (r.prefix(values) for r in _rolls)
    n = len(data)
    h = _rolls[0].span(s, slice(0, n - GRAM + 1), slice(GRAM, n + 1))
    least = repeats.least_places(h, WINDOW - GRAM + 1)
    owner = np.repeat(np.arange(len(texts)), length)
    windows = np.flatnonzero(owner[: n - WINDOW + 1] == owner[WINDOW - 1 :])
    if not len(windows):
        return (np.zeros(0, np.int64),) * 4
    p = least[windows]
    first = np.r_[0, np.flatnonzero(np.diff(p)) + 1]
    a, b, p = windows[first], windows[np.r_[first[1:], len(p)] - 1], p[first]
    low, high = p - b, p - a
    ctx = _rolls[1].span(s2, a, b + WINDOW) ^ repeats.mix((low << 10 | high).astype(np.uint64))
    doc = owner[p]
    return doc, repeats.packed(p - start[doc], low, high), h[p].view(np.int64), ctx.view(np.int64)


def splitters(rows: DataFrame, n: int, sample_docs: int = 400) -> np.ndarray:
    """n - 1 strings of 32 bytes that cut the anchors of a bounded sample of documents evenly."""
    texts = [raw(t) for t in sample_texts(rows, "doc", sample_docs)]
    lead = []
    for t in texts:
        _, at, _, _ = anchors([t])
        lead += [t[p : p + GRAM] for p in (at >> 20).tolist()]
    lead = np.sort(np.array(lead, dtype=f"S{GRAM}")) if lead else np.zeros(0, dtype=f"S{GRAM}")
    return np.unique(lead[np.linspace(0, len(lead) - 1, n + 1).astype(int)[1:-1]]) if len(lead) else lead


def _contexts(text: str, pos: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[bytes]:
    data = raw(text)
    return [data[p - h : p - l + WINDOW] for p, l, h in zip(pos.tolist(), low.tolist(), high.tolist(), strict=True)]


def _anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, docs = [raw(t) for t in batch["text"]], batch["doc"].to_numpy()
        for i, j in repeats.in_chunks(texts, 1 << 20):
            k, at, h, ctx = anchors(texts[i:j])
            yield pd.DataFrame({"doc": docs[i:j][k], "at": at, "h": h, "ctx": ctx})


def _cut(batches: Iterator, with_text: bool) -> Iterator:
    import pyarrow as pa

    for b in batches:
        rows = []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
            data = raw(text)
            gone = repeats.covered(spans, len(data))
            runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if len(data) else 0
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if runs else data
            rows.append((len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: None if with_text else -1]
        columns = [pa.array([r[k] for r in rows], pa.int64() if n.startswith("n_") else pa.string()) for k, n in enumerate(names)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=["doc_id", *names])


def dedup(docs: DataFrame, with_text: bool = True, hot: int = repeats.HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with_text kept_text (undecodable bytes at cuts replaced), of every row."""
    rows = with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc")
    found = rows.select("doc", "text").mapInPandas(_anchor_rows, "doc long, at long, h long, ctx long")
    spans = repeats.repeated_spans(rows, found, _contexts, WINDOW, np.uint8, ordered=False, splitters=lambda n: splitters(rows, n), hot=hot)
    return rows.join(spans, "doc", "left").select("doc_id", "text", "spans").mapInArrow(lambda b: _cut(b, with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text)
