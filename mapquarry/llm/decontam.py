"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased and reduced to words joined by one space. An item of m characters
may match with k = m * rate edits; it is cut into k + 1 pieces, one of which must stand unchanged in
any match. One Aho-Corasick pass over each whole text finds the pieces, and each hit is verified by
Myers' bit-parallel distance (one machine word of any length, Python's integers) around it.

Items are a stated query set: they are sent in blocks of bounded size, each against all rows.

Defined cases: null and empty texts match nothing; items without words are ignored; items under
min_chars characters must match exactly, as whole words; equal items each report their own id; a
repeated document row reports for itself; very long texts are searched whole; empty tables give an empty
result; other columns, whatever their names, are kept by decontaminate() and ignored by contamination().
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")


def normal(text: str | None) -> str:
    return " ".join(_WORD.findall((text or "").lower()))


def budget(chars: int, rate: float, min_chars: int) -> int:
    return int(chars * rate) if chars >= min_chars else 0


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of near equal length with their places."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_distance(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of text, and where that part ends (Myers 1999, Hyyro's form)."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    vp, vn, score, best, at = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        x = peq.get(c, 0) | vn
        d0 = ((vp + (x & vp)) ^ vp) | x
        hn = vp & d0
        hp = vn | ~(vp | d0) & full
        if hp & high:
            score += 1
        elif hn & high:
            score -= 1
        hp <<= 1  # a match may start anywhere in the text: row 0 stays 0
        vp = ((hn << 1) | ~(d0 | hp)) & full
        vn = hp & d0 & full
        if score < best:
            best, at = score, j
    return best, at


class Matcher:
    """Finds items (id, normal text) in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int):
        import ahocorasick

        self.items = [(i, f" {t} " if len(t) < min_chars else t, budget(len(t), rate, min_chars)) for i, t in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            for at, piece in pieces(t, k):
                where.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()
        self.any = bool(where)

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, least distance, budget, end of the match in the normal text) for each item found."""
        t = f" {normal(text)} "
        if not self.any or len(t) < 3:
            return []
        best: dict[int, tuple[int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for end, (length, places) in self.automaton.iter(t):
            for n, at in places:
                _, item, k = self.items[n]
                start = end + 1 - length - at  # where the item would start without edits before the piece
                if (n, start) in tried or best.get(n, (k + 1, 0))[0] == 0:
                    continue
                tried.add((n, start))
                if k == 0:
                    best[n] = (0, end + 1)
                    continue
                low = max(0, start - k)
                d, stop = best_distance(item, t[low : start + len(item) + k])
                if d <= k and d < best.get(n, (k + 1, 0))[0]:
                    best[n] = (d, low + stop)
        return [(self.items[n][0], d, self.items[n][2], stop) for n, (d, stop) in sorted(best.items())]


def blocks(benchmark: DataFrame, max_chars: int = 8_000_000) -> Iterator[list[tuple[int, str]]]:
    """Items as (id, normal text), in blocks of at most max_chars characters (one item at least)."""
    block, chars = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text").toLocalIterator():
        t = normal(r[1])
        if not t:
            continue
        if block and chars + len(t) > max_chars:
            yield block
            block, chars = [], 0
        block.append((r[0], t))
        chars += len(t)
    if block:
        yield block


FOUND = "doc_id long, item_id long, distance int, budget int, end_char long"


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, min_chars: int = 40) -> DataFrame:
    """One row for each document and item found: doc_id, item_id, distance, budget, end_char."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], FOUND)
    for block in blocks(benchmark):
        out = out.union(texts.mapInArrow(_rows(block, rate, min_chars), FOUND))
    return out


def _rows(items: list[tuple[int, str]], rate: float, min_chars: int):
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(items, rate, min_chars)
        for b in batches:
            hits = [(i, *hit) for i, t in enumerate(b.column("text").to_pylist()) for hit in m.find(t)]
            ids = b.column("doc_id").take(pa.array([h[0] for h in hits], pa.int64()))
            rest = [pa.array([h[k] for h in hits], kind) for k, kind in ((1, pa.int64()), (2, pa.int32()), (3, pa.int32()), (4, pa.int64()))]
            yield pa.RecordBatch.from_arrays([ids, *rest], names=["doc_id", "item_id", "distance", "budget", "end_char"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, min_chars: int = 40) -> DataFrame:
    """The rows of docs in which no item is found, in one pass for each block of items and without a shuffle."""
    import pyarrow as pa

    for block in blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items: list[tuple[int, str]] = block) -> Iterator[pa.RecordBatch]:
            m = Matcher(items, rate, min_chars)
            for b in batches:
                yield b.filter(pa.array([not m.find(None if t is None else str(t)) for t in b.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
