"""Repeated windows of W units (bytes or words) in a corpus, without all windows or all pairs.

Both substring operators choose anchors: places that equal windows share at equal offsets. An anchor
has a hash h of the few units from it on, the range of window offsets it stands for (a window with
offset o starts o units before the anchor), and a hash ctx of everything those windows cover.

1. Per h, pre-aggregated: how many anchors, and whether all have one ctx. Lone ones are done, and
   where there is one ctx all the windows repeat; no text moves.
2. Only anchors of the rest, whose surroundings differ in part, bring their text: contexts are
   partitioned, sorted to the right and to the left of the anchor by multikey quicksort, and common
   prefix lengths of neighbours tell for each offset which windows are equal.
3. The spans found go to their document.

h and ctx are 64-bit hashes each, compared together, so equality in step 1 is of 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_partitions, written

_M = (1 << 64) - 1
LAST = 2**63 - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finish)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Roller:
    """Hashes of any span of a sequence of 64-bit values, from prefix sums of value * base ** place."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        n = len(values) + 1
        if len(self.up) < n:
            size = 1 << n.bit_length()
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size, self.base, dtype=np.uint64)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size, self.inverse, dtype=np.uint64)], dtype=np.uint64)
        out = np.zeros(n, dtype=np.uint64)
        np.cumsum(values * self.up[: n - 1], out=out[1:])
        return out

    def span(self, s: np.ndarray, start, stop) -> np.ndarray:
        return mix((s[stop] - s[start]) * self.down[start])


def least_in_windows(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, from running minima of blocks of w to both sides."""
    n = len(v)
    blocks = np.full(-(-n // w) * w, _M, dtype=np.uint64)
    blocks[:n] = v
    blocks = blocks.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def least_places(h: np.ndarray, w: int) -> np.ndarray:
    """For each w neighbouring hashes the place of the least (by the upper 32 bits; the first among equals).

    The number of bits is the same for every chunk, so equal windows choose alike wherever they stand.
    """
    low = np.uint64(0xFFFFFFFF)
    v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    return (least_in_windows(v, w) & low).astype(np.int64)


def multikey_order(keys: np.ndarray) -> np.ndarray:
    """Order of the rows of an n x c matrix of 64-bit characters by multikey quicksort.

    Each segment of rows that agree in their first d characters is cut in three by its pivot (the
    median of three rows' next character): the rows below and above it are cut again at the same
    character, the equal ones at the next. All segments are cut side by side, a round at a time.
    """
    n, width = keys.shape
    order = np.arange(n)
    start, size, depth = np.array([0]), np.array([n]), np.array([0])
    if n < 2 or not width:
        return order
    while len(start):
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        seg = np.repeat(np.arange(len(start)), size)
        rows = order[at]
        char = keys[rows, depth[seg]]
        begin = np.cumsum(size) - size
        three = np.stack([char[begin], char[begin + size // 2], char[begin + size - 1]])
        pivot = np.sort(three, axis=0)[1]
        kind = (char == pivot[seg]) + 2 * (char > pivot[seg])
        count = np.bincount(3 * seg + kind, minlength=3 * len(start)).reshape(-1, 3)
        first = start[:, None] + np.cumsum(count, axis=1) - count
        # a row's place among those of its segment and kind, in their order so far
        to = np.empty(len(at), dtype=np.int64)
        for k in range(3):
            mine = np.flatnonzero(kind == k)
            before = np.cumsum(count[:, k]) - count[:, k]
            to[mine] = first[seg[mine], k] + np.arange(len(mine)) - before[seg[mine]]
        order[to] = rows
        size, start = count.ravel(), first.ravel()
        depth = (depth[:, None] + np.array([0, 1, 0])).ravel()
        on = (size > 1) & (depth < width)
        start, size, depth = start[on], size[on], depth[on]
    return order


def characters(units: np.ndarray) -> np.ndarray:
    """A matrix of uint8 or uint32 units as 64-bit characters in the same lexical order."""
    per = 8 // units.itemsize
    n, m = units.shape
    wide = np.zeros((n, max(1, -(-m // per)) * per), dtype=units.dtype)
    wide[:, :m] = units
    return wide.astype(units.dtype.newbyteorder(">")).view(">u8").astype(np.uint64)


def common_prefix(units: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each row and the one before it in order; -1 for the first."""
    out = np.full(len(order), -1, dtype=np.int64)
    for k in range(1, len(order), 1 << 16):
        now = order[k : k + (1 << 16)]
        differ = units[now] != units[order[k - 1 : k - 1 + len(now)]]
        out[k : k + len(now)] = np.where(differ.any(axis=1), differ.argmax(axis=1), units.shape[1])
    return out


def sides(context: list[bytes], left: np.ndarray, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of the units right of the anchors and left of them (nearest first), padded with 0."""
    size = np.dtype(dtype).itemsize
    flat = np.frombuffer(b"".join(context), dtype=dtype)
    length = np.array([len(c) for c in context], dtype=np.int64) // size
    start = np.cumsum(length) - length
    anchor = start + left
    out = []
    for count, step in ((length - left, 1), (left, -1)):
        m = np.zeros((len(context), max(1, int(count.max(initial=0)))), dtype=dtype)
        rows = np.repeat(np.arange(len(context)), count)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
        m[rows, place] = flat[(np.repeat(anchor, count) + place) if step > 0 else (np.repeat(anchor, count) - 1 - place)]
        out.append(m)
    return out[0], out[1]


def equal_windows(right: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, window: int, ids: np.ndarray | None = None, ref: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For each offset, the rows whose window of that offset repeats.

    Without ids: in any other row. With ids: in a row marked ref of a smaller id.
    """
    n = len(low)
    order_r, order_l = multikey_order(characters(right)), multikey_order(characters(left))
    lcp_r, lcp_l = common_prefix(right, order_r), common_prefix(left, order_l)
    place_r, place_l = np.empty(n, np.int64), np.empty(n, np.int64)
    place_r[order_r], place_l[order_l] = np.arange(n), np.arange(n)
    near_r = np.maximum(lcp_r, np.r_[lcp_r[1:], -1])[place_r]  # the longest prefix shared with any row
    near_l = np.maximum(lcp_l, np.r_[lcp_l[1:], -1])[place_l]
    for o in range(int(low.min(initial=0)), int(high.max(initial=-1)) + 1):
        act = np.flatnonzero((low <= o) & (o <= high) & (near_r >= window - o) & (near_l >= o))
        if len(act) < 2:
            continue
        run_r, run_l = np.cumsum(lcp_r < window - o), np.cumsum(lcp_l < o)
        key = run_r[place_r[act]] * (n + 1) + run_l[place_l[act]]
        if ids is None:
            _, group, count = np.unique(key, return_inverse=True, return_counts=True)
            found = act[count[group] > 1]
        else:
            _, group = np.unique(key, return_inverse=True)
            least = np.full(group.max() + 1, LAST)
            np.minimum.at(least, group[ref[act]], ids[act][ref[act]])
            found = act[ids[act] > least[group]]
        if len(found):
            yield o, found


def _spans(df: pd.DataFrame, window: int, dtype: type, ordered: bool) -> Iterator[pd.DataFrame]:
    low, high = df["low"].to_numpy(np.int64), df["high"].to_numpy(np.int64)
    right, left = sides(df["context"].tolist(), high, dtype)
    args = (df["id"].to_numpy(np.int64), df["ref"].to_numpy(bool)) if ordered else ()
    pos, doc = df["pos"].to_numpy(np.int64), df["doc"].to_numpy(np.int64)
    # offsets come in order: a row's span goes on while its offsets follow one another
    first, last = np.full(len(pos), -1), np.full(len(pos), -2)

    def closed(rows: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"doc": doc[rows], "s": pos[rows] - last[rows], "e": pos[rows] - first[rows] + window})

    for o, found in equal_windows(right, left, low, high, window, *args):
        fresh = found[last[found] != o - 1]
        ended = fresh[last[fresh] >= 0]
        if len(ended):
            yield closed(ended)
        first[fresh] = o
        last[found] = o
    yield closed(np.flatnonzero(last >= 0))


def spans_of(window: int, dtype: type, ordered: bool, rows: int = 20_000) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Contexts sorted by h to spans doc, s, e; some rows at a time, groups of equal h never parted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for b in batches:
            if not len(b):
                continue
            if size >= rows:
                cut = int((b["h"] != held[-1]["h"].iloc[-1]).to_numpy().argmax()) if b["h"].iloc[-1] != held[-1]["h"].iloc[-1] else len(b)
                held.append(b.iloc[:cut])
                b = b.iloc[cut:]
                if len(b):
                    yield from _spans(pd.concat(held, ignore_index=True), window, dtype, ordered)
                    held, size = [], 0
            if len(b):
                held.append(b)
                size += len(b)
        if held:
            yield from _spans(pd.concat(held, ignore_index=True), window, dtype, ordered)

    return run


def _window_rows(window: int, dtype: type, ordered: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Contexts to one row for each of their windows: a 128-bit key, doc, start (and id, ref)."""
    from xxhash import xxh3_128_digest

    size = np.dtype(dtype).itemsize

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 500):
                part = b.iloc[k : k + 500]
                n = (part["high"] - part["low"] + 1).to_numpy()
                row = np.repeat(np.arange(len(part)), n)
                offset = np.concatenate([np.arange(lo, hi + 1) for lo, hi in zip(part["low"], part["high"], strict=True)])
                start = (part["high"].to_numpy()[row] - offset) * size
                contexts = part["context"].tolist()
                keys = [xxh3_128_digest(contexts[r][s : s + window * size]) for r, s in zip(row.tolist(), start.tolist(), strict=True)]
                out = {"key": keys, "doc": part["doc"].to_numpy()[row], "s": part["pos"].to_numpy()[row] - offset}
                if ordered:
                    out |= {"id": part["id"].to_numpy()[row], "ref": part["ref"].to_numpy(bool)[row]}
                yield pd.DataFrame(out)

    return run


#: One long for place, lowest and highest offset.
def packed(pos: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (pos.astype(np.int64) << 20) | (low.astype(np.int64) << 10) | high.astype(np.int64)


#: Groups of more contexts than this are compared window by window instead of in one task.
HOT = 30_000


def repeated_spans(docs: DataFrame, anchors: DataFrame, contexts: Callable, window: int, dtype: type, ordered: bool, splitters: Callable[[int], np.ndarray] | None = None, hot: int = HOT) -> DataFrame:
    """doc, spans (array of s, e) of repeated windows.

    docs: doc, text (and id if ordered). anchors: doc, at (packed), h, ctx, and if ordered id, ref.
    contexts(text, places, lows, highs): the context of each anchor, as bytes.
    splitters(n): n - 1 ascending leading strings that range-partition the contexts by what stands
    right of the anchor; without it h hash-partitions them. Either way equal anchors meet.
    """
    spark = docs.sparkSession
    more = ["id", "ref"] if ordered else []
    stats = [F.count("*").alias("n"), F.min("ctx").alias("c0"), F.max("ctx").alias("c1")]
    if ordered:
        stats += [F.min(F.when(F.col("ref"), F.col("id"))).alias("least"), F.max("id").alias("most")]
    by_h = anchors.groupBy("h").agg(*stats).where("least < most" if ordered else "n > 1")
    # written, so that both sides of the join come from exchanges and a hot h can be split
    by_h = written(by_h.select("h", (F.col("c0") == F.col("c1")).alias("same"), *(["least"] if ordered else [])))
    hits = anchors.join(by_h, "h")
    if ordered:
        hits = hits.where("id > least or (ref and not same)")
    hits = written(hits.select("doc", "at", "same", *[F.when(~F.col("same"), F.col(c)).alias(c) for c in ("h", "ctx", *more)]))
    low, high = F.shiftright("at", 10).bitwiseAND(1023), F.col("at").bitwiseAND(1023)
    pos = F.shiftright("at", 20)
    span = [F.col("doc"), (pos - high).alias("s"), (pos - low + window).alias("e")]
    mixed = hits.where("not same")

    # anchors of one h and ctx: what repeats within such a class is settled, one row stands for it
    if ordered:
        classes = mixed.groupBy("h", "ctx").agg(F.min(F.when(F.col("ref"), F.col("id"))).alias("least"))
        settled = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
        left_over = ~settled
    else:
        classes = mixed.groupBy("h", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("doc", "at")).alias("first"))
        settled = F.col("n") > 1
        left_over = (F.col("first.doc") == F.col("doc")) & (F.col("first.at") == F.col("at"))
    judged = written(mixed.join(written(classes), ["h", "ctx"]).select("doc", "at", "h", *more, settled.alias("settled"), left_over.alias("open")))
    whole = hits.where("same").select(*span).union(judged.where("settled").select(*span))

    rest = judged.where("open")
    groups = written(rest.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    rest = rest.join(groups, "h").select("doc", "at", "h", *more, (F.col("n") > hot).alias("hot"))
    lists = [F.collect_list(c).alias(c) for c in ("at", "h", "hot", *more)]
    per_doc = rest.groupBy("doc").agg(*lists)
    parts = n_partitions(spark)
    bounds = splitters(8 * parts) if splitters else None

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 200):
                part = b.iloc[k : k + 200]
                at = [np.asarray(a, dtype=np.int64) for a in part["at"]]
                found = [contexts(t, a >> 20, (a >> 10) & 1023, a & 1023) for t, a in zip(part["text"], at, strict=True)]
                context = [c for f in found for c in f]
                a = np.concatenate(at)
                out = {"doc": np.repeat(part["doc"].to_numpy(), [len(x) for x in at]), "pos": a >> 20, "low": (a >> 10) & 1023, "high": a & 1023, "h": np.concatenate(part["h"].tolist()), "context": context, "hot": np.concatenate(part["hot"].tolist()).astype(bool)}
                if ordered:
                    out |= {"id": np.concatenate(part["id"].tolist()).astype(np.int64), "ref": np.concatenate(part["ref"].tolist()).astype(bool)}
                if bounds is not None:
                    lead = [c[h : h + bounds.dtype.itemsize] for c, h in zip(context, out["high"].tolist(), strict=True)]
                    out["bucket"] = np.searchsorted(bounds, np.array(lead, dtype=bounds.dtype), side="right")
                yield pd.DataFrame(out)

    schema = "doc long, pos long, low long, high long, h long, context binary, hot boolean" + ", id long, ref boolean" * ordered + ", bucket long" * (bounds is not None)
    around = docs.select("doc", "text").join(per_doc, "doc").mapInPandas(cut, schema)
    if rest.where("hot").isEmpty():
        windows, usual = None, around
    else:
        around = written(around)
        usual = around.where("not hot")
        rows = around.where("hot").mapInPandas(_window_rows(window, dtype, ordered), "key binary, doc long, s long" + ", id long, ref boolean" * ordered)
        again = rows.groupBy("key").agg(F.min(F.when(F.col("ref"), F.col("id"))).alias("least") if ordered else F.count("*").alias("n"))
        windows = rows.join(again, "key").where("id > least" if ordered else "n > 1").select("doc", "s", (F.col("s") + window).alias("e"))
    key = "h" if bounds is None else "bucket"
    partly = usual.repartition(parts, key).sortWithinPartitions(key, "h").mapInPandas(spans_of(window, dtype, ordered), "doc long, s long, e long")
    found = whole.union(partly) if windows is None else whole.union(partly).union(windows)
    return found.groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def covered(spans, size: int) -> np.ndarray:
    """Which of size units the spans cover."""
    step = np.zeros(size + 1, dtype=np.int32)
    if spans is not None and len(spans):
        np.add.at(step, [x["s"] for x in spans], 1)
        np.add.at(step, [x["e"] for x in spans], -1)
    return np.cumsum(step[:-1]) > 0


def in_chunks(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of at most limit bytes together, or one text."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
