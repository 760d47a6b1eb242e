"""Fuzzy line dedup by MinHash over character shingles.

A line's shingles are the SHINGLE characters from each of its characters on (a shorter line is one
shingle). Its signature is a one-permutation MinHash: shingle hashes fall into BANDS * ROWS bins, each
bin gives its least hash, and an empty bin borrows the next one's. ROWS bins make a band, so lines of
Jaccard similarity s share one of six bands with probability 1 - (1 - s^3)^6: 0.986 at 0.8. Lines
that share a band are verified by the exact Jaccard similarity of all their shingles, links are joined
by distributed union-find, and of each component the first line stays: the one with the smallest
doc_id, then row, then place.

Equal lines are one from the start. A band's lines are streamed in the order of a further band and each
is compared with the WINDOW before it and the band's first PIVOTS; with up to WINDOW + 1 lines these are
all pairs. Lines of larger bands that are not one component by then (common shingles make such bands) are
compared by an exact prefix filter: in an order of all shingles, rare ones first, lines of similarity t
share one of the first n - ceil(t n) + 1 shingles of each. The order comes from a table of BUCKETS
counts, of fixed size; any order finds all links, a good one keeps the groups small. Lines of one
component are not compared again.

Before two lines are compared, their sizes and parities rule out most pairs that are not similar, and no
other: sets differ in at least as many hashes as their parities do in bits.

Cutting shingles with built-in functions alone took more CPU time than the whole job may (see
README), so signatures and similarities are computed by numpy in Arrow batches; the joins, aggregates and
union-find are DataFrame operations.

Defined cases: lines without a word stay, and so do null and empty texts; null ids come last when the
first line is chosen; repeated rows are documents of their own (the first keeps its lines); an empty
table gives an empty result; very long lines are hashed piece by piece; other columns, whatever their
names, are kept by dedup() and ignored by removed_lines(). Lines are told apart by 64-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import n_partitions, packed_rows, unpacked, with_row_key, written
from .components import components
from .repeats import Roller, mix

SHINGLE, BANDS, ROWS = 10, 6, 3
WINDOW, PIVOTS = 4, 2
#: Bits of a further band that order a band's lines.
NEXT = 24
#: Counts of shingles, by their hashes' upper bits, that order them.
BUCKETS = 1 << 18
#: Characters hashed at a time.
PIECE = 1 << 18
#: Characters of short lines hashed at a time, so that the arrays stay in a core's cache.
TOGETHER = 1 << 15
#: Words of the parities that tell lines apart before they are compared (64 WORDS bits, a power of two).
WORDS = 16
PARITIES = [f"w{k}" for k in range(WORDS)]
SIZES = ["n", *PARITIES]
_WORD = re.compile(r"[^\x20\x09-\x0D]")
_BINS = BANDS * ROWS
_roll = Roller(0xA24BAED4963EE407)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of the lines, one line after another, and how many each line has (repeats included)."""
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    count = np.where(length > SHINGLE, length - SHINGLE + 1, length > 0)
    v = codes("".join(lines))
    s = _roll.prefix(v + np.uint64(1))
    stop = np.cumsum(length)
    start = stop - length
    # from each place on, also across the ends of lines; these and what short lines have instead are put right after that
    h = np.zeros(len(v), dtype=np.uint64)
    some = max(0, len(v) - SHINGLE + 1)
    np.subtract(s[SHINGLE:], s[:some], out=h[:some])
    h[:some] *= _roll.down[:some]
    short = np.flatnonzero((length > 0) & (length < SHINGLE))
    h[start[short]] = (s[stop[short]] - s[start[short]]) * _roll.down[start[short]]
    spare = length - count
    keep = np.ones(len(v), dtype=bool)
    keep[np.arange(int(spare.sum())) + np.repeat(stop - np.cumsum(spare), spare)] = False
    return mix(h[keep]), count


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, each value once (sorting words takes a fraction of the time of a hash table)."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _least(h: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Least hash (above 0) in each of the bins of each of n lines; 0 for an empty bin."""
    low = np.uint64(0xFFFFFFFF)
    bins = ((h & low) * np.uint64(_BINS)) >> np.uint64(32)
    key = (np.repeat(np.arange(n, dtype=np.uint64), count) << np.uint64(37)) | (bins << np.uint64(32)) | (h >> np.uint64(32))
    key.sort()
    where = key >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]]) if len(key) else np.zeros(0, np.int64)
    out = np.zeros((n, _BINS), dtype=np.uint64)
    out[(where[first] >> np.uint64(5)).astype(np.int64), (where[first] & np.uint64(31)).astype(np.int64)] = (key[first] & low) + np.uint64(1)
    return out


def signatures(lines: list[str]) -> np.ndarray:
    """A row of BANDS band keys for each line (lines with a character)."""
    if len(lines) == 1 and len(lines[0]) > PIECE:
        m = np.zeros((1, _BINS), dtype=np.uint64)
        for a in range(0, len(lines[0]) - SHINGLE + 1, PIECE):
            part = _least(*shingle_hashes([lines[0][a : a + PIECE + SHINGLE - 1]]), 1)
            m = np.where((m == 0) | ((part > 0) & (part < m)), part, m)
    else:
        m = _least(*shingle_hashes(lines), len(lines))
    for _ in range(_BINS):  # an empty bin takes the next one's, marked by how far it came
        gap = m == 0
        if not gap.any():
            break
        after = np.roll(m, -1, axis=1)
        m = np.where(gap & (after > 0), after + np.uint64(1 << 33), m)
    band = np.full((len(lines), BANDS), np.arange(1, BANDS + 1, dtype=np.uint64))
    for k in range(ROWS):
        band = mix(band * np.uint64(0x9E3779B97F4A7C15) + m[:, k::ROWS])
    return band.view(np.int64)


def in_pieces(lines: list[str], few: bool = False, most: int = 1 << 15) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring lines of at most PIECE (few: TOGETHER) characters together, or one line."""
    limit = min(PIECE, TOGETHER) if few else PIECE
    start = size = 0
    for i, x in enumerate(lines):
        if i > start and (size + len(x) > limit or i - start == most):
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(lines):
        yield start, len(lines)


BAND_COLUMNS = [f"b{k}" for k in range(BANDS)]
LINES = "row long, doc_id long, pos int, id long, " + ", ".join(f"{c} long" for c in BAND_COLUMNS)


def _line_rows(batches: Iterator) -> Iterator:
    import pyarrow as pa
    from xxhash import xxh3_64_intdigest

    names = ["row", "doc_id", "pos", "id", *BAND_COLUMNS]
    for b in batches:
        texts = b.column("text").to_pylist()
        for i, j in in_pieces([t or "" for t in texts]):
            parts = [(t or "").split("\n") for t in texts[i:j]]
            lines = [x for p in parts for x in p]
            owner = np.repeat(np.arange(i, j), [len(p) for p in parts])
            pos = np.concatenate([np.arange(len(p), dtype=np.int32) for p in parts])
            live = np.array([k for k, x in enumerate(lines) if _WORD.search(x)], dtype=np.int64)
            some = [lines[k] for k in live.tolist()]
            sig = np.concatenate([signatures(some[a:z]) for a, z in in_pieces(some, few=True)]) if some else np.zeros((0, BANDS), np.int64)
            blank = np.ones(len(lines), dtype=bool)
            blank[live] = False
            out = np.zeros((len(lines), BANDS + 1), dtype=np.int64)
            out[live, 0] = np.array([xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in some], dtype=np.uint64).view(np.int64)
            out[live, 1:] = sig
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays([b.column("row").take(at), b.column("doc_id").take(at), pa.array(pos), *[pa.array(out[:, k], mask=blank) for k in range(BANDS + 1)]], names=names)


def _pair_rows(window: int, pivots: int, hold: int = 1 << 16) -> Callable[[Iterator], Iterator]:
    """Rows (key, id) sorted by key, a band above NEXT bits, to pairs (a, b), and to (id, null, band) for each line of a band of more than window + 1."""
    import pyarrow as pa

    def found(band: np.ndarray, ids: np.ndarray, fresh: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
        size = np.diff(np.r_[start, len(band)])
        first, size = np.repeat(start, size), np.repeat(size, size)
        here = np.arange(len(band))
        x, y = [], []
        for d in range(1, window + 1):
            same = np.flatnonzero(band[d:] == band[:-d])
            x.append(same)
            y.append(same + d)
        far = here[here - first > window]
        for p in range(pivots):
            x.append(first[far] + p)
            y.append(far)
        x, y = ids[np.concatenate(x)], ids[np.concatenate(y)]
        apart = x != y
        x, y = x[apart], y[apart]
        large = np.flatnonzero((size > window + 1) & fresh)
        n, m = len(x), len(large)
        none = np.r_[np.zeros(n, bool), np.ones(m, bool)]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.r_[np.minimum(x, y), ids[large]]), pa.array(np.r_[np.maximum(x, y), np.zeros(m, np.int64)], mask=none), pa.array(np.r_[np.zeros(n, np.int64), band[large]], mask=~none)], names=["a", "b", "band"]
        )

    def run(batches: Iterator) -> Iterator:
        band, ids, fresh = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        for b in batches:
            if not b.num_rows:
                continue
            band = np.r_[band, b.column("key").to_numpy() >> NEXT]
            ids = np.r_[ids, b.column("id").to_numpy()]
            fresh = np.r_[fresh, np.ones(b.num_rows, bool)]
            last = int(np.searchsorted(band, band[-1]))  # where the last run starts, which may go on
            if last:
                yield found(band[:last], ids[:last], fresh[:last])
                band, ids, fresh = band[last:], ids[last:], fresh[last:]
            elif len(band) > hold:
                yield found(band, ids, fresh)
                seed = np.r_[np.arange(pivots), np.arange(len(band) - window - 1, len(band))]
                band, ids, fresh = band[seed], ids[seed], np.zeros(len(seed), bool)
        if len(band):
            yield found(band, ids, fresh)

    return run


def _parity(key: np.ndarray, first: np.ndarray, block: int = 1 << 10) -> np.ndarray:
    """WORDS words for each line: the parity of the distinct hashes that fall on a bit, by lines that begin at first (keys hold the line above 48 bits)."""
    out = np.empty((len(first), WORDS), dtype=np.int64)
    end = np.r_[first, len(key)]
    for a in range(0, len(first), block):
        z = min(a + block, len(first))
        some = key[end[a] : end[z]]
        at = (((some >> np.uint64(48)) - np.uint64(a)) * np.uint64(64 * WORDS)) + (some & np.uint64(64 * WORDS - 1))
        odd = np.bincount(at.view(np.int64), minlength=(z - a) * 64 * WORDS).astype(np.uint8) & 1
        out[a:z] = np.packbits(odd, bitorder="little").view(np.int64).reshape(z - a, WORDS)
    return out


def _set_rows(batches: Iterator) -> Iterator:
    """text, want (id, pos) to id, line, n (distinct shingles) and words of parities; null n and words for a very long line."""
    import pyarrow as pa

    for b in batches:
        ids, lines = [], []
        for text, want in zip(b.column("text").to_pylist(), b.column("want").to_pylist(), strict=True):
            at = text.split("\n")
            ids += [w["id"] for w in want]
            lines += [at[w["pos"]] for w in want]
        for i, j in in_pieces(lines):
            k = j - i
            if len(lines[i]) > PIECE:
                n, w = np.zeros(1, np.int64), np.zeros((1, WORDS), np.int64)
                mask = np.ones(1, bool)
            else:
                h, count = shingle_hashes(lines[i:j])
                key = distinct((np.repeat(np.arange(k, dtype=np.uint64), count) << np.uint64(48)) | (h >> np.uint64(16)))
                first = np.searchsorted(key, np.arange(k, dtype=np.uint64) << np.uint64(48))
                n = np.diff(np.r_[first, len(key)])
                w = _parity(key, first)
                mask = np.zeros(k, bool)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], pa.int64()), pa.array(lines[i:j], pa.string()), *[pa.array(c, pa.int64(), mask=mask) for c in (n, *np.ascontiguousarray(w.T))]], names=["id", "line", *SIZES])


def similar(left: list[str], right: list[str], threshold: float) -> np.ndarray:
    """Whether each two lines have at least this Jaccard similarity, by all their shingles."""
    out = []
    both = [a + b for a, b in zip(left, right, strict=True)]
    for i, j in in_pieces(both, few=True):
        k = j - i
        # a long pair is compared by ranges of its hashes, so that no array is longer than some PIECEs
        ranges = -(-len(both[i]) // (4 * PIECE)) if k == 1 else 1
        union, common = np.zeros(k, np.int64), np.zeros(k, np.int64)
        for r in range(ranges):
            keys = []
            for side, lines in enumerate((left[i:j], right[i:j])):
                parts = [lines[0][a : a + PIECE + SHINGLE - 1] for a in range(0, max(1, len(lines[0]) - SHINGLE + 1), PIECE)] if ranges > 1 else None
                for part in [[p] for p in parts] if parts else [lines]:
                    h, count = shingle_hashes(part)
                    key = (np.repeat(np.arange(k, dtype=np.uint64), count) << np.uint64(48)) | ((h >> np.uint64(17)) << np.uint64(1)) | np.uint64(side)
                    keys.append(key[h % np.uint64(ranges) == r] if ranges > 1 else key)
            key = distinct(np.concatenate(keys))
            twin = (key[1:] ^ key[:-1]) == 1
            owner = (key >> np.uint64(48)).astype(np.int64)
            shared = np.bincount(owner[1:][twin], minlength=k)
            common += shared
            union += np.bincount(owner, minlength=k) - shared
        out.append(common >= threshold * union - 1e-9)
    return np.concatenate(out) if out else np.zeros(0, bool)


def _judged(threshold: float) -> Callable[[Iterator], Iterator]:
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            ok = similar(b.column("line_a").to_pylist(), b.column("line_b").to_pylist(), threshold)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return run


def _differ(threshold: float) -> Column:
    """Whether sizes and parities of two lines (n_a, w0_a ... and n_b, w0_b ...) leave the similarity open: similar sets differ in few hashes, and at least in as many as bits of their parities do."""
    bits = reduce(add, [F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in PARITIES])
    near = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(threshold) - 1e-9
    return F.coalesce(near & (bits * F.lit(1 + threshold) <= F.lit(1 - threshold) * (F.col("n_a") + F.col("n_b")) + 1e-6), F.lit(True))


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of lines (id, line, n, parities) that are at least so similar."""
    side = lambda k: sets.select(F.col("id").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("line", *SIZES)])
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(_differ(threshold))
    return both.select("a", "b", "line_a", "line_b").mapInArrow(_judged(threshold), "a long, b long")


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _count_rows(batches: Iterator) -> Iterator:
    """line to bucket, n: how many distinct shingles of lines fall into each bucket."""
    import pyarrow as pa

    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for line in b.column("line").to_pylist():
            total += np.bincount(_bucket(distinct(shingle_hashes([line])[0])), minlength=BUCKETS) if len(line) > PIECE else 0
        lines = [x for x in b.column("line").to_pylist() if len(x) <= PIECE]
        for i, j in in_pieces(lines):
            h, count = shingle_hashes(lines[i:j])
            owner = np.repeat(np.arange(j - i, dtype=np.uint64), count) << np.uint64(48)
            # bucket bits are among the upper 48 of the hash
            key = distinct(owner | (h >> np.uint64(16)))
            np.add.at(total, _bucket(key << np.uint64(16)), 1)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])


def _prefix_rows(counts: np.ndarray, threshold: float) -> Callable[[Iterator], Iterator]:
    """id, root, line, n and parities to a row with key for each of the line's rarest shingles that a similar line must share one of.

    p and q hold 32 bits each of the four keys before it.
    """
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            rows, keys, before = [], [], []
            for k, line in enumerate(b.column("line").to_pylist()):
                h = distinct(shingle_hashes([line])[0])
                first = h[np.argsort(counts[_bucket(h)], kind="stable")][: len(h) - int(np.ceil(threshold * len(h) - 1e-9)) + 1]
                rows.append(np.full(len(first), k))
                keys.append(first)
                # zero stands for a missing one
                low = np.concatenate([np.zeros(4, np.uint64), first & np.uint64(0xFFFFFFFF)])
                before.append(np.stack([low[4 - d : len(low) - d] for d in (1, 2, 3, 4)]))
            if rows:
                at = pa.array(np.concatenate(rows))
                w = np.concatenate(before, axis=1)
                pq = [pa.array(((w[c] << np.uint64(32)) | w[c + 1]).view(np.int64)) for c in (0, 2)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *[b.column(c).take(at) for c in CROSS[1:-2]], *pq], names=CROSS)

    return run


CROSS = ["key", "id", "root", *SIZES, "p", "q"]


def _cross_rows(threshold: float, small: int = 32, block: int = 1 << 20) -> Callable[[Iterator], Iterator]:
    """Rows sorted by key to pairs a, b of different roots in a run of one key whose parities leave the similarity open.

    A pair that shares one of the four keys before has been found there already (or before that).
    """
    import pyarrow as pa

    def near(c: dict, i: np.ndarray, j: np.ndarray, most: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
        n, m = c["n"][i], c["n"][j]
        whole = (n < 0) | (m < 0)
        some = np.flatnonzero((c["root"][i] != c["root"][j]) & (whole | (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9)))
        keep = [np.zeros(0, np.int64)]
        for k in range(0, len(some), most):
            at = some[k : k + most]
            bits = np.bitwise_count(c["w"][i[at]] ^ c["w"][j[at]]).sum(axis=1, dtype=np.int64)
            keep.append(at[whole[at] | (bits * (1 + threshold) <= (1 - threshold) * (n[at] + m[at]) + 1e-6)])
        at = np.concatenate(keep)
        i, j = i[at], j[at]
        low = np.uint64(0xFFFFFFFF)
        before = [[v for k in ("p", "q") for v in (c[k][r].view(np.uint64) >> np.uint64(32), c[k][r].view(np.uint64) & low)] for r in (i, j)]
        ok = np.ones(len(i), bool)
        for v in before[0]:
            for w in before[1]:
                ok &= (v != w) | (v == 0)
        return i[ok], j[ok]

    def found(c: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        key = c["key"]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        few = np.repeat(size <= small, size)
        for d in range(1, small):
            i = np.flatnonzero((key[d:] == key[:-d]) & few[d:])
            if not len(i):
                break
            yield near(c, i, i + d)
        for s, n in zip(start[size > small].tolist(), size[size > small].tolist(), strict=True):
            roots, part = np.unique(c["root"][s : s + n], return_inverse=True)
            if len(roots) < 2:
                continue
            # lines outside the largest component with all others: within it nothing is left to link
            rest = s + np.flatnonzero(part != np.bincount(part).argmax())
            step = max(1, block // n)
            for k in range(0, len(rest), step):
                i = np.repeat(rest[k : k + step], n)
                j = np.tile(np.arange(s, s + n), len(rest[k : k + step]))
                yield near(c, i, j)

    def pairs(c: dict) -> Iterator:
        for i, j in found(c):
            if len(i):
                a, b = c["id"][i], c["id"][j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator) -> Iterator:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            now = {k: b.column(k).fill_null(-1).to_numpy() for k in CROSS if k not in PARITIES}
            now["w"] = np.stack([b.column(k).fill_null(0).to_numpy() for k in PARITIES], axis=1).view(np.uint64)
            held = now if held is None else {k: np.concatenate([held[k], now[k]]) for k in now}
            last = int(np.searchsorted(held["key"], held["key"][-1]))  # where the last run starts, which may go on
            if last:
                yield from pairs({k: v[:last] for k, v in held.items()})
                held = {k: v[last:] for k, v in held.items()}
        if held is not None:
            yield from pairs(held)

    return run


def _pairs_across(large: DataFrame, roots: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs a, b of lines in different components that may be similar, among the lines of bands (rows band, id) that are more than one component."""
    rooted = large.join(roots, "id", "left").select("band", "id", F.coalesce("root", "id").alias("root"))
    open_ = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    lines = written(rooted.join(open_, "band", "left_semi").select("id", "root").distinct().join(sets, "id").select("id", "root", "line", *SIZES))
    counts = np.zeros(BUCKETS, np.int64)
    for bucket, n in lines.select("line").mapInArrow(_count_rows, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # at most BUCKETS rows
        counts[bucket] = n
    keyed = lines.mapInArrow(_prefix_rows(counts, threshold), ", ".join(f"{c} long" for c in CROSS))
    parts = n_partitions(large.sparkSession)
    return keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_cross_rows(threshold), "a long, b long").distinct()


def removed_lines(docs: DataFrame, threshold: float = 0.8, window: int = WINDOW, pivots: int = PIVOTS) -> DataFrame:
    """doc_id, row (the row key), n_lines (with a word), n_removed and removed, the places of the lines to drop, from 0."""
    docs = with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "row")
    return _removed(docs, threshold, window, pivots)


def _removed(rows: DataFrame, threshold: float, window: int, pivots: int) -> DataFrame:
    n = n_partitions(rows.sparkSession)
    lines = written(rows.select("row", "doc_id", "text").mapInArrow(_line_rows, LINES))
    different = lines.where("id is not null").groupBy("id").agg(*[F.first(c).alias(c) for c in BAND_COLUMNS])

    # one word to sort by: the band without its lowest bits (where two bands meet, some more pairs are compared) and some of the further one
    low = (1 << NEXT) - 1
    keys = F.array(*[F.col(c).bitwiseAND(F.lit(~low)).bitwiseOR(F.col(BAND_COLUMNS[(k + 1) % BANDS]).bitwiseAND(F.lit(low))) for k, c in enumerate(BAND_COLUMNS)])
    bands = different.select("id", F.explode(keys).alias("key")).repartition(n, F.shiftright("key", NEXT)).sortWithinPartitions("key")
    near = written(bands.select("key", "id").mapInArrow(_pair_rows(window, pivots), "a long, b long, band long"))
    pairs = written(near.where("band is null").select("a", "b").distinct())
    large = near.where("band is not null").select("band", F.col("a").alias("id"))

    # the text of the lines in any pair, from a document in which they stand
    members = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = lines.join(members, "id", "left_semi").groupBy("id").agg(F.min(F.struct("row", "pos")).alias("at"))
    wanted = wanted.groupBy(F.col("at.row").alias("row")).agg(F.collect_list(F.struct("id", F.col("at.pos").alias("pos"))).alias("want"))
    found = rows.select("row", "text").join(wanted, "row").select("text", "want")
    sets = written(found.mapInArrow(_set_rows, "id long, line string, " + ", ".join(f"{c} long" for c in SIZES)))

    comp = components(written(_similar(pairs, sets, threshold)))
    roots = comp.select(F.col("node").alias("id"), "root")
    across = written(_pairs_across(large, roots, sets, threshold))
    more = written(_similar(across, sets, threshold))
    if not more.isEmpty():
        named = more.join(roots.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b", "left")
        joined = components(named.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
        top = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
        alone = joined.join(roots.select(F.col("id").alias("node")), "node", "left_anti").select(F.col("node").alias("id"), "root")
        roots = roots.join(top, "root", "left").select("id", F.coalesce("top", "root").alias("root")).union(alone)

    # the first place of each component, pre-aggregated by line; all other places of a component go
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "pos")
    by_line = lines.where("id is not null").groupBy("id").agg(F.min(place).alias("at"))
    first = by_line.join(roots, "id", "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("at").alias("at")).select("at.row", "at.doc_id", "at.pos")
    marked = lines.select("row", "doc_id", F.when(F.col("id").isNotNull(), F.col("pos")).alias("pos"), F.lit(None).cast("int").alias("keep")).union(first.select("row", "doc_id", F.lit(None), "pos"))
    each = marked.groupBy("row", "doc_id").agg(F.count("pos").alias("n_lines"), F.collect_list("pos").alias("all"), F.collect_list("keep").alias("keep"))
    removed = F.sort_array(F.array_except("all", "keep"))
    return each.select("row", "doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def dedup(docs: DataFrame, threshold: float = 0.8, window: int = WINDOW, pivots: int = PIVOTS) -> DataFrame:
    """docs with the removed lines cut from text."""
    rows = with_row_key(packed_rows(docs), "row")
    text = F.col("doc").getField("text").cast("string")
    gone = _removed(rows.select("row", F.col("doc").getField("doc_id").cast("long").alias("doc_id"), text.alias("text")), threshold, window, pivots).select("row", "removed")
    kept = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains("removed", i))
    out = rows.join(gone, "row", "left").withColumn("kept", F.when(F.size("removed") > 0, F.array_join(kept, "\n")).otherwise(text))
    return unpacked(out, docs.columns, text=F.col("kept"))
