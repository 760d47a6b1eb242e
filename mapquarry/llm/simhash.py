"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into two segments of 32 bits. Two fingerprints that differ in at most 3 bits
differ in at most one bit in one of the segments, so with that bit deleted the segments are equal.
Each distinct fingerprint is indexed under the 32 one-wildcard variants of both segments, variants
are joined by equality (one exchange and a local sort), and the hits are verified on all 64 bits.

A bucket of equal variants emits no pairs: its members are linked inside the task, and at most one
edge for each member leaves it.

Defined cases: null and empty texts have fingerprint zero, linked like any other; with fewer words
than a shingle the whole sequence is hashed; repeated rows and ids share a component; very long texts
are hashed whole; an empty table gives an empty result; the columns kept are packed in a struct, so their
names clash with none of the operator's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, n_partitions, packed_rows, roots, unpacked, with_row_key
from .components import components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BLANK = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
SEGMENT = 32
MASK = (1 << SEGMENT) - 1


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint, unsigned."""
    from xxhash import xxh64_intdigest as h64

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).translate(_BLANK).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return h64(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    h = np.array([h64(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """doc, the columns keep in a struct, and fp, the fingerprint as a signed long."""
    import pyarrow as pa

    rows = packed_rows(docs, keep, text=F.col("text").cast("string"))
    schema = rows.select("doc").schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(fp)], names=["doc", "fp"])

    return rows.mapInArrow(run, schema)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def link(fps: np.ndarray, distance: int = 3, block: int = 1 << 22) -> np.ndarray:
    """For distinct unsigned fingerprints, the place of each one's root under links of at most distance bits.

    Links of one bit are found by sorting with that bit deleted. What they join needs no further
    test inside; only members of different components are then compared, the smaller components
    against all, in blocks.
    """
    n = len(fps)
    if n < 2:
        return np.arange(n)
    if n > 64:
        a, b = [], []
        for bit in range(64):
            key = fps & ~np.uint64(1 << bit)
            order = np.argsort(key, kind="stable")
            same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
            a.append(order[same])
            b.append(order[same + 1])
        label = roots(n, np.concatenate(a), np.concatenate(b))
    else:
        label = np.arange(n)
    while True:
        size = np.bincount(label, minlength=n)
        giant = int(size.argmax())
        rest = np.flatnonzero(label != giant)
        if not len(rest):
            return label
        a, b = [], []
        step = max(1, block // n)
        for k in range(0, len(rest), step):
            x, y = np.nonzero(popcount(fps[rest[k : k + step], None] ^ fps[None, :]) <= distance)
            x = rest[k : k + step][x]
            apart = label[x] != label[y]
            lx, ly = label[x[apart]], label[y[apart]]
            pairs = np.unique(np.stack([np.minimum(lx, ly), np.maximum(lx, ly)], axis=1), axis=0)
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
        return roots(n, np.concatenate(a), np.concatenate(b))[label]


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (key, fp) sorted by key; yields the edges a, b inside each run of equal keys."""

    def edges(key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        cut = np.flatnonzero(np.diff(key)) + 1
        start, stop = np.r_[0, cut], np.r_[cut, len(key)]
        size = stop - start
        a, b = [], []
        two = start[size == 2]
        near = two[popcount(fp[two] ^ fp[two + 1]) <= 3]
        a.append(fp[near])
        b.append(fp[near + 1])
        for s, e in zip(start[size > 2], stop[size > 2], strict=True):
            root = link(fp[s:e])
            moved = np.flatnonzero(root != np.arange(e - s))
            a.append(fp[s:e][root[moved]])
            b.append(fp[s:e][moved])
        return pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})

    held: list[tuple[np.ndarray, np.ndarray]] = []  # the last run, which may go on
    for batch in batches:
        if not len(batch):
            continue
        key, fp = batch["key"].to_numpy(), batch["fp"].to_numpy().view(np.uint64)
        last = int(np.searchsorted(key, key[-1], side="left"))
        if held and held[-1][0][-1] == key[-1] and last == 0:
            held.append((key, fp))
            continue
        k = np.concatenate([*(h[0] for h in held), key[:last]])
        f = np.concatenate([*(h[1] for h in held), fp[:last]])
        if len(k):
            yield edges(k, f)
        held = [(key[last:], fp[last:])]
    if held:
        yield edges(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))


def near_edges(distinct: DataFrame) -> DataFrame:
    """Edges a, b between fingerprints (column fp) of at most 3 differing bits, enough to connect what is linked."""
    spark = distinct.sparkSession
    # bits 0-31 of the key: the segment with one bit deleted; bits 32-36: which bit; bit 37: which segment
    keys = []
    for seg in range(2):
        part = F.shiftrightunsigned("fp", SEGMENT * seg).bitwiseAND(F.lit(MASK))
        keys += [part.bitwiseAND(F.lit(MASK ^ (1 << bit))) + F.lit((seg << 37) + (bit << 32)) for bit in range(SEGMENT)]
    variants = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    return variants.repartition(n_partitions(spark), "key").sortWithinPartitions("key").mapInPandas(_runs, "a long, b long").distinct()


def representatives(docs: DataFrame) -> DataFrame:
    """The first row with the smallest doc_id of each component; null ids come last."""
    rows = with_row_key(packed_rows(docs), "row")
    found = simhash(rows.select("row", F.col("doc").getField("doc_id").alias("doc_id"), F.col("doc").getField("text").alias("text")), ["doc_id", "row"])
    # struct order puts null ids first, so whether the id is null leads
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc.doc_id").isNull().alias("n"), "doc.doc_id", "doc.row")).alias("m")).select(F.col("m.row").alias("row"))
    return unpacked(rows.join(best, "row", "left_semi"), docs.columns)


def simhash(docs: DataFrame, keep: list[str]) -> DataFrame:
    """doc, the columns keep (doc_id among them) in a struct, fp, component_id (the smallest doc_id linked) and root, a fingerprint of the component."""
    df = checkpoint(fingerprints(docs, keep))
    owner = df.groupBy("fp").agg(F.min("doc.doc_id").alias("least"))
    comp = components(near_edges(owner.select("fp"))).select(F.col("node").alias("fp"), F.col("root"))
    least = owner.join(comp, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    by_root = least.groupBy("root").agg(F.min("least").alias("component_id"))
    return df.join(least.join(by_root, "root").select("fp", "component_id", "root"), "fp").select("doc", "fp", "component_id", "root")
