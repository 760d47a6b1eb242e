"""Topics of documents: spherical k-means over random projections of word counts.

Each word of MIN_BYTES and more (shorter ones are mostly function words) adds the bits of its hash:
DIMS of them, as +1 or -1, are a random projection of the document's word counts. From its share the
mean of the document's language is taken, so that topics don't repeat the languages, and the rest is
scaled to length UNIT and rounded. Sums for means and centres run over all documents as whole numbers, so
they don't depend on the order of rows; only the starting centres come from a sample of `sample`
documents, picked by a hash. Words are hashed by numpy in Arrow batches.

Defined cases: documents without such words have the topic ""; null languages are one language; equal
texts of one language have one topic; with fewer different documents than topics some stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .block_dedup import raw, sized_word_hashes
from .common import written
from .repeats import in_chunks

DIMS, MIN_BYTES, UNIT = 16, 5, 10_000


def sketch(texts: list[str | None]) -> np.ndarray:
    """A row for each text: its words, how many of them count, and of how many each of DIMS hash bits is set."""
    out = np.zeros((len(texts), DIMS + 2), dtype=np.int64)
    data = [raw(t) for t in texts]
    for i, j in in_chunks(data, 1 << 20):
        h, size, counts = sized_word_hashes(data[i:j])
        out[i:j, 0] = counts
        owner = np.repeat(np.arange(j - i), counts)[size >= MIN_BYTES]
        h = h[size >= MIN_BYTES]
        n = np.bincount(owner, minlength=j - i)
        out[i:j, 1] = n
        some = np.flatnonzero(n)
        if len(some):
            first = np.searchsorted(owner, some)
            for d in range(DIMS):
                out[i + some, d + 2] = np.add.reduceat(((h >> np.uint64(d)) & np.uint64(1)).view(np.int64), first)
    return out


def sketched(text: Column) -> Column:
    """sketch() of each text as array<long>."""

    @F.pandas_udf("array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(list(sketch(b.tolist())))

    return run(text)


V = [f"_v{d}" for d in range(DIMS)]


def _vectors(df: DataFrame, lang: str) -> DataFrame:
    """df (with the column sketch) with DIMS whole numbers _v0 ... of length UNIT, or nulls."""
    at = lambda k: F.get("sketch", F.lit(k))
    means = df.groupBy(lang).agg(F.sum(at(1)).alias("_n"), *[F.sum(at(d + 2)).alias(f"_m{d}") for d in range(DIMS)])
    means = written(means.select(lang, *[F.try_divide(f"_m{d}", "_n").alias(f"_m{d}") for d in range(DIMS)]))
    out = df.join(means, lang).withColumns({f"_r{d}": F.try_divide(at(d + 2), at(1)) - F.col(f"_m{d}") for d in range(DIMS)})
    out = out.withColumn("_length", F.sqrt(sum((F.col(f"_r{d}") * F.col(f"_r{d}") for d in range(DIMS)), F.lit(0.0))))
    return out.select(*df.columns, *[F.when(F.col("_length") > 0, F.round(F.col(f"_r{d}") * UNIT / F.col("_length")).cast("int")).alias(v) for d, v in enumerate(V)])


def nearest(centres: np.ndarray) -> Column:
    """The number of the centre with the largest inner product (the first among equals)."""
    dots = [sum((F.col(v) * F.lit(float(x)) for v, x in zip(V, c, strict=True)), F.lit(0.0)) for c in centres]
    return F.when(F.col(V[0]).isNotNull(), -F.array_max(F.array(*[F.struct(x.alias("dot"), F.lit(-k).alias("k")) for k, x in enumerate(dots)]))["k"])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def start(sample: np.ndarray, k: int, seed: int = 5, tries: int = 10, rounds: int = 20) -> np.ndarray:
    """Centres of a sample: the best of some runs of k-means that begin with far apart rows."""
    rng = np.random.default_rng(seed)
    x = unit(sample.astype(float))
    best, score = None, -np.inf
    for _ in range(tries):
        picked = [int(rng.integers(len(x)))]
        while len(picked) < k:
            far = np.maximum(1 - (x @ x[picked].T).max(axis=1), 0) + 1e-12
            picked.append(int(rng.choice(len(x), p=far / far.sum())))
        c = x[picked]
        for _ in range(rounds):
            own = (x @ c.T).argmax(axis=1)
            c = np.stack([unit(x[own == j].sum(axis=0)) if (own == j).any() else c[j] for j in range(k)])
        now = float((x @ c.T).max(axis=1).sum())
        if now > score + 1e-9:
            best, score = c, now
    return best


def with_topics(df: DataFrame, name: str, lang: str, n_topics: int = 8, rounds: int = 5, sample: int = 1000) -> DataFrame:
    """df (with the column sketch, read several times) with the topics "t0" ... in column name."""
    columns = df.columns
    df = _vectors(df, lang)
    some = df.where(f"{V[0]} is not null")
    # longer documents first, as short ones are noise
    rows = some.orderBy(F.get("sketch", F.lit(1)) < 50, F.xxhash64(*V), *V).limit(sample).select(*V).collect()
    if not rows:
        return df.select(*columns, F.lit("").alias(name))
    centres = start(np.array(sorted(set(map(tuple, rows)))), n_topics)
    for _ in range(rounds):
        sums = some.groupBy(nearest(centres).alias("k")).agg(*[F.sum(F.col(v).cast("long")) for v in V]).collect()
        new = centres.copy()
        for r in sums:
            new[r[0]] = unit(np.array(r[1:], dtype=float))
        if np.array_equal(new, centres):
            break
        centres = new
    return df.select(*columns, F.coalesce(F.concat(F.lit("t"), nearest(centres).cast("string")), F.lit("")).alias(name))
