"""Substring dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from mapquarry.llm import block_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, doc string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in rows], SCHEMA)


def corpus(seed, n=60, vocabulary=400):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé ñ".replace(" ", "")) for _ in range(r.randint(1, 9))) for _ in range(vocabulary)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    passages = [text(r.randint(40, 130)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [text(r.randint(0, 90))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            if r.random() < 0.4:
                w = p.split(" ")
                a = r.randint(0, len(w) // 3)
                p = " ".join(w[a : len(w) - r.randint(0, len(w) // 3)])
            parts += [p, text(r.randint(0, 30))]
        t = r.choice([" ", "\n", "  "]).join(parts)
        if rows and r.random() < 0.25:  # a near copy
            w = r.choice(rows)[1].split(" ")
            w[r.randrange(len(w))] = "zz"
            t = " ".join(w)
        rows.append((i, t))
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 2, ""), (n + 3, None), (n + 4, "a" * 900), (n + 5, "ab " * 300), (n + 6, "ab " * 300), (n + 7, "x\x0by\x0cz " * 60)]
    return rows


def brute_bytes(rows, w=200):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + w] for _, b in data for k in range(len(b) - w + 1))
    out = []
    for i, b in data:
        gone = [False] * len(b)
        for k in range(len(b) - w + 1):
            if seen[b[k : k + w]] > 1:
                gone[k : k + w] = [True] * w
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows, w=50):
    data = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    first = defaultdict(lambda: None)
    for i, x in data:
        if i is None:
            continue
        for k in range(len(x) - w + 1):
            key = tuple(x[k : k + w])
            first[key] = i if first[key] is None else min(first[key], i)
    out = []
    for i, x in data:
        gone = [False] * len(x)
        for k in range(len(x) - w + 1):
            f = first[tuple(x[k : k + w])]
            if f is not None and (i is None or f < i):
                gone[k : k + w] = [True] * w
        kept = b" ".join(a for a, g in zip(x, gone) if not g)
        out.append((i, len(x), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bytes(spark, seed):
    rows = corpus(seed)
    got = suffix_dedup.dedup(frame(spark, rows)).drop("kept_text").collect()
    assert order(got) == order(brute_bytes(rows))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_words(spark, seed):
    rows = corpus(seed)
    got = block_dedup.dedup(frame(spark, rows)).drop("kept_text").collect()
    assert order(got) == order(brute_words(rows))


def test_places_do_not_depend_on_the_chunk():
    import numpy as np

    from mapquarry.llm import repeats

    r = np.random.default_rng(1)
    # hashes whose upper halves agree often: the first of them counts, however long the chunk is
    h = (r.integers(0, 9, 5000, dtype=np.uint64) << np.uint64(32)) | r.integers(0, 2**32, 5000, dtype=np.uint64)
    whole = repeats.least_places(h, 20)
    for a, b in ((0, 50), (100, 900), (17, 4999)):
        assert np.array_equal(repeats.least_places(h[a:b], 20) + a, whole[a : b - 19])
    upper = h >> np.uint64(32)
    assert all(whole[k] == k + int(upper[k : k + 20].argmin()) for k in range(0, 4000, 7))


def test_hot_groups(spark):
    rows = corpus(4)
    assert order(suffix_dedup.dedup(frame(spark, rows), False, hot=2).collect()) == order(brute_bytes(rows))
    assert order(block_dedup.dedup(frame(spark, rows), False, hot=2).collect()) == order(brute_words(rows))


def test_repeated_and_null_ids(spark):
    t = " ".join(f"w{k}" for k in range(90))
    rows = [(None, t), (7, t), (7, t), (3, "q " + t), (None, t), (9, None)]
    assert order(suffix_dedup.dedup(frame(spark, rows)).drop("kept_text").collect()) == order(brute_bytes(rows))
    assert order(block_dedup.dedup(frame(spark, rows)).drop("kept_text").collect()) == order(brute_words(rows))


def test_empty_table(spark):
    assert suffix_dedup.dedup(frame(spark, [])).count() == 0
    assert block_dedup.dedup(frame(spark, [])).count() == 0
