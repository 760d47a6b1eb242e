import random

import numpy as np
import xxhash

from mapquarry.llm import simhash
from mapquarry.llm.components import components

from .helpers import docs, order


def brute_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    """pairs (id, fingerprint) to the smallest id reachable."""
    out = {}
    for i, f in pairs:
        seen, todo = {f}, [f]
        while todo:
            x = todo.pop()
            for _, g in pairs:
                if g not in seen and bin(x ^ g).count("1") <= 3:
                    seen.add(g)
                    todo.append(g)
        out[i] = min(j for j, g in pairs if g in seen)
    return out


def test_fingerprints():
    for t in [None, "", "  ", "One", "one TWO", "a b c d e f", "É é Z z\x0bq\tw", "x y z " * 500]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_documents(spark):
    r = random.Random(3)
    base = [[r.choice("abcdefghijklmnop") * r.randint(1, 3) for _ in range(150)] for _ in range(15)]
    rows = []
    for k in range(120):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "new"
        rows.append((k * 3, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "one"), (903, "one"), (904, rows[0][1]), (905, rows[0][1].upper())]
    got = {x.doc.doc_id: (x.fp & (2**64 - 1), x.component_id) for x in simhash.simhash(docs(spark, rows), ["doc_id"]).collect()}
    want = brute_components([(i, brute_fingerprint(t)) for i, t in rows])
    assert {i: f for i, (f, _) in got.items()} == {i: brute_fingerprint(t) for i, t in rows}
    assert {i: c for i, (_, c) in got.items()} == want


def test_links_of_bits(spark):
    """Chains, dense groups and distances of 1 to 4 bits, over all edges found."""
    r = random.Random(7)
    fps = {0, 2**64 - 1}
    for _ in range(25):
        x = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 8, 90])):
            fps.add(x)
            for _ in range(r.randint(1, 4)):
                x ^= 1 << r.randrange(64)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    comp = {x.node & (2**64 - 1): x.root for x in components(simhash.near_edges(df)).collect()}
    want = brute_components([(f, f) for f in fps])
    groups = lambda m: sorted(sorted(f for f in fps if m.get(f, f) == v) for v in {m.get(f, f) for f in fps})
    assert groups(comp) == groups(want)


def test_link_of_a_large_bucket():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 4, dtype=np.uint64)
    fps = np.unique(np.concatenate([b ^ (np.uint64(1) << r.integers(0, 30, (200, 2)).astype(np.uint64)).sum(axis=1, dtype=np.uint64) for b in base]))
    root = simhash.link(fps)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    reach = near
    for _ in range(8):
        reach = (reach.astype(np.int32) @ reach.astype(np.int32)) > 0
    assert np.array_equal(reach, root[:, None] == root[None, :])


def test_representatives(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (2, "a b c d"), (None, "a b c d"), (8, "q w e r t y"), (None, "z z z"), (9, None), (1, "")]
    got = simhash.representatives(docs(spark, rows))
    assert got.columns == docs(spark, []).columns
    assert order((r.doc_id, r.text) for r in got.collect()) == order([(2, "a b c d"), (8, "q w e r t y"), (None, "z z z"), (1, "")])


def test_empty_table(spark):
    assert simhash.simhash(docs(spark, []), ["doc_id"]).count() == 0
