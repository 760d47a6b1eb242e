import zlib
from collections import Counter, defaultdict

import pytest
from mapquarry.llm import shard_tree

from .helpers import docs


def places(spark, n, count=4000, weights=None, **more):
    """(region, rack, shard) by id."""
    got = shard_tree.assign(spark.range(count), "id", "s", n, weights, **more)
    return {r.id: (r.s_region, r.s_rack, r.s) for r in got.collect()}


def shards(spark, n, count=4000, weights=None, **more):
    return {k: v[2] for k, v in places(spark, n, count, weights, **more).items()}


def test_contract(spark):
    rows = [(k, f"é{k % 5}") for k in range(500)] + [(3, None), (3, ""), (None, "x"), (None, "x"), (-9, "y" * 10000)]
    got = shard_tree.shard(docs(spark, rows), chunks=3).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    by_id = defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        by_id[r.doc_id].add(r.shard)
        assert r.law == "key" and 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for v in by_id.values())


@pytest.mark.parametrize("n", [1, 7, 40, 41, 45])
def test_one_more_shard_takes_rows_only_into_itself(spark, n):
    a, b = shards(spark, n, base=n), shards(spark, n + 1, base=n)
    moved = [k for k in a if a[k] != b[k]]
    assert moved and all(b[k] == n for k in moved)
    assert len(moved) == pytest.approx(4000 / (n + 1), rel=0.5)
    c = shards(spark, n + 2, base=n)
    assert all(c[k] == n + 1 for k in b if b[k] != c[k])


def test_shares_follow_weights(spark):
    w = {0: 3.0, 5: 0.0, 11: 0.5}
    n = Counter(shards(spark, 12, 12000, w).values())
    unit = 12000 / (12 + 2 - 1 - 0.5)
    assert n[5] == 0 and n[0] == pytest.approx(3 * unit, rel=0.1) and n[11] == pytest.approx(0.5 * unit, rel=0.2) and n[2] == pytest.approx(unit, rel=0.15)


@pytest.mark.parametrize("new", [{13: 3.0}, {13: 0.0}, {13: 0.2}])
def test_a_changed_weight_moves_rows_only_through_its_subtrees(spark, new):
    """Regions of ten shards, racks of five: shard 13 hangs in region 1, rack 2."""
    a, b = places(spark, 40, 8000), places(spark, 40, 8000, new)
    grows = new[13] > 1
    moved = 0
    for k in a:
        (r1, k1, s1), (r2, k2, s2) = a[k], b[k]
        moved += s1 != s2
        if r1 != r2:
            assert (r2 if grows else r1) == 1
        elif k1 != k2:
            assert (k2 if grows else k1) == 2
        elif s1 != s2:
            assert (s2 if grows else s1) == 13
    assert moved > 100
    assert all(a[k] == b[k] for k in a if 1 not in (a[k][0], b[k][0]))


def test_the_tree_decides(spark):
    """Another tree over the same shards and weights puts rows elsewhere, with the same shares."""
    w = {k: 1.0 + k % 3 for k in range(40)}
    trees = [shards(spark, 40, 8000, w), shards(spark, 40, 8000, w, racks=4, shards_per_rack=2), shards(spark, 40, 8000, w, racks=1, shards_per_rack=40)]
    for x in range(3):
        for y in range(x):
            assert sum(trees[x][k] != trees[y][k] for k in trees[x]) > 1000
        n = Counter(trees[x].values())
        for part in range(3):
            assert sum(n[s] for s in range(40) if s % 3 == part) == pytest.approx(8000 * sum(w[s] for s in range(40) if s % 3 == part) / sum(w.values()), rel=0.06)


def test_against_the_same_descent_in_plain_python(spark):
    import math

    from xxhash import xxh64_intdigest

    def long_hash(values):
        seed = 42
        for v in values:
            seed = xxh64_intdigest(v.encode() if isinstance(v, str) else v, seed)
        return seed

    def pick(key, level, weighted):
        draws = []
        for child, w in weighted:
            h = long_hash([key.to_bytes(8, "little", signed=True), level, child.to_bytes(4, "little", signed=True)])
            if w > 0:
                draws.append((-math.log(((h >> 11) + 0.5) * 2.0**-53) / w, child))
        return min(draws)[1]

    w = {3: 2.5, 8: 0.0}
    tree = shard_tree.topology(17, 2, 5, base=16)
    got = shards(spark, 17, 300, w, base=16)
    weigh = lambda rack: sum(w.get(s, 1.0) for s in rack)
    first = [sum(len(r) for r in tree[:k]) for k in range(len(tree))]
    for key, shard in got.items():
        r = pick(key, "region", [(k, sum(map(weigh, x))) for k, x in enumerate(tree)])
        k = pick(key, "rack", [(first[r] + j, weigh(x)) for j, x in enumerate(tree[r])])
        assert shard == pick(key, "shard", [(s, w.get(s, 1.0)) for s in tree[r][k - first[r]]])


def test_empty_table(spark):
    assert shard_tree.shard(docs(spark, [])).count() == 0
