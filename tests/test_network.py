import random

import pytest
from pyspark.sql import functions as F

from mapquarry.operators import network, simplify
from mapquarry.operators.network import Network


def edges(spark, rows, columns="u long, v long"):
    return spark.createDataFrame(rows, columns).withColumn("id", F.monotonically_increasing_id()).withColumn("seq", F.lit(0))


def test_contraflow(spark):
    rows = [(1, 2, None, None), (3, 4, "yes", None), (5, 6, "yes", "no"), (7, 8, None, "yes"), (9, 10, "-1", None)]
    e = edges(spark, rows, "u long, v long, oneway string, `oneway:bicycle` string")
    got = sorted((r.u, r.v) for r in network.directed_edges(Network(e, None, "cycling")).collect())
    assert got == [(1, 2), (2, 1), (3, 4), (5, 6), (6, 5), (7, 8), (10, 9)]
    assert network.directed_edges(Network(e, None, "walking")).count() == 10
    assert network.directed_edges(Network(e, None, "driving")).count() == 2 + 1 + 1 + 2 + 1


def test_roundabout_and_missing_column(spark):
    e = edges(spark, [(1, 2, "roundabout"), (2, 3, None)], "u long, v long, junction string")
    with pytest.warns(UserWarning):
        assert network.directed_edges(Network(e, None, "driving")).count() == 3


def test_street_count(spark):
    e = edges(spark, [(1, 2), (2, 3), (2, 4)])
    both = network.directed_edges(Network(e, None, "all"))
    assert {r.id: r.street_count for r in network.street_counts(both).collect()} == {1: 1, 2: 3, 3: 1, 4: 1}


def test_endpoints(spark):
    two_way = edges(spark, [(1, 2), (2, 1), (2, 3), (3, 2)])
    assert {r.id: r.is_endpoint for r in network.endpoints(two_way).collect()} == {1: True, 2: False, 3: True}
    one_way = edges(spark, [(1, 2), (2, 3)])
    assert {r.id: r.is_endpoint for r in network.endpoints(one_way).collect()} == {1: True, 2: False, 3: True}
    meet = edges(spark, [(1, 2), (3, 2)])
    assert all(r.is_endpoint for r in network.endpoints(meet).collect())
    differ = edges(spark, [(1, 2, "a"), (2, 3, None), (3, 4, None)], "u long, v long, highway string")
    assert {r.id: r.is_endpoint for r in network.endpoints(differ, ("highway",)).collect()} == {1: True, 2: True, 3: False, 4: True}


def test_strong_components_both_ways(spark):
    r = random.Random(5)
    rows = [(r.randrange(60), r.randrange(60)) for _ in range(75)]
    e = spark.createDataFrame(rows, "u long, v long")
    small = {x.node: x.component for x in network.strong_components(e).collect()}
    reach = {n: {n} for n in small}
    for _ in range(60):
        for u, v in rows:
            reach[u] |= reach[v]
    assert all((small[a] == small[b]) == (a in reach[b] and b in reach[a]) for a in small for b in small)


def test_strong_components_without_the_driver(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (5, 7)], "u long, v long")
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}
    assert {x.node: x.component for x in network.strong_components(e, driver_edges=0).collect()} == want


def chain(spark, rows, **more):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "row_id long, u long, v long, length double, highway string")
    return simplify.simplify(df, **more)[0]


def test_two_way_chain(spark):
    got = chain(spark, [(100, 200, 1.0, "a"), (200, 300, 2.0, "a"), (200, 100, 1.0, "a"), (300, 200, 2.0, "a")])
    assert sorted((r.u, r.v, r.length) for r in got.collect()) == [(100, 300, 3.0), (300, 100, 3.0)]


def test_merged_attributes(spark):
    r = chain(spark, [(1, 2, 1.0, "res"), (2, 3, 1.0, "pri"), (3, 4, 1.0, "res")]).collect()
    assert len(r) == 1 and (r[0].u, r[0].v, r[0].length, r[0].highway_merged) == (1, 4, 3.0, ["res", "pri", "res"])


def test_parallel_rows_survive(spark):
    assert chain(spark, [(1, 2, 1.0, "a"), (2, 1, 1.0, "a"), (1, 2, 2.0, "a"), (2, 1, 2.0, "a")]).count() == 4


def test_ring(spark):
    ring = [(1, 2, 1.0, "a"), (2, 3, 1.0, "a"), (3, 1, 1.0, "a")]
    assert chain(spark, ring).count() == 0
    assert [(r.u, r.v) for r in chain(spark, ring, remove_rings=False).collect()] == [(1, 1)]


def test_loop_to_an_endpoint(spark):
    got = chain(spark, [(4, 1, 1.0, "a"), (1, 2, 1.0, "a"), (2, 3, 1.0, "a"), (3, 1, 1.0, "a")], track_merged=True)
    rows = {(r.u, r.v): [tuple(x) for x in r.merged_edges] for r in got.collect()}
    assert rows == {(4, 1): [(4, 1)], (1, 1): [(1, 2), (2, 3), (3, 1)]}


def test_strong_components_raise_when_rounds_run_out(spark):
    e = spark.createDataFrame([(k, (k + 1) % 6) for k in range(6)], "u long, v long")
    with pytest.raises(RuntimeError, match="rounds"):
        network.strong_components(e, driver_edges=0, max_rounds=2).collect()


def test_of_equal_parts_the_busiest_stays(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, 3), (4, 3), (5, 6)], "u long, v long")
    nodes = spark.createDataFrame([(k,) for k in range(1, 7)], "id long")
    part, kept = network.largest_strong_part(e, nodes)
    assert sorted(r.id for r in part.collect()) == [3, 4] and kept.count() == 3
    none = network.largest_strong_part(e.where("false"), nodes)
    assert none[0].count() == none[1].count() == 0
