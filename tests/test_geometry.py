import pytest
from pyspark.sql import functions as F

from mapquarry.functions import geometry as G
from mapquarry.operators import rings, selection


@pytest.mark.parametrize(("unit", "want"), [("km", 1568.52272), ("mi", 974.634834), ("nmi", 846.93452), ("m", 1568522.72), ("ft", 5146072), ("in", 61752863)])
def test_haversine(spark, unit, want):
    got = spark.range(1).select(G.distance(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0), unit)).first()[0]
    assert got == pytest.approx(want, rel=1e-7)


def square(x, y, r):
    return [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r), (x - r, y - r)]


def test_hole_whatever_the_role():
    parts, good = rings.areas([square(0, 0, 3), square(0, 0, 1)])
    assert good and len(parts) == 1 and len(parts[0]) == 2
    assert rings.area2(parts[0][0]) > 0 > rings.area2(parts[0][1])


def test_island_in_a_hole():
    parts, _ = rings.areas([square(0, 0, 3), square(0, 0, 2), square(0, 0, 1)])
    assert sorted(len(p) for p in parts) == [1, 2]


def test_split_ring_and_open_rest():
    s = square(10, 0, 1)
    parts, _ = rings.areas([s[:3], s[2:], [(50, 50), (51, 51)]])
    assert len(parts) == 1 and len(parts[0]) == 1


def test_touching_inner_ring():
    parts, good = rings.areas([square(0, 0, 3), [(-3, -3), (0, -1), (-1, 0), (-3, -3)]])
    assert good and [len(p) for p in parts] == [2]


def test_equal_rings_cancel_and_crossing_is_told():
    assert rings.areas([square(0, 0, 1), square(0, 0, 1)[::-1]])[0] == []
    assert rings.areas([square(0, 0, 2), square(2, 2, 2)])[1] is False


def test_merge_stops_at_junctions():
    lines = [[(0, 0), (1, 0)], [(1, 0), (2, 0)], [(1, 0), (1, 1)], [(2, 0), (3, 0)]]
    assert sorted(len(x) for x in rings.merge_lines(lines)) == [2, 2, 3]


def test_way_shapes_and_box(spark):
    pts = [(1, [(0, 0), (4, 0), (4, 4), (0, 0)]), (2, [(0, 0), (1, 1)]), (3, [(0, 0), (1, 1), (2, 0)]), (4, [(0, 0)])]
    df = spark.createDataFrame([(i, [(float(x), float(y)) for x, y in p]) for i, p in pts], f"id long, p array<{G.POINT}>")
    got = {r.id: r for r in df.select("id", G.way_line(F.col("p")).alias("line"), G.way_polygon(F.col("p")).alias("area")).collect()}
    assert got[2].line.type == "LineString" and got[3].line.type == "MultiLineString" and len(got[3].line.rings) == 2 and got[4].line is None
    assert got[1].area.type == "Polygon" and got[2].area is None
    inner = (2.9, 0.9, 3.0, 1.0)  # inside the triangle, touching no side
    assert df.where("id = 1").where(selection.intersects_box(G.way_polygon(F.col("p")), inner)).count() == 1
    assert df.where("id = 1").where(selection.intersects_box(G.way_line(F.col("p")), inner)).count() == 0
    crossed = (1.9, -1.0, 2.1, 1.0)
    assert df.where("id = 1").where(selection.intersects_box(G.way_line(F.col("p")), crossed)).count() == 1
    text = df.where("id = 2").select(G.wkt(G.way_line(F.col("p")))).first()[0]
    assert text == "LINESTRING (0.0 0.0, 1.0 1.0)"


def test_crossing_rings_are_repaired():
    """Sampled places are inside the result exactly where an odd number of rings surrounds them."""
    import random

    def odd(lines, x, y):
        return sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for r in lines for (x1, y1), (x2, y2) in zip(r, r[1:])) % 2 == 1

    bow, good = rings.areas([[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]])
    assert not good and sorted(rings.area2(p[0]) for p in bow) == [2, 2]
    r = random.Random(4)
    for _ in range(60):
        lines = []
        for _ in range(r.randint(1, 3)):
            pts = [(r.random(), r.random()) for _ in range(r.randint(3, 7))]
            lines.append(pts + pts[:1])
        parts, _ = rings.areas(lines)
        assert all(rings.area2(p[0]) > 0 and all(rings.area2(h) < 0 for h in p[1:]) for p in parts)
        for _ in range(40):
            x, y = r.random(), r.random()
            assert sum(odd(p, x, y) for p in parts) == odd(lines, x, y)
