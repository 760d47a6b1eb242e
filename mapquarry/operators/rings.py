"""Rings and areas of relations from their member lines, by geometry rather than by role."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import GEOMETRY

Pt = tuple[float, float]
Line = list[Pt]


def merge_lines(lines: list[Line]) -> list[Line]:
    """Join lines end to end where exactly two ends meet. A line that is closed already stays as it is."""
    done = [ln for ln in lines if len(ln) > 1 and ln[0] == ln[-1]]
    open_ = [ln for ln in lines if len(ln) > 1 and ln[0] != ln[-1]]
    ends: dict[Pt, list[int]] = defaultdict(list)
    for i, ln in enumerate(open_):
        ends[ln[0]].append(i)
        ends[ln[-1]].append(i)
    used = [False] * len(open_)

    def grow(path: Line) -> Line:
        while path[0] != path[-1] and len(ends[path[-1]]) == 2:
            onward = [i for i in ends[path[-1]] if not used[i]]
            if not onward:
                break
            nxt = open_[onward[0]]
            used[onward[0]] = True
            path = path + (nxt[1:] if nxt[0] == path[-1] else nxt[-2::-1])
        return path

    for i, ln in enumerate(open_):
        if not used[i]:
            used[i] = True
            path = grow(list(ln))
            if path[0] != path[-1]:
                path = grow(path[::-1])[::-1]
            done.append(path)
    return done


def area2(ring: Line) -> float:
    ox, oy = ring[0]
    return sum((x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy) for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False))


def _canonical(ring: Line) -> tuple:
    """The same for equal rings whatever their start and direction."""
    body = ring[:-1]
    k = body.index(min(body))
    there = body[k:] + body[:k]
    back = [there[0], *there[:0:-1]]
    return tuple(min(there, back))


def holds(ring: Line, p: Pt) -> int:
    """1 inside, 0 on the ring, -1 outside."""
    x, y = p
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
        cross = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
        if cross == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return 0
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            inside = not inside
    return 1 if inside else -1


def _contains(outer: Line, inner: Line) -> bool:
    """Whether inner lies in outer, for rings that don't cross; they may touch."""
    for p in inner:
        side = holds(outer, p)
        if side:
            return side > 0
    mids = [((x1 + x2) / 2, (y1 + y2) / 2) for (x1, y1), (x2, y2) in zip(inner, inner[1:], strict=False)]
    for p in mids:
        side = holds(outer, p)
        if side:
            return side > 0
    return False


def _pieces(rings: list[Line]) -> list[tuple[Pt, Pt]]:
    """Pieces that stand an odd number of times, whatever their direction."""
    odd: set[tuple[Pt, Pt]] = set()
    for r in rings:
        for a, b in zip(r, r[1:], strict=False):
            if a != b:
                odd ^= {(min(a, b), max(a, b))}
    return sorted(odd)


def _meetings(pieces: list[tuple[Pt, Pt]]) -> dict[int, list[Pt]]:
    """For each piece the places where others cross it, end on it or lie on it; pieces sorted by west keep the pairs few."""
    side = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    found: dict[int, list[Pt]] = defaultdict(list)
    live: list[int] = []
    for i, (a, b) in enumerate(pieces):  # a is the western end
        live = [j for j in live if pieces[j][1][0] >= a[0]]
        for j in live:
            c, d = pieces[j]
            if max(a[1], b[1]) < min(c[1], d[1]) or min(a[1], b[1]) > max(c[1], d[1]):
                continue
            s1, s2, t1, t2 = side(a, b, c), side(a, b, d), side(c, d, a), side(c, d, b)
            if s1 * s2 < 0 and t1 * t2 < 0:
                f = t1 / (t1 - t2)
                at = (round(a[0] + f * (b[0] - a[0]), 9), round(a[1] + f * (b[1] - a[1]), 9))
                found[i].append(at)
                found[j].append(at)
                continue
            inner = lambda p, q, r: p not in (q, r) and min(q, r) < p < max(q, r)
            for k, zero, end, (p, q) in ((i, s1, c, (a, b)), (i, s2, d, (a, b)), (j, t1, a, (c, d)), (j, t2, b, (c, d))):
                if zero == 0 and inner(end, p, q):
                    found[k].append(end)
        live.append(i)
    return found


def crossing(rings: list[Line]) -> bool:
    """Whether pieces of the rings cross properly, of one ring or of two."""
    pieces = _pieces(rings)
    ends = [set(p) for p in pieces]
    return any(at not in ends[k] for k, places in _meetings(pieces).items() for at in places)


def faces(rings: list[Line]) -> list[list[Line]]:
    """Polygons of the even-odd area of rings that cross: pieces are cut where they meet, and the borders of the inside are walked anew."""
    pieces = _pieces(rings)
    for _ in range(8):  # cutting rounds places, which can make new meetings
        found = _meetings(pieces)
        if not found:
            break
        cut: list[Line] = []
        for k, (a, b) in enumerate(pieces):
            cut.append([a, *sorted(set(found.get(k, ())) - {a, b}), b])
        pieces = _pieces(cut)
    # every piece left parts inside from outside; directed so that the inside is on its left
    onward: dict[Pt, list[Pt]] = defaultdict(list)
    for a, b in pieces:
        x, y = (a[0] + b[0]) / 2, (a[1] + b[1]) / 2
        if a[0] == b[0]:  # upright: count what lies west
            left_inside = sum((p[1] > y) != (q[1] > y) and (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) + p[0] < x for p, q in pieces if (p, q) != (a, b)) % 2 == 1
            a, b = (a, b) if a[1] < b[1] else (b, a)
        else:  # a is west of b, its left is north: count what lies north
            left_inside = sum((p[0] > x) != (q[0] > x) and (q[1] - p[1]) * (x - p[0]) / (q[0] - p[0]) + p[1] > y for p, q in pieces if (p, q) != (a, b)) % 2 == 1
        a, b = (a, b) if left_inside else (b, a)
        onward[a].append(b)
    walked: list[Line] = []
    while onward:
        here = start = next(iter(onward))
        ring, before = [start], None
        while True:
            choices = onward[here]
            if before is None or len(choices) == 1:
                to = choices[0]
            else:  # the first piece clockwise from where the walk came from keeps to one face
                back = math.atan2(before[1] - here[1], before[0] - here[0])
                to = min(choices, key=lambda p: (back - math.atan2(p[1] - here[1], p[0] - here[0])) % (2 * math.pi) or 2 * math.pi)
            choices.remove(to)
            if not choices:
                del onward[here]
            ring.append(to)
            before, here = here, to
            if here == start or here not in onward:
                break
        if ring[0] == ring[-1] and len(ring) >= 4 and area2(ring):
            walked.append(ring)
    shells = [[r] for r in walked if area2(r) > 0]
    for hole in (r for r in walked if area2(r) < 0):
        around = [s for s in shells if _contains(s[0], hole)]
        if around:
            min(around, key=lambda s: area2(s[0])).append(hole)
    return shells


def areas(lines: list[Line]) -> tuple[list[list[Line]], bool]:
    """Polygons (shell counter-clockwise first, holes clockwise) of the even-odd area of all closed rings; whether no rings cross.

    Open rests are dropped. Equal rings cancel in pairs. Shells stand at even depth of containment. Rings
    that cross are repaired: cut where they meet and walked anew.
    """
    rings = [r for r in merge_lines(lines) if len(r) >= 4 and r[0] == r[-1]]
    seen: dict[tuple, Line] = {}
    for r in rings:
        key = _canonical(r)
        if seen.pop(key, None) is None:
            seen[key] = r
    if crossing(list(seen.values())):
        return faces(list(seen.values())), False
    rings = sorted((r for r in seen.values() if area2(r)), key=lambda r: -abs(area2(r)))
    above = [[j for j in range(i) if _contains(rings[j], r)] for i, r in enumerate(rings)]
    shells: dict[int, list[Line]] = {}
    for i, r in enumerate(rings):
        if len(above[i]) % 2 == 0:
            shells[i] = [r if area2(r) > 0 else r[::-1]]
        else:
            parent = max((j for j in above[i] if j in shells), key=lambda j: len(above[j]))
            shells[parent].append(r if area2(r) < 0 else r[::-1])
    return list(shells.values()), True


def relation_geometry(lines: list[Line], linear: bool) -> tuple[dict | None, bool]:
    as_points = lambda r: [{"x": x, "y": y} for x, y in r]
    if linear:
        merged = [ln for ln in merge_lines(lines) if len(ln) > 1]
        if not merged:
            return None, True
        return {"type": "LineString" if len(merged) == 1 else "MultiLineString", "rings": [as_points(r) for r in merged], "part_of": list(range(len(merged)))}, True
    parts, good = areas(lines)
    if not parts:
        return None, good
    kind = "Polygon" if len(parts) == 1 else "MultiPolygon"
    return {"type": kind, "rings": [as_points(r) for p in parts for r in p], "part_of": [k for k, p in enumerate(parts) for _ in p]}, good


def assemble(members: DataFrame) -> DataFrame:
    """id, geometry, is_valid for relations, from rows relation_id, linear, seq, points (plain x, y).

    Members are gathered per relation, whose size the map format bounds; relations are spread over tasks.
    """
    per = members.where(F.size("points") >= 2).groupBy("relation_id", "linear").agg(F.sort_array(F.collect_list(F.struct("seq", "points"))).alias("m"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rid, linear, m in zip(b["relation_id"], b["linear"], b["m"], strict=True):
                lines = [[(p["x"], p["y"]) for p in x["points"]] for x in m]
                geom, good = relation_geometry(lines, bool(linear))
                rows.append((rid, geom, good))
            yield pd.DataFrame(rows, columns=["id", "geometry", "is_valid"])

    return per.mapInPandas(run, f"id long, geometry {GEOMETRY}, is_valid boolean")
