"""Points inside bent polygons, and simpler rings whose shared borders stay shared."""

from __future__ import annotations

import math
import random

from cairn.operators import geo

RINGS = "unit string, rings array<array<struct<x:double,y:double>>>"


def pts(*xy):
    return [{"x": float(x), "y": float(y)} for x, y in xy]


def inside(x, y, rings):
    n = 0
    for r in rings:
        for p, q in zip(r, r[1:] + r[:1], strict=True):
            if (p["y"] > y) != (q["y"] > y) and x < p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / (q["y"] - p["y"]):
                n += 1
    return n % 2 == 1


SHAPES = {
    "square": [pts((0, 0), (2, 0), (2, 2), (0, 2))], "shut": [pts((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))], "c": [pts((0, 0), (10, 0), (10, 1), (1, 1), (1, 9), (10, 9), (10, 10), (0, 10))], "turned c": [pts((0, 0), (0, 10), (1, 10), (1, 1), (9, 1), (9, 10), (10, 10), (10, 0))],
    "hole": [pts((0, 0), (10, 0), (10, 10), (0, 10)), pts((1, 1), (9, 1), (9, 9), (1, 9))], "two parts": [pts((0, 0), (1, 0), (1, 1), (0, 1)), pts((5, 5), (9, 5), (9, 9), (5, 9))], "crescent": [pts(*[(math.cos(a / 10), math.sin(a / 10)) for a in range(8, 56)], *[(0.8 * math.cos(a / 10), 0.8 * math.sin(a / 10)) for a in range(55, 7, -1)])],
}


def test_inner_points(spark):
    got = {r.unit: r for r in geo.inner_points(spark.createDataFrame(list(SHAPES.items()), RINGS)).collect()}
    assert all(inside(got[k].lon, got[k].lat, v) for k, v in SHAPES.items())
    assert (got["square"].lon, got["square"].lat) == (1.0, 1.0)
    flat = spark.createDataFrame([("line", [pts((0, 0), (2, 0))]), ("none", [])], RINGS)
    assert [(r.unit, r.lon, r.lat) for r in geo.inner_points(flat).collect()] == [("line", 1.0, 0.0)]


def grid(n, wiggle, seed):
    """n by n cells whose shared borders wander; one cell has an enclave."""
    rng = random.Random(seed)
    corner = {(i, j): (i * 10.0, j * 10.0) for i in range(n + 1) for j in range(n + 1)}
    side = {}

    def border(a, b):
        if (b, a) in side:
            return side[b, a][::-1]
        if (a, b) not in side:
            (ax, ay), (bx, by) = corner[a], corner[b]
            side[a, b] = [corner[a], *((ax + (bx - ax) * t / 20 + rng.uniform(-wiggle, wiggle), ay + (by - ay) * t / 20 + rng.uniform(-wiggle, wiggle)) for t in range(1, 20)), corner[b]]
        return side[a, b]

    out = []
    for i in range(n):
        for j in range(n):
            ring = []
            for a, b in (((i, j), (i + 1, j)), ((i + 1, j), (i + 1, j + 1)), ((i + 1, j + 1), (i, j + 1)), ((i, j + 1), (i, j))):
                ring += border(a, b)[:-1]
            out.append((f"{i}-{j}", [pts(*ring)]))
    island = [(5 + 2 * math.cos(a / 4), 5 + 2 * math.sin(a / 4)) for a in range(25)]
    out[0][1].append(pts(*island))
    turned = island[7:] + island[:7]
    out.append(("enclave", [pts(*turned[::-1])]))
    return out


def test_simplified_rings_share_borders(spark):
    shapes = grid(3, 0.4, 5)
    df = spark.createDataFrame(shapes, RINGS)
    for tolerance in (0.1, 0.6, 3.0):
        got = {r.unit: [[(p.x, p.y) for p in ring] for ring in r.rings] for r in geo.simplified(df, tolerance).collect()}
        assert got.keys() == {u for u, _ in shapes}
        before, after = (sum(len(r) for rings in s for r in rings) for s in ([x for _, x in shapes], got.values()))
        assert after < before and all(len(r) >= 3 for rings in got.values() for r in rings)
        sides = {}
        for rings in got.values():
            for r in rings:
                for p, q in zip(r, r[1:] + r[:1], strict=True):
                    sides[frozenset((p, q))] = sides.get(frozenset((p, q)), 0) + 1
        outer = lambda p: min(p) == 0.0 or max(p) == 30.0
        # what isn't on the outside belongs to two polygons: no gaps
        rim = [s for s, n in sides.items() if n == 1]
        assert set(sides.values()) == {1, 2} and 12 <= len(rim) <= 12 * 20 and all(any(abs(c) < 1 or abs(c - 30) < 1 for c in p) for s in rim for p in s) and outer((0.0, 1.0))
        # each point that went is near the new border
        for unit, rings in shapes:
            for old, new in zip(rings, got[unit], strict=True):
                lines = list(zip(new, new[1:] + new[:1], strict=True))
                assert max(min(distance((p["x"], p["y"]), a, b) for a, b in lines) for p in old) <= tolerance + 1e-9 or tolerance > 1


def distance(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / ((dx * dx + dy * dy) or 1)))
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)
