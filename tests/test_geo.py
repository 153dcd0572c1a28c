import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessaline.operators import geo


def brute(c, p):
    return {(a[0], b[0]) for a in c for b in p if geo.haversine(a[1], a[2], b[1], b[2]) <= a[3]}


def world(n, seed):
    r = np.random.default_rng(seed)
    lat, lon = r.uniform(-90, 90, n), r.uniform(-180, 180, n)
    lat[: n // 3], lon[: n // 3] = 10.0, 179.9999
    lat[n // 3 : n // 2] = 89.9
    return lat, lon


def test_radius_equals_brute_force_with_hot_spots(spark):
    lat, lon = world(300, 1)
    points = [(f"m{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon, strict=True))]
    qa, qo = world(60, 2)
    centres = [(i, float(a), float(b), float(10 ** (i % 8))) for i, (a, b) in enumerate(zip(qa, qo, strict=True))]
    c = spark.createDataFrame(centres, "request_id bigint, lat double, lon double, radius double")
    p = spark.createDataFrame(points, "memory_id string, lat double, lon double")
    got = {(r.request_id, r.memory_id) for r in geo.within_radius(c, p, "request_id", "memory_id", cell_points=16, cell_centres=8).collect()}
    assert got == brute(centres, points)


def test_empty_sides_and_infinite_radius(spark):
    c = spark.createDataFrame([(1, 0.0, 0.0, float("inf"))], "request_id bigint, lat double, lon double, radius double")
    p = spark.createDataFrame([("a", 0.0, 180.0), ("b", 0.0, 0.0)], "memory_id string, lat double, lon double")
    assert geo.within_radius(c, p.limit(0), "request_id", "memory_id").count() == 0
    assert geo.within_radius(c.limit(0), p, "request_id", "memory_id").count() == 0
    assert {r.memory_id for r in geo.within_radius(c, p, "request_id", "memory_id").collect()} == {"a", "b"}


def test_usable(spark):
    rows = [(1, None, 0.0), (2, float("nan"), 0.0), (3, 91.0, 0.0), (4, 90.0, -180.0), (5, 0.0, float("inf"))]
    df = spark.createDataFrame(rows, "i int, lat double, lon double")
    assert [r.i for r in df.where(geo.usable(df.lat, df.lon)).collect()] == [4]


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 400), st.integers(0, 10_000), st.floats(0.001, 2.0))
def test_local_tree(n, seed, reach):
    r = np.random.default_rng(seed)
    points, centres = r.normal(size=(n, 3)), r.normal(size=(7, 3))
    if n > 10:
        points[: n // 2] = points[0]
    got = {(int(i), int(j)) for a, b in geo.LocalTree(points, 4).near(centres, np.full(7, reach), 50) for i, j in zip(a, b, strict=True)}
    d = ((centres[:, None] - points[None]) ** 2).sum(2) if n else np.zeros((7, 0))
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= reach**2), strict=True)}


def test_regions_equal_ray_casting(spark):
    shape = {"star": [(0.0, 0.0), (10.0, 4.0), (0.0, 8.0), (7.0, 0.0), (7.0, 8.0)], "box": [(2.0, 2.0), (2.0, 6.0), (6.0, 6.0), (6.0, 2.0)]}
    r = np.random.default_rng(3)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(r.uniform(-1, 11, (400, 2)))] + [(900, None, 1.0)]
    df = spark.createDataFrame(pts, "k bigint, lat double, lon double")
    want = set()
    for k, y, x in pts:
        for name, c in shape.items():
            inside = False
            for (a, b), (d, e) in zip(c, [*c[1:], c[0]], strict=True):
                if y is not None and (a <= y < d or d <= y < a) and b + (y - a) / (d - a) * (e - b) > x:
                    inside = not inside
            if inside:
                want.add((k, name))
    assert {(x.k, x.region) for x in geo.in_regions(df, shape, "k").collect()} == want
