import math
import random

from quillon.operators import spatial as S

SCHEMA = "record_id long, lat double, longitude double, range_km double, zulutime int, cell string, level int"


def points(spark, rows):
    return S.usable_points(spark.createDataFrame([(*r, 0, "clash", 1) for r in rows], SCHEMA))


def km(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * S.EARTH_KM * math.asin(math.sqrt(min(1, h)))


def brute(rows):
    ok = [r for r in rows if r[3] is not None and r[3] > 0]
    return {(min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(ok) for b in ok[i + 1 :] if a[0] != b[0] and km(a, b) <= min(a[3], b[3])}


def test_near_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(500):
        base = rng.choice([(0, 0.3), (60, 179.99), (-60, -179.99), (89.99, 20), (-89.999, -100), (45, 10)])
        rows.append((i, max(-90.0, min(90.0, base[0] + rng.gauss(0, 0.02))), (base[1] + rng.gauss(0, 0.5 if abs(base[0]) > 80 else 0.03) + 180) % 360 - 180, rng.choice([0.001, 0.2, 1.0, 3.0, 12.0, 80.0, 2500.0, 0.0, -1.0, None])))
    rows += [(1000, 45.0, 10.0, 20000.0), (1001, -45.0, -170.0, 20100.0), (1002, -44.9, -170.0, 20100.0)]
    got = {tuple(r) for r in S.near_pairs(points(spark, rows)).collect()}
    assert got == brute(rows)
    for rows_sent in (0, 1000):
        assert {tuple(r) for r in S.near_pairs(points(spark, rows), hot_cell=3, broadcast_rows=rows_sent).collect()} == got


def test_usable_and_repeats(spark):
    rows = [(1, 10.0, 200.0, 1.0), (1, 10.0, 200.0, 1.0), (2, 10.0, -160.0, 1.0), (3, 0.0, 0.0, 5.0), (4, 91.0, 0.0, 5.0), (5, None, 0.0, 5.0), (6, 10.0, 361.0, 5.0), (7, float("nan"), 3.0, 5.0), (None, 10.0, -160.0, 1.0), (8, 10.0, -160.0, None)]
    p = points(spark, rows)
    assert {r.id: r.lon for r in p.collect()} == {1: -160.0, 2: -160.0, 8: -160.0}
    assert [tuple(r) for r in S.near_pairs(p).collect()] == [(1, 2)]
    empty = points(spark, [])
    assert S.near_pairs(empty).count() == 0


def test_inside_boundaries_holes_and_date_line(spark):
    regions = spark.createDataFrame(
        [(1, "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"), (2, "POLYGON ((175 0, 185 0, 185 5, 175 5, 175 0))"), (3, "POLYGON ((-185 20, -175 20, -175 25, -185 25))"), (4, None), (5, "garbage")],
        "region_id long, boundary string",
    )
    rows = [(1, 5.0, 5.0), (2, 5.0, 1.0), (3, 5.0, 0.0), (4, 5.0, 4.0), (5, 0.0, 5.0), (6, 10.0, 10.0), (7, 2.0, 179.0), (8, 2.0, -177.0), (9, 22.0, 178.0), (10, 22.0, -179.0), (11, 2.0, 170.0)]
    p = points(spark, [(*r, None) for r in rows])
    found = {tuple(r) for r in S.inside_regions(p, regions).collect()}
    assert found == {(2, 1), (3, 1), (4, 1), (5, 1), (6, 1), (7, 2), (8, 2), (9, 3), (10, 3)}
    assert {tuple(r) for r in S.inside_regions(p, regions, broadcast_rows=0).collect()} == found
    strict = {tuple(r) for r in S.inside_regions(p, regions, boundary_inside=False).collect()}
    assert strict == {(2, 1), (7, 2), (8, 2), (9, 3), (10, 3)}
    assert S.inside_regions(p, regions.limit(0)).count() == 0
