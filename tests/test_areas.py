import random

from pyspark.sql import functions as F

from quarry.operators import areas


def test_points_by_comparing_all(spark):
    rng = random.Random(4)
    size = lambda: rng.choice([0.0, 0.5, 1.0, 2.0, 3.7, 64.0, 1e6, 1e-9])
    boxes = []
    for i in range(150):
        x, y = rng.choice([rng.uniform(-50, 50), float(rng.randint(-4, 4))]), rng.uniform(-5, 5)
        boxes.append((i, x, y, x + size(), y + size()))
    boxes += [(900, 1.0, 1.0, 0.0, 2.0), (901, None, 0.0, 1.0, 1.0), (902, 0.0, 0.0, float("inf"), 1.0), (903, float("nan"), 0.0, 1.0, 1.0)]
    points = [(i, rng.choice([rng.uniform(-60, 60), float(rng.randint(-4, 4))]), rng.uniform(-6, 6)) for i in range(400)]
    points += [(1000 + b[0], b[1], b[4]) for b in boxes[:150]] + [(2000, None, 1.0), (2001, float("nan"), 0.0), (2002, 0.0, float("-inf"))]
    got = areas.points_in(spark.createDataFrame(points, "p long, x double, y double"), spark.createDataFrame(boxes, "a long, x0 double, y0 double, x1 double, y1 double"))
    rows = [(r.p, r.a) for r in got.collect()]
    want = {(p, a) for p, x, y in points[:550] for a, x0, y0, x1, y1 in boxes[:150] if x0 <= x <= x1 and y0 <= y <= y1}
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 1000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_areas_or_points(spark):
    points, boxes = spark.createDataFrame([(1, 0.0, 0.0)], "p long, x double, y double"), spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0)], "a long, x0 double, y0 double, x1 double, y1 double")
    assert areas.points_in(points.limit(0), boxes).count() == areas.points_in(points, boxes.limit(0)).count() == 0
    assert areas.points_in(points, boxes).count() == 1


def test_equal_points_and_areas_meet_once(spark, monkeypatch):
    rng = random.Random(8)
    spots = [(float(rng.randint(0, 9)), rng.randint(0, 40) / 2) for _ in range(30)] + [(0.0, 1.0), (-0.0, 1.0), (None, 1.0), (float("nan"), 2.0)]
    boxes = [(x0, y0, x0 + rng.randint(0, 3), y0 + rng.choice([0.0, 0.5, 7.0])) for x0, y0 in [(float(rng.randint(0, 9)), rng.randint(0, 40) / 2) for _ in range(30)]]
    points = [(i, *s) for i, s in enumerate(spots * 40)]
    many = [(i, *b) for i, b in enumerate(boxes * 50)]
    points_, many_ = spark.createDataFrame(points, "p long, x double, y double"), spark.createDataFrame(many, "a long, x0 double, y0 double, x1 double, y1 double")
    got = areas.counted_in(points_, many_, "a")
    want = {}
    for p, x, y in points:
        held = [a for a, x0, y0, x1, y1 in many if x is not None and x0 <= x <= x1 and y0 <= y <= y1]
        if held:
            want[p] = len(held), min(held)
    rows = got.collect()
    assert len(rows) == len(want) and {r.p: (r.n_areas, r.first_area) for r in rows} == want
    # the join of cells makes rows of differing places and areas only
    made = areas.points_in
    seen = []
    monkeypatch.setattr(areas, "points_in", lambda points, kinds: seen.append((points.count(), kinds.count())) or made(points, kinds))
    areas.counted_in(points_, many_, "a")
    assert seen == [(len({(x, y) for _, x, y in points if x is None or x == x}) + 1, len(set(boxes)))]


def test_innermost_ranges(spark):
    rng = random.Random(5)
    rows = []

    def nest(path, a, b, depth):
        rows.append((path, a, b, f"{path}{a}-{b}"))
        while depth and b - a > 3:
            c = rng.randint(a, b - 1)
            d = rng.randint(c, b)
            nest(path, c, d, depth - 1)
            a = d + 1

    for path in ("f", "g"):
        nest(path, 1, 400, 6)
    places = [(p, x) for p in ("f", "g", "h") for x in range(-1, 403)]
    got = {(r.path, r.position): r.range for r in areas.innermost(spark.createDataFrame(places, "path string, position int"), spark.createDataFrame(rows, "path string, start int, end int, range string"), "path").collect()}
    want = {}
    for p, x in places:
        held = [(-a, b, r) for q, a, b, r in rows if q == p and a <= x <= b]
        if held:
            want[p, x] = min(held)[2]
    assert got == want
    assert areas.innermost(spark.range(0).select(F.lit("f").alias("path"), F.col("id").alias("position")), spark.createDataFrame(rows, "path string, start int, end int, range string"), "path").count() == 0
