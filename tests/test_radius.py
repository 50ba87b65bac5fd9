import math
import random

import pytest

from eventloom.operators import matching


def km(a, b):
    la, lb, d = math.radians(a[0]), math.radians(b[0]), math.radians(b[1] - a[1])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(d / 2) ** 2
    return 2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize("radius", [3, 60, 900])
@pytest.mark.parametrize("dense", [4096, 5])
def test_equals_all_pairs_with_most_places_in_one_cell(spark, monkeypatch, radius, dense):
    monkeypatch.setattr(matching, "DENSE_PLACES", dense)
    rng = random.Random(radius)
    places = [(i, 48.0 + rng.random() * 0.2, 11.0 + rng.random() * 0.2) for i in range(450)] + [(450 + i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(30)]
    places += [(500, 90.0, 0.0), (501, -90.0, 7.0), (502, 10.0, 180.0), (503, 10.0, -180.0), (504, 10.0, 179.99), (505, None, 1.0), (506, 89.95, 179.0), (507, 89.95, -90.0), (508, -89.8, 33.0)]
    stops = [(0, 48.1, 11.1), (1, 48.19, 11.01), (2, 47.99, 11.25), (3, 10.0, 179.995), (4, 10.0, -179.995), (5, None, 1.0), (6, 0.0, 0.0), (7, 89.95, 0.0), (8, -90.0, 0.0)]
    s = spark.createDataFrame(stops, "stop_id int, lat double, lng double")
    p = spark.createDataFrame(places, "place int, latitude double, longitude double")
    got = sorted((r.stop_id, r.place) for r in matching.radius_join(s, p, float(radius)).collect())
    assert got == sorted((i, j) for i, *a in stops for j, *b in places if None not in (*a, *b) and km(a, b) <= radius)
