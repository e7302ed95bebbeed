"""Greedy leaders against the sequential walk."""

import random

import pytest

from lotespark.operators import clustering

BAND = clustering.BAND


def sequential(rows):
    """{id: leader} of (id, group, lat, lng) rows in the order of their ids: each against the leaders so far, by cells."""
    held, out = {}, {}
    for i, g, lat, lng in sorted(rows):
        cx, cy = int(lng // BAND), int(lat // BAND)
        near = [(m, a, b) for x in range(cx - 2, cx + 3) for y in range(cy - 2, cy + 3) for m, a, b in held.get((g, x, y), ()) if abs(a - lat) < BAND and abs(b - lng) < BAND]
        if not near:
            held.setdefault((g, cx, cy), []).append((i, lat, lng))
            near = [(i, lat, lng)]
        out[i] = min(((b - lng) * (b - lng) + (a - lat) * (a - lat), m) for m, a, b in near)[1]
    return out


def led(spark, rows, **how):
    df = spark.createDataFrame(rows, "i long, g int, lat double, lng double").repartition(4)
    return {r.i: r.leader for r in clustering.leaders(df, "i", "i", ["g"], **how).collect()}


def test_long_streets_in_few_rounds(spark, monkeypatch):
    rounds = []
    stored = clustering.stored
    monkeypatch.setattr(clustering, "stored", lambda df, name: rounds.append(name) or stored(df, name))
    street = [(k, 1, -15.6, -56.2 + k * 4e-5) for k in range(10_000)]
    diagonal = [(20_000 - k, 2, -15.6 + k * 4e-5, -56.2 + k * 4e-5) for k in range(4_000)]
    rows = street + diagonal
    assert led(spark, rows) == sequential(rows)
    assert rounds.count("walked") <= 10


@pytest.mark.parametrize("tile", [1, 3, 2048])
def test_dense_places(spark, tile):
    rng = random.Random(tile)
    rows = [(k, k % 2, round(rng.uniform(0, 6e-4), 7), round(rng.uniform(0, 6e-4), 7)) for k in range(3000)]
    rows += [(5000 + k, 0, 3e-4 + rng.uniform(0, 5e-5), 3e-4) for k in range(3000)]  # a full place
    rng.shuffle(rows)
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    assert led(spark, rows, tile=tile) == sequential(rows)
