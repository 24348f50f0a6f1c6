"""Hard negatives against brute force in Python integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import hard_negatives

SCHEMA = "id long, v array<double>, kind int"


def brute(table, anchor, scale=256, positives=5, negatives=3, window=(50, 95)):
    good = {}
    for key, v, label in table:
        if key is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(scale * x) for x in v])
        good[key] = min(good.get(key, row), row)
    score = lambda a, b: sum(x * y for x, y in zip(good[a][1], good[b][1]))
    out = []
    for a in filter(anchor, good):
        order = sorted((-score(a, b), b) for b in good if b != a)
        for s, p in [x for x in order if good[x[1]][0] == good[a][0]][:positives]:
            inside = [(n, b) for n, b in order if good[b][0] != good[a][0] and window[0] * -s <= 100 * -n <= window[1] * -s]
            out += [(a, p, r, b, -s, -n) for r, (n, b) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def mined(spark, table, schema=SCHEMA, **options):
    df = spark.createDataFrame(table, schema).repartition(3)
    out = hard_negatives.mine(df, "id", "v", "kind", F.col("id") % 4 == 0, **options)
    return sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def clustered(n, dims, groups, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return [(i, (centres[i % groups] + 0.15 * rng.normal(size=dims)).tolist(), int(rng.integers(0, 3))) for i in range(n)]


def test_equals_brute_force_with_many_blocks_runs_and_sets(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 16), ("LEAST_BLOCK", 4), ("RUN_ROWS", (64, 128)), ("SET_ROWS", (10, 40))):
        monkeypatch.setattr(hard_negatives, name, value)
    table = clustered(400, 6, 8)
    assert mined(spark, table) == brute(table, lambda i: i % 4 == 0)


def test_awkward_vectors_ties_repeats_and_one_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 8)
    nan, inf = float("nan"), float("inf")
    table = clustered(60, 3, 4) + [(100 + i, [0.5, 0.5, 0.5], i % 2) for i in range(40)]
    table += [(200, None, 1), (201, [1.0, None, 0.0], 1), (202, [nan, 0.0, 0.0], 1), (204, [inf, 0.0, 0.0], 1), (208, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1)]
    table += [(212, [], 1), (216, [1.0], 1), (217, [0.6, 0.1, 0.2, 0.9], 2), (104, [0.5, 0.5, 0.5], 0), (104, [0.25, 0.5, 0.5], 0), (220, [-1.0, -1.0, -1.0], 9), (221, [1.0, 1.0, 1.0], 9)]
    got = mined(spark, table)
    assert got == brute(table, lambda i: i % 4 == 0) and any(r[0] >= 100 for r in got)


def test_large_components_stay_exact(spark):
    table = [(i, [float(10**8 + i), float(i)], i % 2) for i in range(20)]
    assert mined(spark, table, scale=1, window=(50, 100)) == brute(table, lambda i: i % 4 == 0, scale=1, window=(50, 100))
    assert mined(spark, [*table, (24, [1e300, 0.0], 0)], scale=1, window=(50, 100)) == mined(spark, table, scale=1, window=(50, 100))


def test_empty_tables_no_anchors_and_clashing_columns(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0), (2, [0.9], 1)]) == []
    df = spark.createDataFrame(clustered(40, 3, 4), SCHEMA)
    for name in ("key", "label", "anchor", "run", "set", "block", "curve", "score"):
        df = df.withColumn(name, F.lit("x"))
    out = hard_negatives.mine(df, "id", "v", "kind", F.col("id") % 4 == 0)
    assert out.count() == len(brute(clustered(40, 3, 4), lambda i: i % 4 == 0))


def test_zone_maps_rule_blocks_out_where_vectors_cluster(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "LEAST_BLOCK", 4)
    seen = []
    plain = hard_negatives.wanted
    monkeypatch.setattr(hard_negatives, "wanted", lambda *a: seen.append(plain(*a)) or seen[-1])
    table = [(i, [math.cos(i % 5 + i / 1e4), math.sin(i % 5 + i / 1e4)], i % 5) for i in range(800)]
    assert mined(spark, table) == brute(table, lambda i: i % 4 == 0)
    read = seen[0].select(F.sum(F.length("who") / 8)).first()[0]  # positives: anchor and block pairs
    assert read < 0.25 * 200 * 50


def test_curve_visits_neighbours(spark):
    side = np.stack(np.meshgrid(np.arange(8), np.arange(8)), -1).reshape(-1, 2)
    order = np.array(hard_negatives.hilbert_keys(side, 3))
    walk = side[np.argsort(order)]
    assert len(set(order.tolist())) == 64 and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("bits,dims", [(2, 3), (1, 4)])
def test_curve_visits_neighbours_in_more_dimensions(bits, dims):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    walk = cells[np.argsort(np.array(hard_negatives.hilbert_keys(cells, bits)))]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
