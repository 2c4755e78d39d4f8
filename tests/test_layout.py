"""Node places."""

import numpy as np
from pyspark.sql import functions as F

from quillon.operators import layout

SCHEMA = "id int, label string, cluster int, x double, y double, locked boolean, visible boolean"


def test_hull_and_margin():
    square = np.array([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1), (1, 0)])
    assert sorted(map(tuple, layout.hull(square))) == [(0, 0), (0, 2), (2, 0), (2, 2)]
    assert len(layout.hull(np.array([(1, 1), (1, 1)]))) == 1 and len(layout.hull(np.array([(0, 0), (1, 1), (2, 2)]))) == 2
    corners = layout.hull(square)
    assert layout.near_hull((1, 1), corners, 0) and layout.near_hull((2.5, 1), corners, 0.5) and not layout.near_hull((2.6, 1), corners, 0.5)
    assert layout.near_hull((3, 0), np.array([(0.0, 0.0)]), 3) and not layout.near_hull((1, 1), np.zeros((0, 2)), 9)


def test_places(spark):
    df = spark.createDataFrame([(1, "b", 1, 0.0, 0.0, False, True), (2, "a", 1, 10.0, 0.0, False, True), (3, "c", 2, 0.0, 4.0, True, True), (4, "d", 2, 5.0, 4.0, False, False)], SCHEMA)
    of = lambda d: {r.id: (round(r.x, 6), round(r.y, 6)) for r in d.collect()}
    n = of(layout.normalised(df))
    assert n[1] == (120.0, 198.0) and n[2] == (880.0, 198.0) and n[3] == (120.0, 502.0)
    circle = of(layout.normalised(df.withColumn("x", F.when(F.col("id") > 1, F.col("x")))))
    assert circle[1] == (770.0, 350.0) and circle[3] == (230.0, 350.0)
    assert of(layout.translated(df, [2, 3], 1, 2))[2] == (11.0, 2.0) and of(layout.translated(df, [2, 3], 1, 2))[3] == (0.0, 4.0)
    s = of(layout.spaced_by_cluster(df))
    assert s[1] == (430.0, 277.5) and s[2] == (570.0, 277.5) and s[3] == (0.0, 4.0) and s[4] == (570.0, 422.5)
    assert [r.cluster for r in layout.clusters_at(df, (5, 0), 7).collect()] == [1, 2]
    assert [tuple(r) for r in layout.clusters_at(df, (5, 0), 1).collect()] == [(1, 2)]
