"""Places of network nodes (at most 300) on a canvas: (id, label, cluster, x, y [, locked, visible])."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The canvas' centre, the space that a graph may fill, and the circle for nodes without places.
CENTRE, ROOM, CIRCLE = (500.0, 350.0), (760.0, 500.0), (270.0, 230.0)


def normalised(nodes: DataFrame) -> DataFrame:
    """Nodes centred and scaled into the canvas; on a circle, in the order of ids, if one has no place."""
    w = Window.partitionBy()
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    all_placed = F.min((finite("x") & finite("y")).cast("int")).over(w) == 1
    span = lambda c: F.greatest(F.max(c).over(w) - F.min(c).over(w), F.lit(1e-8))
    scale = F.least(F.lit(ROOM[0]) / span("x"), F.lit(ROOM[1]) / span("y"))
    angle = (F.row_number().over(Window.orderBy("id")) - 1) * 2 * np.pi / F.count("*").over(w)
    places = {}
    for k, (c, turn) in enumerate((("x", F.cos(angle)), ("y", F.sin(angle)))):
        middle = (F.max(c).over(w) + F.min(c).over(w)) / 2
        places[c] = F.when(all_placed, CENTRE[k] + (F.col(c) - middle) * scale).otherwise(CENTRE[k] + CIRCLE[k] * turn)
    return nodes.withColumns(places)


def translated(nodes: DataFrame, ids: list[int], dx: float, dy: float) -> DataFrame:
    """Moves the chosen nodes that are not locked."""
    moves = F.col("id").isin(*ids) & ~F.col("locked")
    return nodes.withColumns({c: F.when(moves, F.col(c) + d).otherwise(F.col(c)) for c, d in (("x", dx), ("y", dy))})


def spaced_by_cluster(nodes: DataFrame) -> DataFrame:
    """Each cluster a row, its nodes in the order of x at equal steps; locked nodes stay."""
    everything = Window.partitionBy()
    column = F.row_number().over(Window.partitionBy("cluster").orderBy("x", F.lower("label"), "id")) - 1
    row = F.dense_rank().over(Window.orderBy("cluster")) - 1
    placed = nodes.withColumns({"_col": column, "_row": row, "_n": F.count("*").over(Window.partitionBy("cluster"))})
    placed = placed.withColumns({"_most": F.max("_n").over(everything), "_rows": F.max("_row").over(everything) + 1})
    step = lambda count, most, room: F.when(count > 1, F.least(F.lit(most), room / (count - 1))).otherwise(0.0)
    x = CENTRE[0] + (F.col("_col") - (F.col("_n") - 1) / 2) * step(F.col("_most"), 140.0, 760.0)
    y = CENTRE[1] + (F.col("_row") - (F.col("_rows") - 1) / 2) * step(F.col("_rows"), 145.0, 520.0)
    keep = F.col("locked")
    return placed.withColumns({"x": F.when(keep, F.col("x")).otherwise(x), "y": F.when(keep, F.col("y")).otherwise(y)}).drop("_col", "_row", "_n", "_most", "_rows")


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull, counter-clockwise, by wrapping: at each corner the next is the outermost."""
    points = np.unique(np.asarray(points, float), axis=0)
    if len(points) < 3:
        return points
    corners, at = [], 0  # the least point is a corner
    while True:
        corners.append(at)
        to = points - points[at]
        best = (at + 1) % len(points)
        for k in range(len(points)):
            turn = to[best][0] * to[k][1] - to[best][1] * to[k][0]
            if turn < 0 or turn == 0 and (to[k] ** 2).sum() > (to[best] ** 2).sum():
                best = k
        at = best
        if at == 0 or len(corners) > len(points):
            return points[corners]


def near_hull(point: tuple[float, float], corners: np.ndarray, margin: float) -> bool:
    """Whether a point lies in a hull or at most `margin` from it."""
    if not len(corners):
        return False
    a, b = corners, np.roll(corners, -1, axis=0)
    side, to = b - a, np.asarray(point, float) - a
    along = np.clip((to * side).sum(axis=1) / np.maximum((side**2).sum(axis=1), 1e-300), 0, 1)
    if np.hypot(*(to - along[:, None] * side).T).min() <= margin:
        return True
    return len(corners) > 2 and bool((side[:, 0] * to[:, 1] - side[:, 1] * to[:, 0] >= 0).all())


def clusters_at(nodes: DataFrame, point: tuple[float, float], margin: float = 32) -> DataFrame:
    """cluster and size of the visible clusters whose hull, with a margin, holds the point; large ones first."""

    def one(pdf):
        ok = near_hull(point, hull(pdf[["x", "y"]].to_numpy()), margin)
        return pdf.head(int(ok)).assign(size=len(pdf))[["cluster", "size"]].astype({"size": "int64"})

    kind = nodes.schema["cluster"].dataType.simpleString()
    found = nodes.where("visible").select("cluster", "x", "y").groupBy("cluster").applyInPandas(one, f"cluster {kind}, size long")
    return found.orderBy(F.desc("size"), "cluster")
