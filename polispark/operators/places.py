"""Points in areas, without a spatial extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polispark.functions.civic import inside

#: Side of the grid cells on which points and areas meet, in the unit of the coordinates.
CELL = 1.0


def contained(points: DataFrame, areas: DataFrame, cell: float = CELL) -> DataFrame:
    """points (.., x, y) joined with areas (area_id, ring: array of struct x, y) that contain them.

    Areas are cut into the grid cells of their bounding box, points fall into one cell, and both meet by an equi-join on the
    cell; only then is the ring walked. Null coordinates and rings of fewer than three points contain nothing.
    """
    x, y = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    to = lambda c: F.floor(c / cell)
    cells = areas.where(F.size("ring") >= 3).withColumn("_cx", F.explode(F.sequence(to(F.array_min(x)), to(F.array_max(x))))).withColumn("_cy", F.explode(F.sequence(to(F.array_min(y)), to(F.array_max(y)))))
    at = points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).withColumn("_cx", to(F.col("x"))).withColumn("_cy", to(F.col("y")))
    return at.join(cells, ["_cx", "_cy"]).where(inside(F.col("x"), F.col("y"), F.col("ring"))).drop("_cx", "_cy", "ring")
