"""Nearest places by an adaptive quadtree that is made from counts of cells.

Cells halve twice from level to level (16 cells each). A cell that holds more than ``BOUND`` places is open and is replaced
by its cells of the next level; the others are leaves. So dense regions have small leaves and empty ones none, and no
leaf holds more than ``BOUND`` places, but for cells of ``DEEPEST`` level, which are a hand's breadth wide. Points go down
from the whole globe, level by level: of the cells that a point has met, those stay whose box is no farther than the
nearest place that is known from any of them, and open ones are replaced by their cells. Only what is left at the end
meets the places themselves.

Every step is an equi-join by cell. Tables of cells are broadcast while they have at most ``FEW`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.sources import shared

EARTH_KM = 6371.0088
BOUND, STEP, DEEPEST = 64, 2, 28
FEW = 50_000


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def box_km(lon: Column, lat: Column, west: Column, east: Column, south: Column, north: Column) -> Column:
    """Distance from a point to the nearest point of a box that does not cross the date line; 0 inside.

    It is reached straight north or south where the point's meridian crosses the box, else on the western or eastern
    edge, at the point's foot on that meridian if the edge has it, else at an end.
    """

    def edge(at: Column) -> Column:
        foot = F.degrees(F.atan2(F.sin(F.radians(lat)), F.cos(F.radians(lat)) * F.cos(F.radians(at - lon))))
        return F.least(*(haversine_km(lon, lat, at, y) for y in (F.greatest(F.least(foot, north), south), south, north)))

    inside = lon.between(west, east)
    straight = haversine_km(lon, lat, lon, F.greatest(F.least(lat, north), south))
    return F.when(inside, straight).otherwise(F.least(edge(west), edge(east)))


def wrapped(lon: Column) -> Column:
    """The same meridian from -180 to under 180."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def cell(lon: Column, lat: Column, level: Column) -> Column:
    """Number of the cell of a level: level, row and column in one long."""
    n = F.pow(F.lit(2.0), level)
    x = F.least(F.floor((lon + 180) / 360 * n), n - 1).cast("long")
    y = F.greatest(F.least(F.floor((lat + 90) / 180 * n), n - 1), F.lit(0)).cast("long")
    return F.shiftleft(level.cast("long"), 56).bitwiseOR(F.shiftleft(y, 28)).bitwiseOR(x)


def tree(places: DataFrame, place: str, bound: int = BOUND) -> DataFrame:
    """(cell, parent, level, n, open, west, east, south, north, rep_lon, rep_lat): the cells that stand for the places.

    ``places`` has (place, lon, lat), a row for each pair of coordinates. Written.
    """
    levels = F.sequence(F.lit(0), F.lit(DEEPEST), F.lit(STEP))
    each = places.select(place, "lon", "lat", F.explode(levels).alias("level"))
    parent = F.when(F.col("level") > 0, cell(F.col("lon"), F.col("lat"), F.col("level") - STEP))
    one = F.min(F.struct(F.col(place).alias("id"), "lon", "lat")).alias("one")
    cells = each.groupBy(cell(F.col("lon"), F.col("lat"), F.col("level")).alias("cell"), parent.alias("parent"), "level").agg(
        F.count(F.lit(1)).alias("n"), F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("lat").alias("south"), F.max("lat").alias("north"), one,
    )
    cells = shared.kept(cells.withColumn("open", (F.col("n") > bound) & (F.col("level") < DEEPEST)), "quadtree-cells")
    above = cells.where("open").select(F.col("cell").alias("parent"))
    used = cells.where("level = 0").unionByName(cells.where("level > 0").join(above.hint("merge"), "parent", "left_semi").select(*cells.columns))
    return shared.kept(used.select("cell", "parent", "level", "n", "open", "west", "east", "south", "north", F.col("one.lon").alias("rep_lon"), F.col("one.lat").alias("rep_lat")), "quadtree")


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW else df.hint("merge")


def nearest(points: DataFrame, targets: DataFrame, point: str, target: str, bound: int = BOUND) -> DataFrame:
    """(point, target, km): the closest target of each point; ties go to the smaller target.

    Longitudes wrap around. Points without coordinates have no nearest target, nor has any where there are no targets;
    targets without coordinates are left out, and of targets at one place the smallest stands for all. A point that
    occurs twice at one place has one row.
    """
    known = lambda df, name: df.where("lon is not null and lat is not null").select(name, wrapped(F.col("lon").cast("double")).alias("lon"), F.col("lat").cast("double").alias("lat"))
    own = known(targets, target).groupBy("lon", "lat").agg(F.min(target).alias(target))
    cells = tree(own, target, bound)
    # a row per level
    size = {r.level: r["count"] for r in cells.groupBy("level").count().collect()} or {0: 0}
    used = sorted(size)
    at = own.withColumn("level", F.explode(F.array(*map(F.lit, used)))).withColumn("cell", cell(F.col("lon"), F.col("lat"), F.col("level")))
    at = at.join(_sized(cells.where("not open").select("cell"), sum(size.values())), "cell").select("cell", target, F.col("lon").alias("tlon"), F.col("lat").alias("tlat"))
    here = [F.col(c) for c in ("lon", "lat")]
    root = cells.where("level = 0").select("cell", F.lit(0.0).alias("least"), F.lit(float("inf")).alias("known"))
    rows = known(points, point).distinct().crossJoin(F.broadcast(root))
    w = W.partitionBy(point, "lon", "lat")
    for step, level in enumerate(used[1:], 1):
        below = _sized(cells.where(F.col("level") == level).select(F.col("cell").alias("next"), F.col("parent").alias("cell"), "west", "east", "south", "north", "rep_lon", "rep_lat"), size[level])
        # a leaf has no cells below it and stays
        rows = rows.join(below, "cell", "left")
        new = F.col("next").isNotNull()
        least = F.when(new, box_km(*here, F.col("west"), F.col("east"), F.col("south"), F.col("north"))).otherwise(F.col("least"))
        far = F.when(new, haversine_km(*here, F.col("rep_lon"), F.col("rep_lat"))).otherwise(F.col("known"))
        rows = rows.select(point, "lon", "lat", F.coalesce("next", "cell").alias("cell"), least.alias("least"), far.alias("known"))
        # rounding must not drop a place at equal distance
        rows = rows.withColumn("best", F.min("known").over(w)).where(F.col("least") <= F.col("best") * (1 + 1e-9) + 1e-9).drop("best")
        if step % 6 == 0:
            rows = shared.kept(rows, "quadtree-points")
    met = rows.select(point, "lon", "lat", "cell").join(at.hint("merge"), "cell")
    best = F.min(F.struct(haversine_km(*here, F.col("tlon"), F.col("tlat")).alias("km"), F.col(target).alias("__target")))
    return met.groupBy(point, "lon", "lat").agg(best.alias("b")).select(point, F.col("b.__target").alias(target), "b.km")
