"""Joins with stated cardinality, membership, grids, ranges and places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lookup(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that must be many to one: a right key that occurs twice stops the job when it is met."""
    n = F.count("*").over(W.partitionBy(*keys))
    once = right.withColumn("__n", F.when(n > 1, F.raise_error(F.lit("a lookup key occurs twice")).cast("int")).otherwise(F.lit(1)))
    return left.join(once.where("__n = 1").drop("__n"), keys, "left")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def priority_lookup(left: DataFrame, steps: list[tuple[str, DataFrame, str, str]], out: str) -> DataFrame:
    """First hit of several lookups: (left key, table, its key, its value), best first.

    Where a table repeats a key, its largest value counts.
    """
    found = []
    for k, (left_key, table, key, value) in enumerate(steps):
        one = table.groupBy(F.col(key).alias(f"__k{k}")).agg(F.max(value).alias(f"__v{k}"))
        left = left.join(one, F.col(left_key) == F.col(f"__k{k}"), "left").drop(f"__k{k}")
        found.append(F.col(f"__v{k}"))
    return left.withColumn(out, F.coalesce(*found)).drop(*(f"__v{k}" for k in range(len(steps))))


def grid(units: DataFrame, periods: DataFrame, facts: DataFrame, keys: list[str], zero: list[str]) -> DataFrame:
    """Every unit in every period with its facts; missing values of the columns ``zero`` are true zeros.

    ``periods`` is a calendar, one row per period, so this product is the result itself.
    """
    full = units.crossJoin(F.broadcast(periods)).join(facts.hint("merge"), keys, "left")
    return full.fillna(0, subset=zero) if zero else full


def with_origin(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of key sets with the side that each key is on."""
    a = left.select(*keys).distinct().withColumn("__a", F.lit(True))
    b = right.select(*keys).distinct().withColumn("__b", F.lit(True))
    origin = F.when(F.col("__a").isNull(), "right_only").when(F.col("__b").isNull(), "left_only").otherwise("both")
    return a.join(b, keys, "full").withColumn("origin", origin).drop("__a", "__b")


def attach(left: DataFrame, attributes: DataFrame, key: str) -> DataFrame:
    """Attributes by key: columns on both sides or repeated keys are errors, keys unknown to the left are kept out."""
    if both := (set(left.columns) & set(attributes.columns)) - {key}:
        raise ValueError(f"columns on both sides: {sorted(both)}")
    return lookup(left, attributes, [key])


def edges(areas: DataFrame, ring: str, area: str) -> DataFrame:
    """(area, x1, y1, x2, y2) of closed rings given as arrays of (x, y) structs."""
    e = F.posexplode(F.slice(F.col(ring), F.lit(1), F.size(ring) - 1))
    pairs = areas.select(area, ring, e.alias("__i", "a"))
    b = F.element_at(F.col(ring), F.col("__i") + 2)
    return pairs.select(area, F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))


def cells(low_x: Column, low_y: Column, high_x: Column, high_y: Column, size: float) -> Column:
    """Array of (cx, cy) cells of a square grid that a box touches."""
    xs = F.sequence(F.floor(low_x / size), F.floor(high_x / size))
    ys = F.sequence(F.floor(low_y / size), F.floor(high_y / size))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def points_in_areas(points: DataFrame, polygon_edges: DataFrame, point: str, area: str, cell: float) -> DataFrame:
    """(point, n_inside, n_border, area): areas that hold each point, by ray casting over edges.

    Points meet only the polygons whose bounding box touches their grid cell, and of those only the edges that reach
    into the point's row of cells, so that a large polygon is many keys. A point on an edge counts as border, not inside; ``area`` is set where exactly one polygon holds the point.
    """
    box = polygon_edges.groupBy(area).agg(
        F.min(F.least("x1", "x2")).alias("lx"), F.max(F.greatest("x1", "x2")).alias("hx"), F.min(F.least("y1", "y2")).alias("ly"), F.max(F.greatest("y1", "y2")).alias("hy")
    )
    boxes = box.select(area, "lx", "hx", "ly", "hy", F.explode(cells(F.col("lx"), F.col("ly"), F.col("hx"), F.col("hy"), cell)).alias("c")).select("*", "c.*").drop("c")
    at = points.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    near = at.join(boxes.hint("merge"), ["cx", "cy"]).where("x between lx and hx and y between ly and hy").select(point, "x", "y", "cy", area)
    rows = polygon_edges.withColumn("cy", F.explode(F.sequence(F.floor(F.least("y1", "y2") / cell), F.floor(F.greatest("y1", "y2") / cell))))
    met = near.join(rows.hint("merge"), [area, "cy"])
    cross = (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) - (F.col("y2") - F.col("y1")) * (F.col("x") - F.col("x1"))
    on = (cross == 0) & F.col("x").between(F.least("x1", "x2"), F.greatest("x1", "x2")) & F.col("y").between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    over = (F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))
    ray = over & (F.when(F.col("y2") > F.col("y1"), cross > 0).otherwise(cross < 0))
    by_pair = met.groupBy(point, area).agg((F.count_if(ray) % 2 == 1).alias("odd"), F.bool_or(on).alias("border"))
    inside = F.col("odd") & ~F.col("border")
    hits = by_pair.groupBy(point).agg(F.count_if(inside).alias("n_inside"), F.count_if("border").alias("n_border"), F.min(F.when(inside, F.col(area))).alias("area"))
    out = points.select(point, "x", "y").join(hits, point, "left").fillna(0, subset=["n_inside", "n_border"])
    return out.withColumn("area", F.when((F.col("n_inside") == 1) & (F.col("n_border") == 0), F.col("area")))


def place_status(declared: Column, area: Column, n_inside: Column, n_border: Column, x: Column) -> Column:
    """match, differs, outside, ambiguous or no_coordinates."""
    return F.when(x.isNull(), "no_coordinates").when((n_border > 0) | (n_inside > 1), "ambiguous").when(n_inside == 0, "outside").when(area == declared, "match").otherwise("differs")


PROBLEMS = {"no_coordinates": "has no coordinates", "outside": "lies in no area", "ambiguous": "lies on a border", "differs": "lies in another area than declared"}
RESOLUTIONS = {
    "locate": "in the supply: to be located from a verifiable source before distances are measured",
    "leave_closed": "closed: not in the supply, neither located nor imputed",
    "leave_outside": "open but not in the supply: its coordinates are not used",
}


def resolved(rows: DataFrame) -> DataFrame:
    """``rows`` (problem, in_supply, is_open, ...) with ``resolution`` and ``reason``: the supply first, then what is closed; nothing is imputed."""
    what = F.when(F.col("in_supply"), "locate").when(~F.col("is_open"), "leave_closed").otherwise("leave_outside")
    words = lambda texts, c: F.coalesce(*(F.when(F.col(c) == k, v) for k, v in texts.items()))
    rows = rows.withColumn("resolution", what)
    return rows.withColumn("reason", F.concat_ws("; ", words(PROBLEMS, "problem"), words(RESOLUTIONS, "resolution")))


def overlapping(events: DataFrame, first: Column, last: Column, start: str = "from_day", end: str = "to_day") -> DataFrame:
    """Events that touch the range."""
    return events.where((F.col(start) <= last) & (F.col(end) >= first))


def latest(df: DataFrame, unit: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each unit; ``order`` must settle ties."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*unit).orderBy(*order))).where("__r = 1").drop("__r")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return children.join(parents, children[child_key] == parents[parent_key], "left_anti")
