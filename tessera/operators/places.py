"""Joins of points and names with a table of places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest_place(points: DataFrame, places: DataFrame, point_id: str, place_id: str, slack: float) -> DataFrame:
    """For each point the place (px, py, r) with the least distance / r among those within ``slack * r``; the first place wins ties.

    Points and places meet by grid cell, so the join is an equi join: a place is listed in the cells
    that its circle touches. The cell is as large as the largest circle.
    """
    cell = places.agg(F.max("r").alias("_w"))  # one row
    spots = places.crossJoin(F.broadcast(cell)).withColumn("_w", F.greatest(F.col("_w") * slack, F.lit(1e-9)))
    at = lambda c, d: F.floor((F.col(c) + F.lit(d) * F.col("r") * slack) / F.col("_w"))
    spots = spots.withColumn("_cx", F.explode(F.sequence(at("px", -1), at("px", 1)))).withColumn("_cy", F.explode(F.sequence(at("py", -1), at("py", 1)))).drop("_w")
    grid = points.crossJoin(F.broadcast(cell)).withColumn("_w", F.greatest(F.col("_w") * slack, F.lit(1e-9)))
    grid = grid.withColumn("_cx", F.floor(F.col("x") / F.col("_w"))).withColumn("_cy", F.floor(F.col("y") / F.col("_w"))).drop("_w")
    distance = F.sqrt((F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py")))
    near = grid.join(spots, ["_cx", "_cy"]).withColumn("_d", distance).filter(F.col("_d") <= F.col("r") * slack)
    return near.groupBy(point_id).agg(F.min_by(place_id, F.struct(F.col("_d") / F.col("r"), F.col(place_id))).alias("place"))


def name_key(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(name, "_", " ")), r"\s+", " "))


def resolve_names(names: DataFrame, places: DataFrame, column: str) -> DataFrame:
    """Left join of names with places (place, name, aliases) under a normalized key; of places that share a key the last wins."""
    keys = places.select("place", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.expr("CAST(array() AS array<string>)")))).alias("_n"))
    known = keys.select(name_key(F.col("_n")).alias("_key"), "place").groupBy("_key").agg(F.max("place").alias("place"))
    return names.withColumn("_key", name_key(F.col(column))).join(known, "_key", "left").drop("_key")
