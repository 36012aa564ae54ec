"""Density clustering of points in a plane."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut


def labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, c): the smallest id that (a, b) edges, given in both directions, lead to; rounds of neighbours' minimum and a
    pointer jump."""
    now = nodes.select("id", F.col("id").alias("c"))
    while True:
        low = edges.join(now.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("_m"))
        step = now.join(low, "id", "left").select("id", F.col("c").alias("_was"), F.least("c", "_m").alias("_c"))
        up = step.select(F.col("id").alias("_k"), F.col("_c").alias("_up"))
        step = cut(step.join(up, F.col("_c") == F.col("_k")).select("id", "_was", F.least("_c", "_up").alias("c")))
        now = step.select("id", "c")
        if step.where("c <> _was").isEmpty():
            return now


def neighbours(left: DataFrame, right: DataFrame, eps: float) -> DataFrame:
    """Rows of left (_x, _y, cx, cy and more) with each point of right (x, y, cx, cy and more) within eps in one of the 24 cells
    around their own; those of their own cell are within eps anyway and make no rows."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if i or j])
    a = left.withColumn("_s", F.explode(steps)).withColumn("cx", F.col("cx") + F.col("_s.i")).withColumn("cy", F.col("cy") + F.col("_s.j")).drop("_s")
    dx, dy = F.col("_x") - F.col("x"), F.col("_y") - F.col("y")
    return a.join(right, ["cx", "cy"]).where(dx * dx + dy * dy <= eps * eps)


def dbscan(points: DataFrame, eps: float, least: int) -> DataFrame:
    """(id, n_near, core, cluster) of points (id, x, y) with distinct ids: n_near counts points within eps, the point
    itself included; a cluster is named by its smallest core id; a border point takes the smallest of its core
    neighbours' clusters, noise has null.

    Points meet by an equi-join on grid cells of side eps / sqrt 2. Points of one cell are within eps of each other, so they are
    counted and not paired, and all core points of a cell are in one cluster: the rounds run over occupied cells, not over
    points. Pairs of points in different cells are counted or reduced to pairs of cells at once and never written."""
    side = eps / math.sqrt(2)
    p = cut(points.select("id", "x", "y", F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy")))
    in_cell = p.groupBy("cx", "cy").agg(F.count("*").alias("_in"))
    as_left = lambda rows: rows.withColumnsRenamed({"x": "_x", "y": "_y"})
    outside = neighbours(as_left(p), p.select("x", "y", "cx", "cy"), eps).groupBy("id").agg(F.count("*").alias("_out"))
    counts = cut(p.join(in_cell, ["cx", "cy"]).join(outside, "id", "left").withColumn("n_near", F.col("_in") + F.coalesce("_out", F.lit(0))).drop("_in", "_out"))
    cores = counts.where(F.col("n_near") >= least).drop("n_near")
    cells = cores.groupBy("cx", "cy").agg(F.min("id").alias("cell"))
    cores = cut(cores.join(cells, ["cx", "cy"]))
    edges = neighbours(as_left(cores.select("x", "y", "cx", "cy", F.col("cell").alias("a"))), cores.select("x", "y", "cx", "cy", F.col("cell").alias("b")), eps).select("a", "b").distinct()
    found = cut(labels(cut(edges), cells.select(F.col("cell").alias("id"))).select(F.col("id").alias("cell"), F.col("c").alias("cluster")))
    named = cores.join(found, "cell").select("id", "x", "y", "cx", "cy", "cluster")
    rest = counts.where(F.col("n_near") < least)
    beside = neighbours(as_left(rest), named.select("x", "y", "cx", "cy", "cluster"), eps).select("id", "cluster")
    inside = rest.join(cells, ["cx", "cy"]).join(found, "cell").select("id", "cluster")
    border = beside.unionByName(inside).groupBy("id").agg(F.min("cluster").alias("_b"))
    out = counts.select("id", "n_near").join(named.select("id", "cluster"), "id", "left").join(border, "id", "left")
    out = out.select("id", "n_near", F.col("cluster").isNotNull().alias("core"), F.coalesce("cluster", "_b").alias("cluster"))
    return points.select("id").join(out, "id", "left").select("id", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("core", F.lit(False)).alias("core"), "cluster")
