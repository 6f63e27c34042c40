"""Association by place: nearest designator, nearest part in a window, votes, as-of sections."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions import constants as K


def nearest(points: DataFrame, marks: DataFrame, group: list[str], most: int = K.SIGNATURE_DISTANCE) -> DataFrame:
    """(*group, pid, label, distance): for each point (pid, x, y) the mark (mid, label, x, y) of the same group at the least Manhattan distance up to ``most``, ties to the least mid; '(unplaced)' without one.

    Both sides are cut into square cells of side ``most``; a point meets only the marks of its own and the eight cells around, so the join is an equi-join on cells.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(most + 1))
    p = points.select(*group, "pid", "x", "y")
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    probe = p.withColumn("_a", around).withColumns({"cx": cell("x") + F.col("_a.i"), "cy": cell("y") + F.col("_a.j")}).drop("_a")
    m = marks.select(*group, "mid", "label", F.col("x").alias("mx"), F.col("y").alias("my")).withColumns({"cx": cell("mx"), "cy": cell("my")})
    d = F.abs(F.col("x") - F.col("mx")) + F.abs(F.col("y") - F.col("my"))
    best = probe.join(m, [*group, "cx", "cy"]).withColumn("d", d).filter(F.col("d") <= most).groupBy(*group, "pid").agg(F.min(F.struct("d", "mid", "label")).alias("b"))
    return p.join(best, [*group, "pid"], "left").select(*group, "pid", F.coalesce("b.label", F.lit("(unplaced)")).alias("label"), F.col("b.d").alias("distance"))


def window_nearest(designators: DataFrame, parts: DataFrame, group: list[str], dx: int = K.PART_DX, up: int = K.PART_UP, down: int = K.PART_DOWN) -> DataFrame:
    """(*group, did, desig, part, distance): the nearest part (pid, part, x, y) at most ``dx`` aside, ``up`` above and ``down`` below each designator (did, desig, x, y), ties to the least pid; designators without one are dropped."""
    w, h = dx + 1, max(up, down) + 1
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    a = designators.select(*group, "did", "desig", "x", "y").withColumn("_a", around).withColumns({"cx": F.floor(F.col("x") / w) + F.col("_a.i"), "cy": F.floor(F.col("y") / h) + F.col("_a.j")}).drop("_a")
    b = parts.select(*group, "pid", "part", F.col("x").alias("px"), F.col("y").alias("py")).withColumns({"cx": F.floor(F.col("px") / w), "cy": F.floor(F.col("py") / h)})
    v = F.col("py") - F.col("y")
    hit = a.join(b, [*group, "cx", "cy"]).filter((F.abs(F.col("px") - F.col("x")) <= dx) & v.between(-up, down))
    d = F.abs(F.col("px") - F.col("x")) + F.abs(v)
    return hit.groupBy(*group, "did", "desig").agg(F.min(F.struct(d.alias("d"), "pid", "part")).alias("b")).select(*group, "did", "desig", F.col("b.part").alias("part"), F.col("b.d").alias("distance"))


def majority(readings: DataFrame, key: list[str], value: str = "part", order: str = "ord") -> DataFrame:
    """(*key, value, votes, candidates): the most frequent value per key, ties to the one seen first."""
    n = readings.groupBy(*key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("o"))
    best = n.groupBy(*key).agg(F.max_by(F.struct(value, "n"), F.struct("n", (-F.col("o")).alias("o"))).alias("b"), F.sum("n").alias("candidates"))
    return best.select(*key, F.col(f"b.{value}").alias(value), F.col("b.n").alias("votes"), "candidates")


def asof_section(pages: DataFrame, outline: DataFrame, key: str = "doc") -> DataFrame:
    """(doc, page, section): the last outline entry (doc, ord, section, p) that begins on or before each page; null before the first.

    One union and one running window by document instead of a range join.
    """
    from pyspark.sql import Window as W

    a = pages.select(key, F.col("page").alias("p"), F.lit(1).alias("kind"), F.lit(math.inf).alias("ord"), F.lit(None).cast("string").alias("section"))
    b = outline.select(key, "p", F.lit(0).alias("kind"), F.col("ord").cast("double").alias("ord"), "section")
    w = W.partitionBy(key).orderBy("p", "kind", "ord").rowsBetween(W.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("section", F.last("section", ignorenulls=True).over(w)).filter("kind = 1").select(key, F.col("p").alias("page"), "section")


def strongest(votes: DataFrame, key: list[str], value: str = "part", sheet: str = "sheet") -> DataFrame:
    """(*key, value, votes, sheet): of the winners of ``majority`` on each sheet the one with most votes; only more votes beat an earlier sheet."""
    first = votes.groupBy(*key, "votes").agg(F.min_by(F.struct(value, sheet), sheet).alias("b"))
    return first.groupBy(*key).agg(F.max_by("b", "votes").alias("b"), F.max("votes").alias("votes")).select(*key, F.col(f"b.{value}").alias(value), "votes", F.col(f"b.{sheet}").alias(sheet))
