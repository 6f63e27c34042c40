"""Boards: bill of materials, placement on a grid, revisions, registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K

MOST_REVISIONS = 1000


def bom(placements: DataFrame, ref: str = "ref", part: str = "part") -> DataFrame:
    """(part, refs, qty): references of each part once, sorted as strings and joined by commas."""
    return placements.select(F.col(part).alias("part"), F.col(ref).alias("ref")).distinct().groupBy("part").agg(F.array_join(F.sort_array(F.collect_list("ref")), ",").alias("refs"), F.count(F.lit(1)).alias("qty"))


def bom_totals(rows: DataFrame, contains: str = "") -> DataFrame:
    """(lines, devices) of the parts whose value or references contain a text, any case."""
    q = contains.lower()
    return rows.filter(F.lower("part").contains(q) | F.lower("refs").contains(q)).agg(F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum("qty"), F.lit(0)).alias("devices"))


def place_on_grid(cells: DataFrame, devices: DataFrame, rows: str, x0: float = 0.0, y0: float = 0.0, col_pitch: float = 1.0, row_pitch: float = 1.0) -> DataFrame:
    """(ref, part, package, x, y) of cells (row, col, part): columns from 1, rows by their place in ``rows``, cells off the grid dropped. Parts without pinout are taken for DIP-14."""
    r = F.instr(F.lit(rows), F.col("row")) - 1
    d = devices.select("part", "pins").distinct()
    c = cells.filter((F.length("row") == 1) & (r >= 0)).join(F.broadcast(d), "part", "left")
    return c.select(F.concat(F.lit("U"), "row", F.col("col").cast("string")).alias("ref"), "part", F.concat(F.lit("DIP-"), F.coalesce("pins", F.lit(14)).cast("string")).alias("package"), (x0 + (F.col("col") - 1) * col_pitch).alias("x"), (y0 + r * row_pitch).alias("y"))


def array_positions(n: DataFrame, pitch: float) -> DataFrame:
    """(name, i, x) of rows of ``count`` equal devices, ``pitch`` apart."""
    return n.filter("count > 0").select("name", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("i")).withColumn("x", F.col("i") * pitch)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and of ``old`` where ``new`` has none of the key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def revise(devices: DataFrame, revisions: DataFrame, overrides: DataFrame) -> DataFrame:
    """(revision, ref, part): every device (ref, primary, alternate) in every revision (revision, late): the alternate if late and there is one; overrides (revision, ref, part) win.

    Revisions are a handful of rows and are broadcast; more than MOST_REVISIONS are refused.
    """
    n = revisions.limit(MOST_REVISIONS + 1).count()
    if n > MOST_REVISIONS:
        raise ValueError(f"more than {MOST_REVISIONS} revisions")
    rows = devices.crossJoin(F.broadcast(revisions)).select("revision", "ref", F.when(F.col("late"), F.coalesce("alternate", "primary")).otherwise(F.col("primary")).alias("part"))
    both = rows.withColumn("_p", F.lit(0)).unionByName(overrides.select("revision", "ref", "part").withColumn("_p", F.lit(1)))
    return both.groupBy("revision", "ref").agg(F.max_by("part", "_p").alias("part"))


def on_grid(ref: Column, rows: str) -> Column:
    """Whether a designator is one letter of the grid's rows and a number."""
    return F.coalesce(ref.rlike(r"^\p{L}[0-9]+$") & (F.instr(F.lit(rows), F.substring(ref, 1, 1)) > 0), F.lit(False))


def place_revisions(devices: DataFrame, revisions: DataFrame, memory: DataFrame, rows: str) -> tuple[DataFrame, DataFrame]:
    """(placed: revision, ref, part; report: revision, placed, off_grid): devices (primary, alternate, part) stand at the alternate designator in late revisions, where there is one;
    those off the grid are counted and left out. Memories (revision, ref, part) on the grid win over devices, others are left out."""
    at = devices.select("primary", "alternate", "part").crossJoin(F.broadcast(revisions))
    at = at.select("revision", F.when(F.col("late"), F.coalesce(F.nullif("alternate", F.lit("")), "primary")).otherwise(F.col("primary")).alias("ref"), "part").withColumn("fits", on_grid(F.col("ref"), rows))
    off = at.groupBy("revision").agg(F.count_if(~F.col("fits")).alias("off_grid"))
    both = at.filter("fits").select("revision", "ref", "part", F.lit(0).alias("_p")).unionByName(memory.filter(on_grid(F.col("ref"), rows)).select("revision", "ref", "part", F.lit(1).alias("_p")))
    placed = both.groupBy("revision", "ref").agg(F.max_by("part", F.struct("_p", "part")).alias("part"))
    return placed, off.join(placed.groupBy("revision").agg(F.count(F.lit(1)).alias("placed")), "revision", "left").select("revision", F.coalesce("placed", F.lit(0)).alias("placed"), "off_grid")


def board_report(cells: DataFrame) -> DataFrame:
    """(board, devices, kinds, most): placed devices (board, ref, part), different parts among them, and the part placed most often, ties by name."""
    n = cells.groupBy("board", "part").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("board").agg(F.sum("n").alias("devices"), F.count(F.lit(1)).alias("kinds"), F.min(F.struct((-F.col("n")).alias("k"), "part")).getField("part").alias("most"))


def sort_bom(rows: DataFrame, column: str = "part", ascending: bool = True) -> DataFrame:
    """A bill of materials in order of part, refs or qty, texts without regard to case; ties by part."""
    if column not in ("part", "refs", "qty"):
        raise ValueError(column)
    c = F.col("qty") if column == "qty" else F.lower(column)
    return rows.orderBy(c.asc() if ascending else c.desc(), "part")


def boards_in_order(boards: DataFrame) -> DataFrame:
    return boards.orderBy("mfr", "name", "slug")


def find_chips(chips: DataFrame, q: str, most: int = K.CHIP_HITS) -> DataFrame:
    """(device, part, section) of a board's chip index that a repairer means by ``q``: a designator that begins with it, or a part or section that contains it, any case; the first ``most``
    by designator. An empty query finds nothing."""
    q = q.strip().lower()
    within = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q))
    hit = F.lower("device").startswith(q) | within("part") | within("section")
    return chips.filter(hit if q else F.lit(False)).select("device", "part", "section").orderBy("device", "part").limit(most)


def find_signals(signals: DataFrame, q: str, most: int = K.SIGNAL_HITS) -> DataFrame:
    """(signal, sheets): signals whose name contains ``q``, any case; the first ``most`` by name, with their sheets."""
    q = q.strip().lower()
    s = signals.filter(F.contains(F.lower("signal"), F.lit(q)) if q else F.lit(False)).groupBy("signal").agg(F.array_join(F.array_sort(F.collect_set("sheet")), ",").alias("sheets"))
    return s.orderBy("signal").limit(most)
