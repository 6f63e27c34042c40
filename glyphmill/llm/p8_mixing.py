"""Problem 8: a selection of documents in which each source has its target share of all tokens.

Poisson replication: each document is used as often as the inverse of a Poisson distribution says at its own hash-seeded number
in (0, 1); the distribution's mean is set so that, cut off at the source's greatest allowed repetition, it averages the rate the source needs. The numbers
are the documents' places in hash order, weighted by tokens, so that the share comes out to within a few documents even for a small source. Copies are
then put into one global random order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..session import materialize
from ..sources.tables import table
from .p7_tokens import encode

BUCKETS = 4096  # ranges of hash order per source, so that a source with most rows is no single group


def source_name(c="source"):
    """Spellings of one source made equal: lower case, no outer blanks, '-' for '_'."""
    return F.regexp_replace(F.lower(F.trim(c)), "_", "-")


def current_targets(targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats): the row of the latest ``set_at`` of each source; of ties the greatest share, then cap. A source whose latest row
    has no share, or no use allowed, has no target, whatever older rows say."""
    t = targets.filter("source is not null").select(source_name().alias("source"), F.struct("set_at", "target_share", "max_repeats").alias("r"))
    return t.groupBy("source").agg(F.max("r").alias("r")).select("source", "r.target_share", "r.max_repeats").filter("target_share > 0 and max_repeats >= 1")


def poisson_mean(rate: float, cap: int) -> float:
    """The mean m for which min(Poisson(m), cap) averages ``rate``; infinite if ``rate`` reaches the cap."""
    if rate <= 0:
        return 0.0
    if rate >= cap * (1 - 1e-9):
        return math.inf

    def average(m: float) -> float:
        p, below, total = math.exp(-m), 0.0, 0.0
        for k in range(cap):
            total, below, p = total + k * p, below + p, p * m / (k + 1)
        return total + cap * (1 - below)

    low, high = 0.0, 1.0
    while average(high) < rate and high < 700:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if average(mid) < rate else (low, mid)
    return high


def steps(rate: float, cap: int) -> list[float]:
    """Where the repetition count steps up: the distribution's values below 1, .., ``cap``; the count of u is the number of steps u has reached."""
    m = poisson_mean(rate, cap)
    if math.isinf(m):
        return [0.0] * cap
    out, p, below = [], math.exp(-m), 0.0
    for k in range(cap):
        below, p = below + p, p * m / (k + 1)
        out.append(below)
    return out


def plan_rates(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, tuple[float, int, float]]:
    """(rate, cap, share aimed at) per source that has tokens. Shares are scaled to sum to 1 over those sources. Without ``total`` the largest total is
    taken for which every source keeps its share within its cap; with it, sources that can't reach theirs stop at the cap."""
    there = {s: v for s, v in targets.items() if sizes.get(s, 0) > 0}
    whole = sum(v[0] for v in there.values())
    if not whole:
        return {}
    aim = {s: v[0] / whole for s, v in there.items()}
    most = total if total is not None else min(sizes[s] * there[s][1] / aim[s] for s in there)
    return {s: (min(there[s][1], aim[s] * most / sizes[s]), there[s][1], aim[s]) for s in there}


def mix_sources(docs: DataFrame, targets: DataFrame, seed: int = 42, total: float | None = None, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(selection, shares) of ``docs`` (key, source, n_tokens), read twice.

    selection: (doc_id, source, copy_no from 1, n_tokens, place), ``place`` a random 64-bit number by which it is ordered, spread over the cluster by range.
    shares: one row per current target: target_share, aimed_share (scaled to sources that have documents), actual_share, tokens, documents, copies, max_repeats.
    Rows with a null source, of a source without target, with a null key, or without tokens are in none. Equal rows are used each. ``targets`` is a small
    table; what comes to the driver is one row per source.
    """
    goal = {r.source: (r.target_share, r.max_repeats) for r in current_targets(targets).collect()}
    d = docs.select(F.col(key).alias("doc_id"), source_name().alias("source"), F.col("n_tokens").cast("long").alias("n_tokens")).filter(F.col("doc_id").isNotNull() & (F.col("n_tokens") > 0) & F.col("source").isin(list(goal)))
    u = F.xxhash64("doc_id", F.lit(seed))
    d = materialize(d.select("*", u.alias("u"), F.shiftrightunsigned(u, 52).cast("int").alias("bucket")), "sized")
    buckets = d.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    sizes = {r.source: r.n for r in buckets.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    rates = plan_rates(sizes, goal, total)
    spark = d.sparkSession
    rows = [(s, steps(r, cap), float(sizes[s])) for s, (r, cap, _) in rates.items()]
    plan = F.broadcast(spark.createDataFrame(rows, "source string, steps array<double>, size double"))
    in_order = W.partitionBy("source").orderBy("bucket")  # at most BUCKETS rows per source
    before = buckets.withColumn("before", F.coalesce(F.sum("n").over(in_order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = W.partitionBy("source", "bucket").orderBy("u", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    at = (F.col("before") + F.sum("n_tokens").over(within) - F.col("n_tokens") / 2) / F.col("size")
    placed = d.join(before, ["source", "bucket"]).join(plan, "source").select("doc_id", "source", "n_tokens", at.alias("at"), "steps")
    placed = placed.withColumn("count", F.size(F.filter("steps", lambda s: s <= F.col("at"))))
    copies = placed.filter("count > 0").select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("copy_no"))
    selection = copies.select("doc_id", "source", "copy_no", "n_tokens", F.xxhash64("doc_id", "copy_no", F.lit(seed + 1)).alias("place"))
    per = selection.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("copies"))
    aims = spark.createDataFrame([(s, t[0], t[1], rates.get(s, (0.0, 0, 0.0))[2]) for s, t in goal.items()] or [], "source string, target_share double, max_repeats int, aimed_share double")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    shares = aims.join(per, "source", "left").select("source", "target_share", "aimed_share", (zero("tokens") / F.sum(zero("tokens")).over(W.partitionBy(F.lit(1)))).alias("actual_share"), zero("tokens").alias("tokens"), zero("documents").alias("documents"), zero("copies").alias("copies"), "max_repeats")
    return selection.repartitionByRange("place").sortWithinPartitions("place"), shares


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sized = encode(table(spark, sf_dir, "documents").filter("source is not null"), keys=["doc_id", "source"], only_count=True)
    return mix_sources(sized, table(spark, sf_dir, "mix_targets"))


def p8_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


QUERIES = {"p8_selection": p8_selection, "p8_shares": p8_shares}
SQL: dict[str, str] = {}
