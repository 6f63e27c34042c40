"""The archive's tables and the views that every query starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from ..session import materialize, ship

#: Rows up to which a side may be broadcast; the rows meant here have a bounded width of some 100 bytes.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_or_plain(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is counted to be small, else unchanged, so that the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bounded_rows(df: DataFrame, most: int) -> list[Row]:
    """All rows of a table that is small by its nature (word lists, targets), on the driver. More than ``most`` rows are an error, never cut off."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of at most {most} rows was expected; it has more")
    return rows


def current_rows(df: DataFrame, key: str = "id", at: str = "ingested_at") -> DataFrame:
    """The row with the greatest ``at`` of each ``key``, without moving the wide columns.

    A narrow scan of ``key`` and ``at`` finds the keys that occur more than once and the place (file, row) of
    the row to keep. These keys are few in practice: they are broadcast if they are counted to be small, else joined
    by shuffle. Frames that don't come from files are reduced by one aggregation instead.

    Nulls: rows with a null key are dropped; a null ``at`` is older than any other. Of rows that tie one is kept (the last
    in file order; of frames in memory the one with the greatest content hash). An empty table gives an empty table.
    """
    df = df.filter(F.col(key).isNotNull())
    cols = df.columns
    stamp = F.coalesce(F.col(at).cast("timestamp"), F.lit("0001-01-01").cast("timestamp"))
    if not df.inputFiles():
        every = F.struct(*(F.col(f"`{c}`") for c in cols))
        best = df.groupBy(F.col(key).alias("_k")).agg(F.max_by(every, F.struct(stamp, F.xxhash64(*(F.col(f"`{c}`") for c in cols)))).alias("_r"))
        return best.select(*(F.col("_r").getField(c).alias(c) for c in cols))
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))
    multi = (
        df.select(F.col(key).alias("_k"), F.struct(stamp.alias("s"), place.alias("p")).alias("_b"))
        .groupBy("_k").agg(F.max("_b").alias("_b"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_k", F.col("_b.p").alias("_p"))
    )
    multi = small_or_plain(materialize(multi, "multi"))
    here = df.select("*", place.alias("_here"))
    return here.join(multi, F.col(key) == F.col("_k"), "left").filter(F.col("_p").isNull() | (F.col("_p") == F.col("_here"))).select(*(F.col(f"`{c}`") for c in cols))


def current_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current bodies: (id, pages, outline, meta, ingested_at)."""
    return current_rows(table(spark, sf_dir, "doc_bodies"))


def block_texts(pages: str = "pages", blank: bool = False) -> Column:
    """Texts of all blocks in order of page and block without nulls and, unless ``blank``, without blank ones; never null."""
    texts = F.flatten(F.transform(F.array_sort(F.transform(F.col(pages), lambda p, i: F.struct(p["n"].alias("n"), i.alias("i"), F.transform(F.coalesce(p["blocks"], F.array()), lambda b: b["t"]).alias("t")))), lambda p: p["t"]))
    keep = (lambda t: t.isNotNull()) if blank else (lambda t: t.isNotNull() & not_blank(t))
    return F.coalesce(F.filter(texts, keep), F.array().cast("array<string>"))


def not_blank(t: Column) -> Column:
    """Whether a text has anything but white space, by Unicode's rules."""
    return t.rlike(r"(?U)\S")


def document_machines(docs: DataFrame) -> DataFrame:
    """Distinct (id, machine) of the catalogue, machines in lower case without outer blanks; nulls and blanks left out."""
    m = F.trim(F.lower("machine"))
    return docs.select("id", m.alias("machine")).filter("id is not null and machine is not null and machine <> ''").distinct()


def first_titles(docs: DataFrame) -> DataFrame:
    """(id, title) of the listing with the lowest ``ord`` per id; a null title counts as empty, a null ord as the last."""
    o = F.coalesce(F.col("ord"), F.lit(2**62))
    return docs.filter("id is not null").groupBy("id").agg(F.min_by(F.coalesce("title", F.lit("")), F.struct(o, F.coalesce("title", F.lit("")))).alias("title"))

