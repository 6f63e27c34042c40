"""What is read out of text: diagnostic sections, parts lists, signal names, signature codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import constants as K


def classify(text: Column, kinds: list[tuple[str, str]] = K.DIAGNOSTIC_KINDS) -> Column:
    """The first kind whose pattern is found, any case, else null."""
    out = None
    for kind, pattern in kinds:
        out = F.when(text.rlike(f"(?i){pattern}"), kind) if out is None else out.when(text.rlike(f"(?i){pattern}"), kind)
    return out


def kind_rank(kind: str = "kind", kinds: list[tuple[str, str]] = K.DIAGNOSTIC_KINDS) -> Column:
    return F.coalesce(F.array_position(F.array(*(F.lit(k) for k, _ in kinds)), F.col(kind)), F.lit(99))


def diagnostics(outlines: DataFrame, docs: DataFrame, top: int = 200) -> DataFrame:
    """(machine, doc, title, section, page, kind, place): outline entries of a kind, by rank, title and page; the first ``top`` of each machine.

    ``outlines`` is (doc, section, page, ord); ``docs`` has one row per id. Unknown documents are dropped.
    """
    rows = outlines.withColumn("kind", classify(F.col("section"))).filter("kind is not null").join(docs.select(F.col("id").alias("doc"), "machine", "title"), "doc")
    w = W.partitionBy("machine").orderBy(kind_rank(), "title", "page", "doc", "ord")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top).select("machine", "doc", "title", "section", "page", "kind", "place")


def parts_rows(pages: DataFrame, text: str = "text") -> DataFrame:
    """(*keys, pos, item, part, description) of every record on pages that have a parts header, are named a parts list, or hold five records.

    With a header the records are read after it. Descriptions lose outer blanks, dots and dashes and need three characters.
    """
    t = F.col(text)
    records = F.regexp_extract_all(t, F.lit(K.PART_RECORD), F.lit(0))
    gate = t.rlike(K.PART_HEADER) | t.rlike(K.PART_LIST_PAGE) | (F.size(records) >= K.PARTS_MIN_RECORDS)
    head = F.regexp_extract(t, r"(?is)^(.*?item\s+part\s*(?:no|number))", 1)
    body = F.substring(t, F.length(head) + 1, F.lit(2**31 - 1))
    keys = [c for c in pages.columns if c != text]
    rows = pages.filter(gate).select(*keys, F.posexplode(F.regexp_extract_all(body, F.lit(K.PART_RECORD), F.lit(0))).alias("pos", "record"))
    got = lambda g: F.regexp_extract("record", r"^([0-9]{1,3}[A-Z]?)\s+(\S+)\s+(.*)$", g)
    return rows.select(*keys, "pos", got(1).alias("item"), got(2).alias("part"), F.regexp_replace(got(3), r"^[ .\-—]+|[ .\-—]+$", "").alias("description")).filter(F.length("description") >= 3)


def distinct_parts(rows: DataFrame, doc: str = "doc", least: int = K.PARTS_MIN_ROWS) -> DataFrame:
    """Per document the first row of each (part, first 40 characters of the description in lower case); documents of fewer than ``least`` raw rows are left out."""
    n = F.count(F.lit(1)).over(W.partitionBy(doc))
    key = F.lower(F.substring("description", 1, 40))
    r = F.row_number().over(W.partitionBy(doc, "part", "_key").orderBy("page", "pos"))
    return rows.withColumn("_n", n).filter(F.col("_n") >= least).withColumn("_key", key).withColumn("_r", r).filter("_r = 1").drop("_n", "_key", "_r")


def part_density(lines: DataFrame, least: int = 5) -> DataFrame:
    """(doc, page, hits) of pages on which ``least`` lines or more hold a part number."""
    return lines.groupBy("doc", "page").agg(F.count_if(F.col("t").rlike(K.PART_NO)).alias("hits")).filter(F.col("hits") >= least)


def normalise_signal(t: Column) -> Column:
    """O and I after a known bus name are the digits 0 and 1."""
    return F.when(t.rlike(K.BUS), F.concat(F.regexp_extract(t, K.BUS, 1), F.translate(F.regexp_extract(t, K.BUS, 2), "OI", "01"))).otherwise(t)


def is_signal(t: Column) -> Column:
    prose = t.isin(K.PROSE_WORDS) & ~t.rlike("[0-9]")
    return t.rlike(K.SIGNAL) & ~t.rlike(K.NOT_SIGNAL) & ~prose


def signal_index(words: DataFrame, least: int = 1, min_conf: float = 60) -> DataFrame:
    """(machine, signal, sheet, n) of words (machine, sheet, t, c): marks around a word are stripped, bus names mended, prose and designators left out."""
    t = normalise_signal(F.regexp_replace("t", r"^[.,;:()\[\]]+|[.,;:()\[\]]+$", ""))
    rows = words.filter(F.col("c") >= min_conf).select("machine", "sheet", t.alias("signal")).filter(is_signal(F.col("signal")))
    counts = rows.groupBy("machine", "signal", "sheet").agg(F.count(F.lit(1)).alias("n"))
    if least <= 1:
        return counts
    return counts.withColumn("_all", F.sum("n").over(W.partitionBy("machine", "signal"))).filter(F.col("_all") >= least).drop("_all")


def is_signature(t: Column) -> Column:
    return t.rlike(K.SIGNATURE) & ~t.rlike(K.NOT_SIGNATURE)


def normalise_part(t: Column) -> Column:
    """74LS and 74S names made whole, O read as 0 after a digit; null if it is no part."""
    u = F.upper(t)
    u = F.when(u.rlike(r"^[A-Z]?[0-9]"), F.translate(u, "O", "0")).otherwise(u)
    p = F.regexp_extract(u, r"^(?:74)?(LS?[0-9]{2,3}|[0-9]{4,5}|82S[0-9]{2,3})", 1)
    return F.when(p == "", None).when(p.startswith("LS"), F.concat(F.lit("74"), p)).otherwise(p)


def diagnostics_by_kind(rows: DataFrame, most: int = K.SHOWN_PER_KIND) -> DataFrame:
    """The first ``most`` rows of ``diagnostics`` of each machine and kind, with ``n``, how many there are; ``nth`` counts from 1."""
    by = W.partitionBy("machine", "kind")
    return rows.withColumns({"nth": F.row_number().over(by.orderBy("place")), "n": F.count(F.lit(1)).over(by)}).filter(F.col("nth") <= most)


def largest_machines(rows: DataFrame, machines: int = K.TOP_MACHINES, kinds: int = K.TOP_KINDS) -> DataFrame:
    """(machine, total, kind, n, place): of the ``machines`` with most sections the ``kinds`` most frequent kinds, ties by name."""
    n = rows.groupBy("machine", "kind").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("machine").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "machine").limit(machines)
    place = F.row_number().over(W.partitionBy("machine").orderBy(F.desc("n"), "kind"))
    n = n.join(F.broadcast(top.withColumnRenamed("machine", "_m")), F.col("machine").eqNullSafe(F.col("_m"))).select("machine", "total", "kind", "n")
    return n.withColumn("place", place).filter(F.col("place") <= kinds)


def parts_report(rows: DataFrame, docs: DataFrame, least: int = K.REPORT_MIN_ROWS, top: int = K.REPORT_TOP) -> DataFrame:
    """(doc, machine, title, rows, pages): the ``top`` documents with most parts rows, of those with ``least`` rows at least. ``docs`` has one row per id."""
    n = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("page").alias("pages")).filter(F.col("rows") >= least)
    best = n.orderBy(F.desc("rows"), "doc").limit(top)
    return best.join(docs.select(F.col("id").alias("doc"), "machine", "title"), "doc", "left").select("doc", "machine", "title", "rows", "pages")


def parts_yield(rows: DataFrame, least: int = K.REPORT_MIN_ROWS) -> DataFrame:
    """(documents, rows): documents with ``least`` parts rows at least, and the rows in them."""
    n = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return n.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def top_signals(index: DataFrame, most: int = K.TOP_SIGNALS) -> DataFrame:
    """(machine, signal, n, sheets, place): the most frequent signals of each machine over all its sheets, ties by name."""
    n = index.groupBy("machine", "signal").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set("sheet")), ",").alias("sheets"))
    return n.withColumn("place", F.row_number().over(W.partitionBy("machine").orderBy(F.desc("n"), "signal"))).filter(F.col("place") <= most)


def unrotate(words: DataFrame, height: str = "height") -> DataFrame:
    """Words read from a page turned by a quarter, at their places on the upright page of that height."""
    return words.withColumns({"x": F.col("y"), "y": F.col(height) - 1 - F.col("x")})


def device_codes(placed: DataFrame) -> DataFrame:
    """(machine, device, codes, sheets): the signature codes found beside each device on any sheet, each once, in order. ``placed`` is (machine, sheet, code, device), unplaced codes among
    them are left out."""
    p = placed.filter(F.col("device") != "(unplaced)")
    return p.groupBy("machine", "device").agg(F.array_sort(F.collect_set("code")).alias("codes"), F.count_distinct("sheet").alias("sheets"))


def mentions(bodies: DataFrame, docs: DataFrame, title: str = r"(?i)signature", text: str = K.SIGNATURE_MENTION, pages: int = K.MENTION_PAGES) -> DataFrame:
    """(machine, id, title): documents that a pattern is found in, in the title or in the blocks of the first pages as stored. ``docs`` has one row per id; unknown bodies are left out."""
    first = F.flatten(F.transform(F.slice("pages", 1, pages), lambda p: F.transform(F.coalesce(p["blocks"], F.array().cast("array<struct<k:string,t:string>>")), lambda b: b["t"])))
    rows = bodies.select("id", F.array_join(F.coalesce(first, F.array().cast("array<string>")), " ").alias("_text")).join(docs.select("id", "machine", "title"), "id")
    return rows.filter(F.coalesce(F.col("title").rlike(title), F.lit(False)) | F.col("_text").rlike(text)).select("machine", "id", "title")
