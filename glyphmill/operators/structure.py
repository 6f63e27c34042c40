"""Document structure from positioned lines (doc, page, ord, t, x, y, h, c): body height, furniture, headings, outline, blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import constants as K


def body_height(lines: DataFrame) -> DataFrame:
    """(doc, body): exact median height of the lines of 8 to 200 pixels of the whole document."""
    return lines.filter(F.col("h").between(8, 200)).groupBy("doc").agg(F.median("h").alias("body"))


def furniture_key(t: str = "t") -> Column:
    return F.lower(F.trim(F.regexp_replace(t, r"[0-9]+", "")))


def running_headers(lines: DataFrame, share: float = 0.4, least_pages: int = 4, edge: int = 3) -> DataFrame:
    """(doc, key, pages): texts (digits aside, 3 to 60 characters) among the first or last three lines of at least 40 % of the pages of a document of four pages or more."""
    by = W.partitionBy("doc", "page")
    rows = lines.select("doc", "page", furniture_key().alias("key"), F.row_number().over(by.orderBy("ord")).alias("a"), F.row_number().over(by.orderBy(F.desc("ord"))).alias("b"))
    keys = rows.filter((F.col("a") <= edge) | (F.col("b") <= edge)).filter(F.length("key").between(3, 60)).select("doc", "page", "key").distinct()
    n = lines.select("doc", "page").distinct().groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_pages)
    return keys.groupBy("doc", "key").agg(F.count(F.lit(1)).alias("pages")).join(n, "doc").filter(F.col("pages") >= share * F.col("n")).select("doc", "key", "pages")


def looks_like_prose(t: Column) -> Column:
    """No stray glyphs, at least 55 % letters, at most 30 % digits, a word of three letters (of four if it is alone)."""
    size = F.greatest(F.length(t), F.lit(1))
    letters, digits = F.length(F.regexp_replace(t, r"\P{L}", "")), F.length(F.regexp_replace(t, r"[^0-9]", ""))
    words = F.filter(F.split(t, r"[^A-Za-z]+"), lambda w: w != "")
    longest = F.array_max(F.transform(words, lambda w: F.length(w)))
    return ~t.rlike(K.JUNK_CHARS) & (letters / size >= 0.55) & (digits / size <= 0.3) & (F.size(words) > 0) & (longest >= 3) & ((F.size(words) > 1) | (longest >= 4))


def is_subheading(t: Column) -> Column:
    """Short, capitalised, and numbered, or in capitals, or in title case without a full stop inside."""
    words = F.split(F.trim(t), r"\s+")
    letters, upper = F.length(F.regexp_replace(t, r"\P{L}", "")), F.length(F.regexp_replace(t, r"\P{Lu}", ""))
    titled = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    return t.rlike(r"^\p{Lu}|^[0-9]") & t.rlike(r"^\p{Lu}") & (F.size(words) <= 6) & (t.rlike(K.SECTION_NO) | (~t.rlike(r"\.\s+\w") & ((upper > 0.85 * letters) | (titled >= 0.7 * F.size(words)))))


def normalise_heading(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[.\s·]{2,}[0-9]{1,3}\s*$", ""), r"[\s.·—-]+$", ""))


def special_pages(lines: DataFrame) -> DataFrame:
    """(doc, page) of contents pages (named so, or four dot leaders) and parts pages (five part numbers); they give no headings."""
    g = lines.groupBy("doc", "page").agg(F.max(F.col("t").rlike(K.CONTENTS_PAGE)).alias("named"), F.count_if(F.col("t").rlike(r"[.·]{3,}")).alias("leaders"), F.count_if(F.col("t").rlike(K.PART_NO)).alias("parts"))
    return g.filter("named or leaders >= 4 or parts >= 5").select("doc", "page")


def heading_candidates(lines: DataFrame, min_conf: float = 70) -> DataFrame:
    """(doc, page, ord, t, raw, lvl, x, y, h): level 1 from 1.7 body heights, level 2 from 1.28 if shaped like a sub-heading."""
    raw = F.trim("t")
    ok = (~raw.rlike(K.NOISE)) & (~raw.rlike(K.PAGE_NO)) & (~raw.rlike(K.FIGURE)) & (F.col("c") >= min_conf) & F.length(raw).between(4, 80) & ~raw.rlike(K.TOC_ENTRY) & looks_like_prose(raw)
    rows = lines.filter(ok).join(special_pages(lines), ["doc", "page"], "left_anti").join(body_height(lines), "doc")
    n = normalise_heading(raw)
    rows = rows.select("doc", "page", "ord", n.alias("t"), raw.alias("raw"), "x", "y", "h", "body").filter((F.length("t") >= 4) & (F.length("t") - F.length(F.replace("t", F.lit("."), F.lit(""))) <= 4))
    lvl = F.when(F.col("h") >= 1.7 * F.col("body"), 1).when((F.col("h") >= 1.28 * F.col("body")) & is_subheading(F.col("t")), 2)
    return rows.withColumn("lvl", lvl).filter("lvl is not null").select("doc", "page", "ord", "t", "raw", "lvl", "x", "y", "h")


def merge_headings(heads: DataFrame, most: int = 6) -> DataFrame:
    """(doc, page, heads array<(t, lvl, parts)>): lines of one heading joined, the first ``most`` of each page.

    A fold, since each line is compared with the last line's place and height but the first line's left edge. A page's candidates are one array.
    """
    one = F.struct("ord", "t", "lvl", "x", "y", "h")
    rows = heads.groupBy("doc", "page").agg(F.array_sort(F.collect_list(one)).alias("a"))
    kind = "array<struct<t:string,lvl:int,x:int,y:int,h:int,parts:array<string>>>"

    def step(acc: Column, b: Column) -> Column:
        a = F.element_at(acc, -1)
        gap, tall = b["y"] - (a["y"] + a["h"]), F.greatest(a["h"], b["h"])
        joins = (a["lvl"] == b["lvl"]) & (F.abs(a["h"] - b["h"]) <= tall * 0.28) & (F.abs(a["x"] - b["x"]) <= tall * 2.5) & (gap >= -2) & (gap <= a["h"] * 1.1) & (b["t"].rlike(r"^\p{Ll}") | ~b["t"].rlike(K.SECTION_NO))
        alone = F.array(F.struct(b["t"].alias("t"), b["lvl"].cast("int").alias("lvl"), b["x"].cast("int").alias("x"), b["y"].cast("int").alias("y"), b["h"].cast("int").alias("h"), F.array(b["t"]).alias("parts")))
        both = F.array(F.struct(F.trim(F.concat_ws(" ", a["t"], b["t"])).alias("t"), a["lvl"].alias("lvl"), a["x"].alias("x"), b["y"].cast("int").alias("y"), b["h"].cast("int").alias("h"), F.concat(a["parts"], F.array(b["t"])).alias("parts")))
        return F.when((F.size(acc) > 0) & joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), both)).otherwise(F.concat(acc, alone)).cast(kind)

    merged = F.slice(F.aggregate("a", F.array().cast(kind), step), 1, most)
    return rows.select("doc", "page", F.transform(merged, lambda m: F.struct(m["t"].alias("t"), m["lvl"].alias("lvl"), m["parts"].alias("parts"))).alias("heads"))


def outline(merged: DataFrame) -> DataFrame:
    """(doc, p, pos, t, lvl): the first heading of each text (letters and digits only) of a document."""
    rows = merged.select("doc", F.col("page").alias("p"), F.posexplode("heads").alias("pos", "m")).select("doc", "p", "pos", F.col("m.t").alias("t"), F.col("m.lvl").alias("lvl"))
    rows = rows.withColumn("_k", F.regexp_replace(F.lower("t"), "[^a-z0-9]+", "")).filter("_k <> ''")
    return rows.withColumn("_r", F.row_number().over(W.partitionBy("doc", "_k").orderBy("p", "pos"))).filter("_r = 1").drop("_r", "_k")


def join_lines(texts: Column) -> Column:
    """Lines joined by blanks; a line's last hyphen, not a double one, goes before a small letter and joins without blank."""
    def step(acc: Column, t: Column) -> Column:
        hyphen = acc.endswith("-") & ~acc.endswith("--") & t.rlike(r"^\p{Ll}")
        return F.when(acc == "", t).when(hyphen, F.concat(F.substring(acc, F.lit(1), F.length(acc) - 1), t)).otherwise(F.concat(acc, F.lit(" "), t))

    return F.trim(F.regexp_replace(F.aggregate(texts, F.lit(""), step), r"\s+", " "))


def is_table_row(t: str = "t") -> Column:
    """Two or more wide gaps inside a line."""
    return F.regexp_count(t, F.lit(r"\s{3,}")) >= 2


def paragraph_blocks(lines: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """(doc, page, block, k, t): lines grouped into blocks in page order. ``lines`` is read several times.

    A new block begins after a gap of more than 0.9 of the page's upper median height, at a list item or callout, at and after every table row, and around headings. A line that is a
    part of a heading of its page (``merged``, the result of ``merge_headings``) stands for the whole heading, which comes out once per page, at its first line. Blank and noise lines,
    page numbers and running headers are left out and don't count for gaps. k is h, tr, note, li or p.
    """
    by = W.partitionBy("doc", "page")
    upper = F.element_at(F.array_sort(F.collect_list("h")), (F.floor(F.count(F.lit(1)) / 2) + 1).cast("int"))
    med = lines.groupBy("doc", "page").agg(upper.alias("med"))
    t = lines.withColumn("_t", F.trim("t")).filter(~F.col("_t").rlike(K.NOISE) & ~F.col("_t").rlike(K.PAGE_NO)).withColumn("key", furniture_key("_t"))
    t = t.join(running_headers(lines).select("doc", "key"), ["doc", "key"], "left_anti").join(med, ["doc", "page"])
    if merged is not None:
        parts = merged.select("doc", "page", F.posexplode("heads").alias("pos", "m")).select("doc", "page", "pos", F.col("m.t").alias("full"), F.explode("m.parts").alias("_t"))
        t = t.join(parts.groupBy("doc", "page", "_t").agg(F.max_by("full", "pos").alias("_h")), ["doc", "page", "_t"], "left")
    else:
        t = t.withColumn("_h", F.lit(None).cast("string"))
    w = by.orderBy("ord")
    h, row = F.col("_h").isNotNull(), is_table_row()
    gap = F.col("y") - (F.lag("y").over(w) + F.lag("h").over(w))
    starts = F.lag("ord").over(w).isNull() | (gap > 0.9 * F.col("med")) | F.col("_t").rlike(K.BULLET) | F.col("_t").rlike(K.CALLOUT) | h | F.lag(h).over(w) | row | F.lag(row).over(w)
    rows = t.withColumn("_s", starts.cast("int")).withColumn("block", F.sum("_s").over(w)).withColumn("_row", row)
    g = rows.groupBy("doc", "page", "block").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("_t").alias("t")))).alias("a"), F.max("_h").alias("h"), F.max("_row").alias("tr"))
    text = F.coalesce("h", join_lines(F.transform("a", lambda x: x["t"])))
    k = F.when(F.col("h").isNotNull(), "h").when(F.col("tr"), "tr").when(F.col("text").rlike(K.CALLOUT), "note").when(F.element_at("a", 1)["t"].rlike(K.BULLET), "li").otherwise("p")
    out = g.withColumn("text", text).filter("text <> ''").select("doc", "page", "block", k.alias("k"), F.col("text").alias("t"))
    if merged is None:
        return out
    first = F.row_number().over(W.partitionBy("doc", "page", "k", "t").orderBy("block"))
    return out.withColumn("_r", first).filter("k <> 'h' or _r = 1").drop("_r")


def page_texts(bodies: DataFrame) -> DataFrame:
    """(doc, page, text): block texts of each page joined by blanks; pages without blocks have an empty text."""
    p = bodies.select(F.col("id").alias("doc"), F.explode("pages").alias("p"))
    blocks = F.filter(F.transform(F.coalesce("p.blocks", F.array().cast("array<struct<k:string,t:string>>")), lambda b: b["t"]), lambda t: t.isNotNull())
    return p.select("doc", F.col("p.n").alias("page"), F.array_join(blocks, " ").alias("text"))


def find_in_document(pages: DataFrame, q: str) -> DataFrame:
    """(doc, pages, first): documents whose page texts contain a text, any case."""
    return pages.filter(F.contains(F.lower("text"), F.lit(q.lower()))).groupBy("doc").agg(F.count_distinct("page").alias("pages"), F.min("page").alias("first"))


def pretty_title(t: str = "title") -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"(?i)\.pdf$", ""), "_", " "), r"\s+", " "))


def strip_bullet(t: Column) -> Column:
    return F.regexp_replace(t, K.BULLET_MARK, "")


def block_runs(bodies: DataFrame) -> DataFrame:
    """(doc, page, run, k, items): the blocks of each page as they are shown: list items, and table rows, that follow each other are one run, any other block stands alone. Items have no
    bullets. Null kinds count as paragraphs, null texts are left out. Nothing moves between tasks: a page is an array."""
    kind = "array<struct<k:string,items:array<string>>>"
    blocks = F.filter(F.coalesce("p.blocks", F.array().cast("array<struct<k:string,t:string>>")), lambda b: b["t"].isNotNull())

    def step(acc: Column, b: Column) -> Column:
        k = F.when(b["k"].isin("h", "note", "li", "tr"), b["k"]).otherwise(F.lit("p"))
        item = F.array(F.when(k == "li", strip_bullet(b["t"])).otherwise(b["t"]))
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & k.isin("li", "tr") & (last["k"] == k)
        longer = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(k.alias("k"), F.concat(last["items"], item).alias("items"))))
        return F.when(joins, longer).otherwise(F.concat(acc, F.array(F.struct(k.alias("k"), item.alias("items"))))).cast(kind)

    p = bodies.select(F.col("id").alias("doc"), F.explode("pages").alias("p")).select("doc", F.col("p.n").alias("page"), F.posexplode(F.aggregate(blocks, F.array().cast(kind), step)).alias("run", "r"))
    return p.select("doc", "page", "run", F.col("r.k").alias("k"), F.col("r.items").alias("items"))


def highlight(t: Column, q: str) -> Column:
    """A text as HTML with every occurrence of ``q``, any case, marked; queries under two characters mark nothing."""
    import re

    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(mark), F.lit(name))
    return F.regexp_replace(t, f"(?i)({re.escape(q)})", "<mark>$1</mark>") if len(q) >= 2 else t


def contents(bodies: DataFrame, least: int = K.OUTLINE_PAGES) -> DataFrame:
    """(doc, place, label, page, lvl): what a reader is led by: the outline of documents of ``least`` pages or more that have one, else the list of pages."""
    entry = "array<struct<label:string,page:int,lvl:int>>"
    heads = F.transform("outline", lambda o: F.struct(o["t"].alias("label"), o["p"].alias("page"), o["lvl"].alias("lvl"))).cast(entry)
    pages = F.transform("pages", lambda p: F.struct(F.concat(F.lit("Page "), p["n"].cast("string")).alias("label"), p["n"].alias("page"), F.lit(1).alias("lvl"))).cast(entry)
    shown = F.when((F.size("pages") >= least) & (F.size("outline") > 0), heads).otherwise(pages)
    return bodies.select(F.col("id").alias("doc"), F.posexplode(shown).alias("place", "e")).select("doc", "place", "e.label", "e.page", "e.lvl")


def word_counts(pages: DataFrame, text: str = "text") -> DataFrame:
    """Pages with ``words``, the number of parts between white space. A page without text (its recognition ran out of time) has an empty text and none."""
    t = F.coalesce(text, F.lit(""))
    return pages.withColumns({text: t, "words": F.size(F.filter(F.split(t, r"\s+"), lambda x: x != "")).cast("int")})


def needs_structure(bodies: DataFrame, force: bool = False) -> DataFrame:
    """Bodies to read again: those without outline, or with a page without blocks; all with ``force``. Empty outlines and blocks are results, null ones are not."""
    return bodies if force else bodies.filter(F.col("outline").isNull() | F.exists("pages", lambda p: p["blocks"].isNull()))


def body_meta(bodies: DataFrame) -> DataFrame:
    """(id, page_count, words, blocks, sections) counted from each body; null lists and counts are 0."""
    total = lambda f: F.aggregate(F.transform(F.coalesce("pages", F.array().cast(bodies.schema["pages"].dataType)), f), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x.cast("long"), F.lit(0).cast("long")))
    return bodies.select("id", F.greatest(F.size("pages"), F.lit(0)).alias("page_count"), total(lambda p: p["words"]).alias("words"), total(lambda p: F.greatest(F.size(p["blocks"]), F.lit(0))).alias("blocks"), F.greatest(F.size("outline"), F.lit(0)).alias("sections"))
