"""Problem 3: lines that come back in many documents of one machine, and bodies without them.

Every block is normalised to its letters and hashed; distinct documents are counted per machine and hash. A line printed with one misread letter or letter pair
has another hash, but keeps its first or its last half, so it meets the line as it was meant (a hash that several documents share) on one of two keys made of a half and
the length, and a distance of at most two edits joins them. Lines whose documents reach the threshold, a share of the machine's documents, are joined back to the blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialize
from ..sources.tables import current_bodies, document_machines, small_or_plain, table

WIDTH = 8  # lengths of one class: a half is counted from the least length of its class, so that both prints of a line cut it alike


def _halves(letters, length) -> tuple:
    """The keys of the first and the last half of ``letters``, cut as for a line of ``length`` letters. The halves are so long that one misread letter or letter pair can't be in both."""
    least = F.floor(length / WIDTH) * WIDTH
    half = F.floor((least - 1) / 2).cast("int")
    return F.xxhash64(F.left(letters, half), least), F.xxhash64(F.right(letters, half), least, F.lit(1))


def block_lines(bodies: DataFrame, long_words: int = 6) -> DataFrame:
    """(id, page, pg, block_no, full, letters, h, n, p, s, p2, s2) of all blocks but headings that have ``long_words`` words of four letters, or one fewer (a misread
    letter may have cost one; ``full`` tells). ``page`` is pages.n, ``pg`` the place of the page, ``h`` the hash of the letters, ``n`` their number, ``p`` and ``s`` the
    keys of the halves; a line near the end of its class of lengths has those of the next class too, else null. Null pages, blocks and texts give nothing."""
    pages = bodies.select("id", F.posexplode("pages").alias("pg", "p"))
    blocks = pages.select("id", F.col("p.n").alias("page"), "pg", F.posexplode("p.blocks").alias("block_no", "b")).select("id", "page", "pg", "block_no", F.col("b.k").alias("k"), F.col("b.t").alias("t"))
    words = F.regexp_count("t", F.lit(r"\p{L}{4,}"))
    blocks = blocks.filter("t is not null and (k is null or k <> 'h')").select("id", "page", "pg", "block_no", "t", words.alias("w")).filter(F.col("w") >= long_words - 1)
    letters = F.regexp_replace(F.lower("t"), r"[^\p{L}]+", "")
    rows = blocks.select("id", "page", "pg", "block_no", (F.col("w") >= long_words).alias("full"), letters.alias("letters"))
    n = F.length("letters")
    other = F.when(F.floor((n - 2) / WIDTH) != F.floor(n / WIDTH), n - 2).when(F.floor((n + 2) / WIDTH) != F.floor(n / WIDTH), n + 2)
    (p, s), (p2, s2) = _halves("letters", n), _halves("letters", other)
    return rows.select("*", F.xxhash64("letters").alias("h"), n.alias("n"), p.alias("p"), s.alias("s"), F.when(other.isNotNull(), p2).alias("p2"), F.when(other.isNotNull(), s2).alias("s2"))


def frequent_lines(lines: DataFrame, machines: DataFrame, min_docs: int = 5, min_share: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(lines, forms): the lines (machine, to, docs, share) that stand in at least ``min_docs`` documents of a machine and in at least the share ``min_share`` of its
    documents, ``to`` the hash of the line as meant; and all printed forms (machine, h) of such lines.

    ``lines`` is the result of ``block_lines`` as a table (it is read several times), ``machines`` the distinct (id, machine). A document of two machines counts for
    both. The line as it was meant must be printed clean in two documents at least. No list of documents is gathered for any line.
    """
    keys = ("p", "s", "p2", "s2")
    of = lines.select("id", "h", "n", "full", *keys).join(machines, "id")
    seen = materialize(of.groupBy("machine", "h", "id").agg(*(F.first(c).alias(c) for c in ("n", *keys)), F.max("full").alias("full")), "seen")
    forms = seen.groupBy("machine", "h").agg(F.count(F.lit(1)).alias("docs"), *(F.first(c).alias(c) for c in ("n", *keys)), F.max("full").alias("full"))
    forms = materialize(forms, "forms")
    meant = forms.filter("docs >= 2 and full")
    m = meant.select("machine", F.explode(F.array("p", "s")).alias("key"), F.col("h").alias("to"), F.col("n").alias("m"), F.col("docs").alias("d"))
    x = forms.select("machine", F.explode(F.array_compact(F.array(*keys))).alias("key"), "h", "n", "docs").join(m, ["machine", "key"])
    edges = materialize(x.filter((F.col("h") != F.col("to")) & (F.abs(F.col("n") - F.col("m")) <= 2) & (F.col("docs") <= F.col("d"))).select("machine", "h", "to").distinct(), "edges")
    needed = small_or_plain(edges.select("h").union(edges.select(F.col("to").alias("h"))).distinct())
    spelled = materialize(lines.select("h", "letters").join(needed, "h", "left_semi").groupBy("h").agg(F.first("letters").alias("letters")), "spelled")
    close = edges.join(spelled.toDF("h", "a"), "h").join(spelled.toDF("to", "b"), "to").filter(F.levenshtein("a", "b", 2) >= 0).select("machine", "h", "to")
    belongs = materialize(close.union(meant.select("machine", "h", F.col("h").alias("to"))), "belongs")
    # of a lone form the documents are known; only lines with misread copies count distinct documents again
    mixed = materialize(belongs.filter("h <> to").select("machine", "to").distinct(), "mixed")
    total = belongs.join(mixed, ["machine", "to"], "left_semi").join(seen.select("machine", "h", "id"), ["machine", "h"]).select("machine", "to", "id").distinct().groupBy("machine", "to").agg(F.count(F.lit(1)).alias("docs"))
    alone = meant.select("machine", F.col("h").alias("to"), "docs").join(mixed, ["machine", "to"], "left_anti")
    size = small_or_plain(machines.groupBy("machine").agg(F.count(F.lit(1)).alias("all")))
    share = F.col("docs") / F.col("all")
    often = alone.union(total).join(size, "machine").select("machine", "to", "docs", share.alias("share")).filter((F.col("docs") >= min_docs) & (F.col("share") >= min_share))
    often = materialize(often, "often")
    return often, materialize(belongs.join(often.select("machine", "to"), ["machine", "to"], "left_semi").select("machine", "h").distinct(), "forms")


def repeated_blocks(bodies: DataFrame, docs: DataFrame, min_docs: int = 5, min_share: float = 0.0) -> DataFrame:
    """(id, page, pg, block_no) of the blocks of ``bodies`` (unique ids) that are such lines. Documents without a machine have none."""
    lines = materialize(block_lines(bodies), "lines")
    machines = materialize(document_machines(docs), "machines")
    _, forms = frequent_lines(lines, machines, min_docs, min_share)
    rows = lines.select("id", "page", "pg", "block_no", "h").join(small_or_plain(forms.select("h").distinct()), "h", "left_semi")
    return rows.join(machines, "id").join(forms, ["machine", "h"], "left_semi").select("id", "page", "pg", "block_no").distinct()


def line_report(bodies: DataFrame, docs: DataFrame, min_docs: int = 5, min_share: float = 0.0) -> DataFrame:
    """(machine, line, docs, share): the repeated lines as meant (their letters), in how many documents of the machine they stand, and in what share of them."""
    lines = materialize(block_lines(bodies), "lines")
    often, _ = frequent_lines(lines, materialize(document_machines(docs), "machines"), min_docs, min_share)
    of = often.withColumnRenamed("to", "h")
    spelled = lines.select("h", "letters").join(small_or_plain(of.select("h").distinct()), "h", "left_semi").groupBy("h").agg(F.min("letters").alias("line"))
    return of.join(spelled, "h").select("machine", "line", "docs", "share")


def without_lines(bodies: DataFrame, drop: DataFrame) -> DataFrame:
    """``bodies`` with the blocks of ``drop`` (id, pg, block_no) taken out; all other columns and pages stay, ``dropped`` counts."""
    places = drop.groupBy("id", "pg").agg(F.collect_set("block_no").alias("b"))  # no more than the page has blocks
    per = places.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("pg", "b"))).alias("_drop"), F.sum(F.size("b")).cast("int").alias("_n"))

    def kept(p, i):
        left = F.array_except(F.sequence(F.lit(0), F.size(p["blocks"]) - 1), F.col("_drop")[i])
        return p.withField("blocks", F.when(F.map_contains_key("_drop", i), F.transform(left, lambda j: p["blocks"][j])).otherwise(p["blocks"]))

    out = bodies.join(per, "id", "left")
    return out.withColumns({"pages": F.when(F.col("_drop").isNull(), F.col("pages")).otherwise(F.transform("pages", kept)), "dropped": F.coalesce("_n", F.lit(0))}).drop("_drop", "_n")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = current_bodies(spark, sf_dir).select("id", "pages")
    return repeated_blocks(bodies, table(spark, sf_dir, "docs")).select("id", "page", "block_no").distinct()


def p3_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = current_bodies(spark, sf_dir).select("id", "pages")
    return without_lines(bodies, repeated_blocks(bodies, table(spark, sf_dir, "docs")))


def p3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(current_bodies(spark, sf_dir).select("id", "pages"), table(spark, sf_dir, "docs"))


QUERIES = {"p3_found": p3_found, "p3_cleaned": p3_cleaned, "p3_lines": p3_lines}
_SQL = rf"""WITH cur AS (SELECT id, pages FROM (SELECT id, pages, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) AS rn FROM doc_bodies WHERE id IS NOT NULL) WHERE rn = 1),
pg AS (SELECT id, unnest(pages) AS p FROM cur), bl AS (SELECT id, p.n AS page, unnest(p.blocks) AS b, CAST(generate_subscripts(p.blocks, 1) - 1 AS INTEGER) AS block_no FROM pg),
li AS (SELECT id, page, block_no, regexp_replace(lower(b.t), '[^\p{{L}}]+', '', 'g') AS letters, len(regexp_extract_all(b.t, '\p{{L}}{{4,}}')) AS w FROM bl WHERE b.t IS NOT NULL AND coalesce(b.k, '') <> 'h' AND len(regexp_extract_all(b.t, '\p{{L}}{{4,}}')) >= 5),
ma AS (SELECT DISTINCT id, trim(lower(machine)) AS machine FROM docs WHERE id IS NOT NULL AND trim(machine) <> ''),
sn AS (SELECT machine, letters, id, bool_or(w >= 6) AS whole FROM li JOIN ma USING (id) GROUP BY ALL), fo AS (SELECT machine, letters, length(letters) AS n, count(*) AS docs, bool_or(whole) AS whole FROM sn GROUP BY ALL),
me AS (SELECT machine, letters AS line, n AS m, docs AS d, CAST(floor((floor(n / {WIDTH}) * {WIDTH} - 1) / 2) AS BIGINT) AS half FROM fo WHERE docs >= 2 AND whole),
be AS (SELECT machine, letters, line FROM fo JOIN me USING (machine) WHERE letters = line OR (docs <= d AND abs(n - m) <= 2 AND (left(letters, half) = left(line, half) OR right(letters, half) = right(line, half)) AND levenshtein(letters, line) <= 2)),
al AS (SELECT machine, count(*) AS a FROM ma GROUP BY machine), oft AS (SELECT machine, line, docs, docs / a AS share FROM (SELECT machine, line, count(DISTINCT id) AS docs FROM be JOIN sn USING (machine, letters) GROUP BY ALL) JOIN al USING (machine) WHERE docs >= 5)"""
SQL = {
    "p3_found": _SQL + " SELECT DISTINCT id, page, block_no FROM li JOIN ma USING (id) JOIN be USING (machine, letters) JOIN oft USING (machine, line)",
    "p3_lines": _SQL + " SELECT * FROM oft",
}
