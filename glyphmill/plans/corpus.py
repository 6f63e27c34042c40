"""Queries of the core over documents, catalogue and scanned lines, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import constants as K
from ..operators import catalog, extract, search, structure
from ..session import materialize
from ..sources.tables import current_bodies, table
from ..streaming import ingest

TERMS = "meter between"
CUR = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) AS rn FROM doc_bodies WHERE id IS NOT NULL) WHERE rn = 1)"
ORD_LINES = "o AS (SELECT DISTINCT doc_id AS doc, page, ord, t, x0 AS x, y0 AS y, h, c FROM ocr_lines WHERE t IS NOT NULL)"
FIRST = "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS rn FROM docs WHERE id IS NOT NULL) WHERE rn = 1)"
LAST = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS rn FROM docs WHERE id IS NOT NULL) WHERE rn = 1)"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def counts(spark: SparkSession, d: str) -> DataFrame:
    return search.token_counts(table(spark, d, "documents"))


def postings(spark: SparkSession, d: str) -> DataFrame:
    """Pruned and capped postings of current bodies."""
    pages = structure.page_texts(current_bodies(spark, d))
    bodies = pages.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list(F.struct("page", "text"))).getField("text"), "\n").alias("text"))
    c = search.token_counts(bodies, "doc", "text")
    return search.capped_postings(search.prune(c, bodies.agg(F.count(F.lit(1)).alias("n"))))


def outline_rows(spark: SparkSession, d: str) -> DataFrame:
    """(doc, ord, section, page) of the outlines of current bodies."""
    return current_bodies(spark, d).select(F.col("id").alias("doc"), F.posexplode("outline").alias("ord", "o")).select("doc", "ord", F.col("o.t").alias("section"), F.col("o.p").alias("page")).filter("section is not null")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Distinct scanned lines (doc, page, ord, t, x, y, h, c)."""
    return table(spark, d, "ocr_lines").filter("t is not null").select(F.col("doc_id").alias("doc"), "page", "ord", "t", F.col("x0").alias("x"), F.col("y0").alias("y"), "h", "c").distinct()


def read_lines(spark: SparkSession, d: str) -> DataFrame:
    """``lines`` as a table, for operators that read them several times."""
    return materialize(lines(spark, d), "lines")


_TF = f"tf AS (SELECT token, doc_id AS doc, count(*) AS cnt FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{K.TOKEN}')) AS token FROM documents) GROUP BY ALL)"
_KEPT = f"{_TF}, n AS (SELECT count(*) AS n FROM documents), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token), kept AS (SELECT tf.* FROM tf JOIN df USING (token), n WHERE NOT (df > {K.MAX_DF_RATIO} * n.n AND df > {K.MIN_DF_PRUNED}))"
_POST = f"{_KEPT}, post AS (SELECT CASE WHEN regexp_matches(token, '^[a-z0-9]') THEN token[1] ELSE '_' END AS shard, token, doc, cnt FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY cnt DESC, doc) AS r FROM kept) WHERE r <= {K.MAX_POSTINGS})"


def _doc_postings(spark: SparkSession, d: str) -> DataFrame:
    return search.capped_postings(search.prune(counts(spark, d), table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"))))


@query(f"WITH {_POST}, h AS (SELECT doc, CAST(sum(cnt) AS BIGINT) AS hits, max(CASE WHEN token = 'meter' THEN cnt END) AS cnt_first FROM post WHERE token IN ('meter', 'between') GROUP BY doc HAVING count(DISTINCT token) = 2) SELECT doc, hits, cnt_first, count(*) OVER () AS total, lang, source FROM h JOIN documents ON doc_id = doc ORDER BY hits DESC, cnt_first DESC, doc LIMIT 60")
def search_and_topk(spark, d):
    hits = search.search(_doc_postings(spark, d), TERMS)
    return hits.join(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "lang", "source"), "doc").orderBy(F.desc("hits"), F.desc("cnt_first"), "doc")


@query(f"WITH {_POST} SELECT * FROM post")
def postings_sharded(spark, d):
    return _doc_postings(spark, d)


@query(f"WITH {_TF}, n AS (SELECT count(*) AS n FROM documents) SELECT token, count(*) AS df, NOT (count(*) > 0.92 * any_value(n.n) AND count(*) > 8) AS kept FROM tf, n GROUP BY token")
def term_df_prune(spark, d):
    n = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"))
    return search.document_frequency(counts(spark, d)).crossJoin(F.broadcast(n)).select("token", "df", (~((F.col("df") > K.MAX_DF_RATIO * F.col("n")) & (F.col("df") > K.MIN_DF_PRUNED))).alias("kept"))


@query(f"WITH {_POST} SELECT shard, count(DISTINCT token) AS tokens, count(*) AS postings FROM post GROUP BY shard")
def shard_sizes(spark, d):
    return _doc_postings(spark, d).groupBy("shard").agg(F.count_distinct("token").alias("tokens"), F.count(F.lit(1)).alias("postings"))


@query("SELECT (SELECT count(*) FROM machines) AS machines, (SELECT count(*) FROM machines WHERE len(cpu) > 0) AS machines_with_cpu, count(*) AS docs, count(DISTINCT machine) AS documented, count(*) FILTER (WHERE schematic) AS schematics, count(*) FILTER (WHERE ingested) AS ingested, CAST(coalesce(sum(pages) FILTER (WHERE ingested), 0) AS BIGINT) AS pages, CAST(coalesce(sum(words) FILTER (WHERE ingested), 0) AS BIGINT) AS words FROM docs")
def corpus_stats(spark, d):
    return catalog.corpus_stats(table(spark, d, "machines"), table(spark, d, "docs"))


@query("""WITH s AS (SELECT slug, full_name, mfr, lower(coalesce(full_name, '')) AS n, lower(coalesce(mfr, '')) AS m FROM machines),
r AS (SELECT slug, full_name, mfr, CAST(CASE WHEN n = 'storm' THEN 1000 WHEN starts_with(n, 'storm') THEN 500 - length(n) WHEN instr(n, 'storm') > 0 THEN 200 - (instr(n, 'storm') - 1) WHEN instr(m, 'storm') > 0 THEN 50 ELSE -1 END AS INTEGER) AS score FROM s)
SELECT *, count(*) OVER () AS total FROM r WHERE score >= 0 ORDER BY score DESC, slug LIMIT 50""")
def entity_search_ranked(spark, d):
    return catalog.search_machines(table(spark, d, "machines").select("slug", "full_name", "mfr"), "storm")


@query(f"""WITH {CUR}, {FIRST}, p AS (SELECT id, unnest(pages) AS p FROM cur), s AS (SELECT id, count(*) AS n_pages, CAST(coalesce(sum(p.words), 0) AS BIGINT) AS n_words, CAST(sum(coalesce(len(p.blocks), 0)) AS BIGINT) AS n_blocks FROM p GROUP BY id)
SELECT f.id, machine, title, n_pages, n_words, n_blocks FROM f LEFT JOIN s ON f.id = s.id""")
def catalog_stats_leftjoin(spark, d):
    zero = F.lit(0).cast("bigint")
    total = lambda f: F.aggregate(F.transform("pages", f), zero, lambda a, x: a + F.coalesce(x.cast("bigint"), zero))
    stats = current_bodies(spark, d).filter(F.size("pages") > 0).select("id", F.size("pages").cast("bigint").alias("n_pages"), total(lambda p: p["words"]).alias("n_words"), total(lambda p: F.greatest(F.size(p["blocks"]), F.lit(0))).alias("n_blocks"))
    return catalog.with_stats(catalog.first_wins(table(spark, d, "docs")).select("id", "machine", "title"), stats)


@query(f"WITH {FIRST}, {LAST} SELECT f.id, f.machine AS first_machine, l.machine AS last_machine, f.title AS first_title, l.title AS last_title FROM f JOIN l ON f.id = l.id")
def catalog_first_last_wins(spark, d):
    docs = table(spark, d, "docs")
    a, b = (w(docs).select("id", F.col("machine").alias(f"{n}_machine"), F.col("title").alias(f"{n}_title")) for w, n in ((catalog.first_wins, "first"), (catalog.last_wins, "last")))
    return a.join(b, "id")


@query(r"""WITH b AS (SELECT p_partkey AS ord, regexp_replace(regexp_replace(lower(trim(regexp_replace(p_name, '[^A-Za-z0-9_\s-]', '', 'g'))), '[\s_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS base FROM part), r AS (SELECT ord, base, row_number() OVER (PARTITION BY base ORDER BY ord) AS n FROM b)
SELECT ord, base, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM r""")
def slug_dedup(spark, d):
    return catalog.number_slugs(table(spark, d, "part").select(F.col("p_partkey").alias("ord"), catalog.slug_ascii("p_name").alias("base")))


_SLUG = r"coalesce(nullif(regexp_replace(regexp_replace(lower(trim(regexp_replace(strip_accents({0}), '[^A-Za-z0-9_\s-]', '', 'g'))), '[\s_-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown')"


@query("SELECT slug, " + _SLUG.format("coalesce(full_name, '')") + " AS made FROM machines")
def slug_unicode(spark, d):
    return table(spark, d, "machines").select("slug", catalog.slugify("full_name").alias("made"))


@query("SELECT DISTINCT src, substr(sha1(src), 1, 12) AS made FROM docs WHERE src IS NOT NULL")
def stable_ids(spark, d):
    return table(spark, d, "docs").filter("src is not null").select("src", catalog.stable_id("src").alias("made")).distinct()


@query("""WITH r AS (SELECT DISTINCT slug, raw FROM (SELECT slug, unnest(list_transform(coalesce(cpu, []), lambda c: c.n)) AS raw FROM machines UNION ALL SELECT slug, unnest(list_transform(coalesce(audio, []), lambda c: c.n)) FROM machines) WHERE raw <> ''),
n AS (SELECT lower(raw) AS chip, slug, row_number() OVER (PARTITION BY lower(raw) ORDER BY slug, raw) AS k FROM r) SELECT chip, string_agg(slug, ',' ORDER BY k) AS machines, count(*) AS n FROM n WHERE k <= 300 GROUP BY chip""")
def chip_index_cap300(spark, d):
    return catalog.chip_index(table(spark, d, "machines")).select("chip", F.array_join("machines", ",").alias("machines"), F.size("machines").cast("bigint").alias("n"))


_KIND = "CASE " + " ".join(f"WHEN regexp_matches(section, '(?i){p}') THEN '{k}'" for k, p in K.DIAGNOSTIC_KINDS) + " END"
_RANK = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, (k, _) in enumerate(K.DIAGNOSTIC_KINDS)) + " END"
_DIAG = f"""{CUR}, {LAST}, u AS (SELECT id AS doc, unnest(outline) AS o, generate_subscripts(outline, 1) AS ord FROM cur), s AS (SELECT doc, ord, o.t AS section, o.p AS page FROM u), k AS (SELECT *, {_KIND} AS kind FROM s),
g AS (SELECT machine, doc, title, section, page, kind, k.ord FROM k JOIN l ON l.id = doc WHERE kind IS NOT NULL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY machine ORDER BY {_RANK}, title NULLS FIRST, page NULLS FIRST, doc, ord) AS INTEGER) AS place FROM g)"""


@query(f"WITH {_DIAG} SELECT machine, doc, title, section, page, kind, place FROM r WHERE place <= 200")
def diagnostic_classify(spark, d):
    return extract.diagnostics(outline_rows(spark, d), catalog.last_wins(table(spark, d, "docs")))


@query(f"WITH {_DIAG} SELECT machine, count(*) FILTER (WHERE kind = 'adjustment') AS adjustment, count(*) FILTER (WHERE kind = 'dip switches') AS dip_switches, count(*) FILTER (WHERE kind = 'safety') AS safety, count(*) AS n FROM r WHERE place <= 200 GROUP BY machine")
def diagnostic_kind_counts(spark, d):
    rows = diagnostic_classify(spark, d)
    p = rows.groupBy("machine").pivot("kind", ["adjustment", "dip switches", "safety"]).agg(F.count(F.lit(1)))
    zero = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(0).cast("bigint"))
    return p.join(rows.groupBy(F.col("machine").alias("m2")).agg(F.count(F.lit(1)).alias("n")), F.col("machine").eqNullSafe(F.col("m2"))).select("machine", zero("adjustment").alias("adjustment"), zero("dip switches").alias("dip_switches"), zero("safety").alias("safety"), "n")


def _listed_parts(spark: SparkSession, d: str) -> DataFrame:
    """Page texts with part numbers in the form the parts pattern knows: the archive's have one digit more."""
    return structure.page_texts(current_bodies(spark, d)).withColumn("text", F.regexp_replace("text", r"\b([A-Z][0-9]{2}-)[0-9]([0-9]{4})\b", "$1$2"))


@query()
def parts_extract(spark, d):
    return extract.parts_rows(_listed_parts(spark, d))


@query()
def parts_dedup_min_rows(spark, d):
    return extract.distinct_parts(extract.parts_rows(_listed_parts(spark, d)))


@query(f"WITH {ORD_LINES} SELECT doc, page, count(*) FILTER (WHERE regexp_matches(t, '{K.PART_NO}')) AS hits FROM o GROUP BY ALL HAVING hits >= 1")
def part_number_density(spark, d):
    return extract.part_density(lines(spark, d), least=1)


_HEADERS = f"""{ORD_LINES}, e AS (SELECT doc, page, lower(trim(regexp_replace(t, '[0-9]+', '', 'g'))) AS key, row_number() OVER (PARTITION BY doc, page ORDER BY ord) AS a, row_number() OVER (PARTITION BY doc, page ORDER BY ord DESC) AS b FROM o),
k AS (SELECT DISTINCT doc, page, key FROM e WHERE (a <= 3 OR b <= 3) AND length(key) BETWEEN 3 AND 60), n AS (SELECT doc, count(DISTINCT page) AS n FROM o GROUP BY doc), hd AS (SELECT doc, key, count(*) AS pages FROM k JOIN n USING (doc) WHERE n >= 4 GROUP BY doc, key, n HAVING count(*) >= 0.4 * n)"""


@query(f"WITH {_HEADERS} SELECT * FROM hd")
def running_headers(spark, d):
    return structure.running_headers(read_lines(spark, d))


@query(f"WITH {ORD_LINES} SELECT doc, median(h) AS body FROM o WHERE h BETWEEN 8 AND 200 GROUP BY doc")
def body_height_median(spark, d):
    return structure.body_height(lines(spark, d))


_S = "\\s"
_HEADS = rf"""{ORD_LINES}, b AS (SELECT doc, median(h) AS body FROM o WHERE h BETWEEN 8 AND 200 GROUP BY doc),
sp AS (SELECT doc, page FROM o GROUP BY ALL HAVING bool_or(regexp_matches(t, '{K.CONTENTS_PAGE}')) OR count(*) FILTER (WHERE regexp_matches(t, '[.·]{{3,}}')) >= 4 OR count(*) FILTER (WHERE regexp_matches(t, '{K.PART_NO}')) >= 5),
q AS (SELECT doc, page, ord, trim(t) AS raw, x, y, h, c FROM o ANTI JOIN sp USING (doc, page)),
z AS (SELECT *, list_filter(regexp_split_to_array(raw, '[^A-Za-z]+'), lambda w: w <> '') AS ws, length(regexp_replace(raw, '\P{{L}}', '', 'g')) AS nl, length(regexp_replace(raw, '[^0-9]', '', 'g')) AS nd FROM q),
ok AS (SELECT doc, page, ord, raw, x, y, h, trim(regexp_replace(regexp_replace(raw, '[.\s·]{{2,}}[0-9]{{1,3}}\s*$', ''), '[\s.·—-]+$', '')) AS t FROM z WHERE NOT regexp_matches(raw, '{K.NOISE}') AND NOT regexp_matches(raw, '{K.PAGE_NO}') AND NOT regexp_matches(raw, '{K.FIGURE}') AND c >= 70 AND length(raw) BETWEEN 4 AND 80 AND NOT regexp_matches(raw, '{K.TOC_ENTRY}')
 AND NOT regexp_matches(raw, '[|\\/~«»_^{{}}<>]') AND nl / length(raw) >= 0.55 AND nd / length(raw) <= 0.3 AND len(ws) > 0 AND list_max(list_transform(ws, lambda w: length(w))) >= CASE WHEN len(ws) > 1 THEN 3 ELSE 4 END),
v AS (SELECT *, regexp_split_to_array(trim(t), '\s+') AS w FROM ok JOIN b USING (doc) WHERE length(t) >= 4 AND length(t) - length(replace(t, '.', '')) <= 4),
hc AS (SELECT doc, page, ord, t, raw, CAST(CASE WHEN h >= 1.7 * body THEN 1 WHEN h >= 1.28 * body AND regexp_matches(t, '^\p{{Lu}}') AND len(w) <= 6 AND (regexp_matches(t, '{K.SECTION_NO}') OR (NOT regexp_matches(t, '\.\s+\w') AND (length(regexp_replace(t, '\P{{Lu}}', '', 'g')) > 0.85 * length(regexp_replace(t, '\P{{L}}', '', 'g')) OR len(list_filter(w, lambda k: regexp_matches(k, '^\p{{Lu}}'))) >= 0.7 * len(w)))) THEN 2 END AS INTEGER) AS lvl, x, y, h FROM v)"""


@query(f"WITH {_HEADS} SELECT * FROM hc WHERE lvl IS NOT NULL")
def heading_candidates(spark, d):
    return structure.heading_candidates(read_lines(spark, d))


_MERGED = rf"""{_HEADS}, cand AS (SELECT doc, page, t, lvl, x, y, h, row_number() OVER (PARTITION BY doc, page ORDER BY ord, t, lvl, x, y, h) AS rn FROM hc WHERE lvl IS NOT NULL),
fold(doc, page, rn, grp, t, lvl, x, y, h, part) AS (SELECT doc, page, rn, 1, t, lvl, x, y, h, t FROM cand WHERE rn = 1
 UNION ALL SELECT c.doc, c.page, c.rn, CASE WHEN c.joins THEN f.grp ELSE f.grp + 1 END, CASE WHEN c.joins THEN trim(f.t || ' ' || c.t) ELSE c.t END, c.lvl, CASE WHEN c.joins THEN f.x ELSE c.x END, c.y, c.h, c.t
 FROM fold f, LATERAL (SELECT *, c.lvl = f.lvl AND abs(f.h - c.h) <= greatest(f.h, c.h) * 0.28 AND abs(f.x - c.x) <= greatest(f.h, c.h) * 2.5 AND c.y - (f.y + f.h) BETWEEN -2 AND f.h * 1.1 AND (regexp_matches(c.t, '^\p{{Ll}}') OR NOT regexp_matches(c.t, '{K.SECTION_NO}')) AS joins FROM cand c WHERE c.doc = f.doc AND c.page = f.page AND c.rn = f.rn + 1) c),
mh AS (SELECT doc, page, CAST(grp - 1 AS INTEGER) AS pos, arg_max(t, rn) AS t, any_value(lvl) AS lvl, string_agg(part, '|' ORDER BY rn) AS parts FROM fold WHERE grp <= 6 GROUP BY doc, page, grp)"""


def _merged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    l = read_lines(spark, d)
    return l, materialize(structure.merge_headings(structure.heading_candidates(l)), "headings")


@query(f"WITH RECURSIVE {_MERGED} SELECT * FROM mh")
def heading_merge(spark, d):
    rows = _merged(spark, d)[1].select("doc", "page", F.posexplode("heads").alias("pos", "m"))
    return rows.select("doc", "page", "pos", "m.t", "m.lvl", F.array_join("m.parts", "|").alias("parts"))


@query(f"WITH RECURSIVE {_MERGED}, oq AS (SELECT doc, page AS p, pos, t, lvl, regexp_replace(lower(t), '[^a-z0-9]+', '', 'g') AS key FROM mh) SELECT doc, p, pos, t, lvl FROM (SELECT *, row_number() OVER (PARTITION BY doc, key ORDER BY p NULLS FIRST, pos) AS r FROM oq WHERE key <> '') WHERE r = 1")
def outline_of_scans(spark, d):
    return structure.outline(_merged(spark, d)[1])


@query(f"""WITH {CUR}, u AS (SELECT id AS doc, unnest(outline) AS o, CAST(generate_subscripts(outline, 1) - 1 AS INTEGER) AS pos FROM cur), k AS (SELECT doc, o.p AS p, pos, o.t AS t, o.lvl AS lvl, regexp_replace(lower(o.t), '[^a-z0-9]+', '', 'g') AS key FROM u WHERE o.t IS NOT NULL)
SELECT doc, p, pos, t, lvl FROM (SELECT *, row_number() OVER (PARTITION BY doc, key ORDER BY p NULLS FIRST, pos) AS r FROM k WHERE key <> '') WHERE r = 1""")
def outline_first_occurrence(spark, d):
    rows = current_bodies(spark, d).select(F.col("id").alias("doc"), F.posexplode("outline").alias("pos", "o"))
    return structure.outline(rows.select("doc", F.col("o.p").alias("page"), F.array(F.struct(F.col("o.t").alias("t"), F.col("o.lvl").alias("lvl"))).alias("heads"), F.col("pos").alias("at")).withColumn("heads", F.when(F.col("heads")[0]["t"].isNotNull(), F.col("heads"))).transform(_keep_pos))


def _keep_pos(df: DataFrame) -> DataFrame:
    """Pad each single-entry array to its place, so that its position in the outline is the tie break."""
    kind = "array<struct<t:string,lvl:int>>"
    return df.filter("heads is not null").select("doc", "page", F.concat(F.array_repeat(F.lit(None).cast("struct<t:string,lvl:int>"), F.col("at")).cast(kind), F.col("heads").cast(kind)).alias("heads"))


_JOINED = r"trim(regexp_replace(replace(regexp_replace(string_agg(t, chr(10) ORDER BY ord), '([^-])-\n(\p{Ll})', '\1\2', 'g'), chr(10), ' '), '\s+', ' ', 'g'))"


def _blocks_sql(heads: str) -> str:
    """The blocks, with ``heads`` (doc, page, part, head), the lines that stand for a heading."""
    return rf"""med AS (SELECT doc, page, list_sort(list(h))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS med FROM o GROUP BY ALL), {heads},
r AS (SELECT o.doc, o.page, ord, trim(t) AS t, y, h, med, hf.head, len(regexp_extract_all(t, '\s{{3,}}')) >= 2 AS tr FROM o JOIN med USING (doc, page) LEFT JOIN hd ON hd.doc = o.doc AND hd.key = lower(trim(regexp_replace(trim(t), '[0-9]+', '', 'g'))) LEFT JOIN hf ON hf.doc = o.doc AND hf.page = o.page AND hf.part = trim(t) WHERE hd.key IS NULL AND NOT regexp_matches(trim(t), '{K.NOISE}') AND NOT regexp_matches(trim(t), '{K.PAGE_NO}')),
g AS (SELECT *, CASE WHEN lag(ord) OVER w IS NULL OR y - (lag(y) OVER w + lag(h) OVER w) > 0.9 * med OR regexp_matches(t, '{K.BULLET}') OR regexp_matches(t, '{K.CALLOUT}') OR head IS NOT NULL OR lag(head) OVER w IS NOT NULL OR tr OR lag(tr) OVER w THEN 1 ELSE 0 END AS s FROM r WINDOW w AS (PARTITION BY doc, page ORDER BY ord)),
i AS (SELECT *, CAST(sum(s) OVER (PARTITION BY doc, page ORDER BY ord) AS BIGINT) AS block FROM g),
x AS (SELECT doc, page, block, max(head) AS head, bool_or(tr) AS tr, coalesce(max(head), {_JOINED}) AS t, first(t ORDER BY ord) AS f FROM i GROUP BY ALL),
z2 AS (SELECT doc, page, block, CASE WHEN head IS NOT NULL THEN 'h' WHEN tr THEN 'tr' WHEN regexp_matches(t, '{K.CALLOUT}') THEN 'note' WHEN regexp_matches(f, '{K.BULLET}') THEN 'li' ELSE 'p' END AS k, t FROM x WHERE t <> '')
SELECT doc, page, block, k, t FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, k, t ORDER BY block) AS once FROM z2) WHERE k <> 'h' OR once = 1"""


_NO_HEADS = "hf(doc, page, part, head) AS (SELECT CAST(NULL AS VARCHAR), CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) WHERE false)"


@query(f"WITH {_HEADERS}, " + _blocks_sql(_NO_HEADS))
def paragraph_blocks(spark, d):
    return structure.paragraph_blocks(read_lines(spark, d))


@query(f"WITH RECURSIVE {_MERGED}, {_HEADERS.removeprefix(ORD_LINES + ', ')}, " + _blocks_sql("hf AS (SELECT doc, page, part, arg_max(t, pos) AS head FROM (SELECT doc, page, pos, t, unnest(string_split(parts, '|')) AS part FROM mh) GROUP BY doc, page, part)"))
def paragraph_blocks_with_headings(spark, d):
    return structure.paragraph_blocks(*_merged(spark, d))


@query(f"WITH {ORD_LINES} SELECT doc, page, {_JOINED} AS text FROM (SELECT doc, page, ord, trim(t) AS t FROM o WHERE trim(t) <> '') GROUP BY ALL")
def dehyphenated_text(spark, d):
    g = lines(spark, d).select("doc", "page", "ord", F.trim("t").alias("t")).filter("t <> ''").groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("ord", "t"))).alias("a"))
    return g.select("doc", "page", structure.join_lines(F.transform("a", lambda x: x["t"])).alias("text"))


@query(f"WITH {CUR}, p AS (SELECT id AS doc, unnest(pages) AS p FROM cur) SELECT doc, p.n AS page, coalesce(array_to_string(list_filter(list_transform(coalesce(p.blocks, []), lambda b: b.t), lambda t: t IS NOT NULL), ' '), '') AS text FROM p")
def page_text_flatten(spark, d):
    return structure.page_texts(current_bodies(spark, d))


def words(spark: SparkSession, d: str) -> DataFrame:
    """(machine, sheet, t, c, page) words of scanned lines."""
    return table(spark, d, "ocr_lines").filter("t is not null and machine is not null").select("machine", F.col("doc_id").alias("sheet"), "page", "ord", "t", "c").distinct().select("machine", "sheet", "page", F.explode(F.split("t", r"\s+")).alias("t"), "c")


_WORDS = r"w AS (SELECT machine, doc_id AS sheet, page, unnest(regexp_split_to_array(t, '\s+')) AS t, c FROM (SELECT DISTINCT machine, doc_id, page, ord, t, c FROM ocr_lines WHERE t IS NOT NULL AND machine IS NOT NULL))"
_PROSE = ", ".join(f"'{w}'" for w in K.PROSE_WORDS)


@query(rf"""WITH {_WORDS}, s AS (SELECT machine, sheet, regexp_replace(t, '^[.,;:()\[\]]+|[.,;:()\[\]]+$', '', 'g') AS t FROM w WHERE c >= 60), n AS (SELECT machine, sheet, CASE WHEN regexp_matches(t, '{K.BUS}') THEN regexp_extract(t, '{K.BUS}', 1) || translate(regexp_extract(t, '{K.BUS}', 2), 'OI', '01') ELSE t END AS signal FROM s)
SELECT machine, signal, sheet, count(*) AS n FROM n WHERE regexp_matches(signal, '{K.SIGNAL}') AND NOT regexp_matches(signal, '{K.NOT_SIGNAL}') AND NOT (signal IN ({_PROSE}) AND NOT regexp_matches(signal, '[0-9]')) GROUP BY ALL""")
def signal_index(spark, d):
    return extract.signal_index(words(spark, d))


@query(f"WITH {_WORDS} SELECT machine, string_agg(DISTINCT upper(t), ',' ORDER BY upper(t)) AS codes, count(DISTINCT upper(t)) AS n FROM w WHERE c >= 45 AND regexp_matches(upper(t), '{K.SIGNATURE}') AND NOT regexp_matches(upper(t), '{K.NOT_SIGNATURE}') GROUP BY machine")
def signature_codes(spark, d):
    w = words(spark, d).filter("c >= 45").select("machine", F.upper("t").alias("t")).filter(extract.is_signature(F.col("t")))
    return w.groupBy("machine").agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias("codes"), F.count_distinct("t").alias("n"))


@query(f"""WITH {CUR}, pg AS (SELECT DISTINCT id AS doc, unnest(pages).n AS page FROM cur), u AS (SELECT id AS doc, unnest(outline) AS o, generate_subscripts(outline, 1) AS ord FROM cur)
SELECT pg.doc, page, (SELECT max_by(o.t, (o.p, ord)) FROM u WHERE u.doc = pg.doc AND o.p <= page AND o.t IS NOT NULL) AS section FROM pg""")
def section_asof_page(spark, d):
    from ..operators.assoc import asof_section

    pages = current_bodies(spark, d).select(F.col("id").alias("doc"), F.explode("pages.n").alias("page")).distinct()
    return asof_section(pages, outline_rows(spark, d).withColumnRenamed("page", "p").filter("p is not null"))


@query("""WITH r AS (SELECT lower(trim(machine)) AS machine, coalesce(doc_type, 'Document') AS doc_type, count(*) AS n, min(title) AS first_title FROM (SELECT DISTINCT machine, doc_type, id, title FROM docs) GROUP BY 1, 2)
SELECT machine, doc_type, n, first_title, CAST(row_number() OVER (PARTITION BY machine ORDER BY n DESC, doc_type) AS INTEGER) AS place FROM r""")
def grouped_docs_ranked(spark, d):
    from pyspark.sql import Window as W

    r = table(spark, d, "docs").select("machine", "doc_type", "id", "title").distinct().groupBy(F.lower(F.trim("machine")).alias("machine"), F.coalesce("doc_type", F.lit("Document")).alias("doc_type")).agg(F.count(F.lit(1)).alias("n"), F.min("title").alias("first_title"))
    return r.withColumn("place", F.row_number().over(W.partitionBy("machine").orderBy(F.desc("n"), "doc_type")))


@query(f"WITH {CUR}, p AS (SELECT id AS doc, unnest(pages) AS p FROM cur), t AS (SELECT doc, p.n AS page, array_to_string(list_filter(list_transform(coalesce(p.blocks, []), lambda b: b.t), lambda t: t IS NOT NULL), ' ') AS text FROM p) SELECT doc, count(DISTINCT page) AS pages, min(page) AS first FROM t WHERE contains(lower(text), 'flyback') GROUP BY doc")
def in_document_find(spark, d):
    return structure.find_in_document(structure.page_texts(current_bodies(spark, d)), "flyback")


@query("SELECT DISTINCT id, title FROM docs WHERE id NOT IN (SELECT id FROM doc_bodies WHERE id IS NOT NULL) AND id IS NOT NULL")
def todo_anti_join(spark, d):
    return catalog.todo(table(spark, d, "docs").filter("id is not null").select("id", "title").distinct(), table(spark, d, "doc_bodies"))


@query("SELECT slug, full_name FROM machines WHERE slug IN (SELECT lower(trim(machine)) FROM docs WHERE machine IS NOT NULL)")
def only_semi_join(spark, d):
    return catalog.only(table(spark, d, "machines").select("slug", "full_name"), table(spark, d, "docs").select(F.lower(F.trim("machine")).alias("slug")), "slug")


@query("SELECT coalesce(doc_type, 'Document') AS doc_type, count(*) AS n, count(*) FILTER (WHERE doc_type IN (" + ", ".join(f"'{t}'" for t in K.SCHEMATIC_TYPES) + ")) AS flagged FROM docs GROUP BY 1 ORDER BY n DESC, doc_type LIMIT 8")
def doc_type_histogram(spark, d):
    return table(spark, d, "docs").groupBy(F.coalesce("doc_type", F.lit("Document")).alias("doc_type")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc_type").isin(K.SCHEMATIC_TYPES)).alias("flagged")).orderBy(F.desc("n"), "doc_type").limit(8)


@query(r"SELECT DISTINCT title, trim(regexp_replace(regexp_replace(regexp_replace(title, '(?i)\.pdf$', ''), '_', ' ', 'g'), '\s+', ' ', 'g')) AS pretty FROM docs WHERE title IS NOT NULL")
def pretty_titles(spark, d):
    return table(spark, d, "docs").filter("title is not null").select("title", structure.pretty_title().alias("pretty")).distinct()


@query("""WITH a AS (SELECT event_id AS id, ts, event_type = 'error' AS bad, props FROM events) SELECT id, CASE WHEN bool_or(NOT bad) THEN 'done' ELSE 'failed' END AS status, CASE WHEN NOT bool_or(NOT bad) THEN max_by(props, ts) END AS error FROM a GROUP BY id""")
def incremental_ingest(spark, d):
    """Drains a file stream of the events into an attempt log, twice: the second run finds nothing new. Then the state of every id."""
    import os
    import uuid

    from ..session import shared_dir

    base = os.path.join(shared_dir(spark), f"glyphmill-ingest-{uuid.uuid4().hex}")
    ev = table(spark, d, "events")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ev.schema.fields)
    for _ in range(2):
        ingest.drain(spark, os.path.join(d, "events.parquet*"), "parquet", schema, ingest.attempts, f"{base}/log", f"{base}/checkpoint")
    return ingest.state(spark.read.parquet(f"{base}/log"))
