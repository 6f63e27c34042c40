"""Queries of the core over the catalogue's own pipeline, reports, reading order and the reader's questions, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..api import Archive
from ..functions import constants as K
from ..operators import assoc, board, catalog, circuit, extract, structure
from ..sources import files
from ..sources.tables import current_bodies, table
from ..streaming import ingest
from . import corpus
from .boards import _DEV, _GATES, _LIST, _PARTS, DESIG
from .corpus import _DIAG, _SLUG, CUR, FIRST, LAST, ORD_LINES

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def values(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# The catalogue's own pipeline: machines and their listings stand for the raw list of machines.


def raw_machines(spark: SparkSession, d: str) -> DataFrame:
    """Machines with their listings nested, as delivered; those whose slug has an odd number of letters have no id and get a slug made of the name."""
    doc = F.struct("ord", F.col("src").alias("l"), F.col("doc_type").alias("t"), F.col("title").alias("f"))
    docs = table(spark, d, "docs").groupBy(F.lower(F.trim("machine")).alias("slug")).agg(F.array_sort(F.collect_set(doc)).alias("docs"))
    m = table(spark, d, "machines").join(docs, "slug", "left")
    return m.select(F.col("slug").alias("ord"), F.when(F.length("slug") % 2 == 0, F.col("slug")).alias("id"), F.col("full_name").alias("name"), F.col("year_made").alias("y"), F.col("mfr").alias("m"), "cpu", F.col("audio").alias("aud"), F.col("display").alias("dip"), "docs")


_RAW = f"""ml AS (SELECT DISTINCT lower(trim(machine)) AS slug, ord, src, doc_type, title FROM docs),
mb AS (SELECT m.*, CASE WHEN length(slug) % 2 = 0 THEN slug ELSE {_SLUG.format("coalesce(full_name, '')")} END AS base FROM machines m),
mm AS (SELECT *, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS made FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY slug) AS n FROM mb)),
md AS (SELECT slug, ord, src, coalesce(nullif(doc_type, ''), 'Document') AS doc_type, coalesce(title, '') AS title, CAST(row_number() OVER (PARTITION BY slug ORDER BY ord NULLS FIRST, src NULLS FIRST, ml.doc_type NULLS FIRST, ml.title NULLS FIRST) - 1 AS INTEGER) AS place FROM ml WHERE src <> '')"""
_SHEETS = values(K.SCHEMATIC_TYPES)


@query(f"""WITH {_RAW}, n AS (SELECT slug, CAST(count(*) AS INTEGER) AS d, CAST(count(*) FILTER (WHERE doc_type IN ({_SHEETS})) AS INTEGER) AS k FROM md GROUP BY slug)
SELECT made AS s, coalesce(nullif(full_name, ''), 'Unknown') AS n, coalesce(year_made, '') AS y, coalesce(mfr, '') AS m, coalesce(d, 0) AS d, coalesce(k, 0) AS k, CAST(coalesce(len(display), 0) AS INTEGER) AS p,
 coalesce(array_to_string(list_filter(list_transform(cpu, lambda c: c.n), lambda x: x <> '')[1:3], ','), '') AS c FROM mm LEFT JOIN n USING (slug)""")
def machine_index(spark, d):
    return catalog.machine_index(catalog.normalise_machines(raw_machines(spark, d))).withColumn("c", F.array_join("c", ","))


@query(f"""WITH {_RAW} SELECT substr(sha1(src), 1, 12) AS id, made AS machine, coalesce(nullif(full_name, ''), 'Unknown') AS machine_name, title, doc_type, src, doc_type IN ({_SHEETS}) AS schematic, place FROM md JOIN mm USING (slug)""")
def machine_documents(spark, d):
    return catalog.flatten_docs(catalog.normalise_machines(raw_machines(spark, d)))


_STATS = "bs AS (SELECT id, count(*) AS n_pages, CAST(coalesce(sum(p.words), 0) AS BIGINT) AS n_words FROM (SELECT id, unnest(pages) AS p FROM cur) GROUP BY id)"


def _body_stats(spark: SparkSession, d: str) -> DataFrame:
    return structure.body_meta(current_bodies(spark, d)).filter("page_count > 0").select("id", F.col("page_count").cast("bigint").alias("n_pages"), F.col("words").alias("n_words"))


@query(f"""WITH {CUR}, {FIRST}, {_STATS} SELECT machine, string_agg(f.id || ':' || coalesce(CAST(n_words AS VARCHAR), '-'), ' ' ORDER BY ord, f.id) AS docs, count(n_words) AS ingested FROM f LEFT JOIN bs ON bs.id = f.id GROUP BY machine""")
def nested_docs(spark, d):
    n = catalog.nested_stats(catalog.first_wins(table(spark, d, "docs")), _body_stats(spark, d))
    one = lambda x: F.concat(x["id"], F.lit(":"), F.coalesce(x["n_words"].cast("string"), F.lit("-")))
    return n.select("machine", F.array_join(F.transform("docs", one), " ").alias("docs"), F.size(F.filter("docs", lambda x: x["ingested"])).cast("bigint").alias("ingested"))


_PART_LINES = f"{ORD_LINES}, pr AS (SELECT doc, page FROM o WHERE regexp_matches(t, '{K.PART_NO}'))"


def _part_lines(spark: SparkSession, d: str) -> DataFrame:
    """(doc, page) of scanned lines with a part number, in place of parts rows (whose pattern SQL can't express)."""
    return corpus.lines(spark, d).filter(F.col("t").rlike(K.PART_NO)).select("doc", "page")


@query(f"WITH {_PART_LINES}, {LAST}, n AS (SELECT doc, count(*) AS parts FROM pr GROUP BY doc) SELECT id, machine, title, n.parts FROM l LEFT JOIN n ON doc = id")
def docs_with_part_counts(spark, d):
    return catalog.with_part_counts(catalog.last_wins(table(spark, d, "docs")).select("id", "machine", "title"), _part_lines(spark, d))


@query(f"WITH {_PART_LINES}, {LAST}, n AS (SELECT doc, count(*) AS rows, count(DISTINCT page) AS pages FROM pr GROUP BY doc HAVING count(*) >= 2 ORDER BY rows DESC, doc LIMIT 10) SELECT doc, machine, title, rows, n.pages FROM n LEFT JOIN l ON id = doc")
def parts_report(spark, d):
    return extract.parts_report(_part_lines(spark, d), catalog.last_wins(table(spark, d, "docs")), least=2)


@query(f"WITH {_PART_LINES}, n AS (SELECT doc, count(*) AS n FROM pr GROUP BY doc HAVING count(*) >= 2) SELECT count(*) AS documents, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM n")
def parts_yield(spark, d):
    return extract.parts_yield(_part_lines(spark, d), least=2)


@query("SELECT count(*) FILTER (WHERE ingested) AS ingested, count(*) FILTER (WHERE NOT coalesce(ingested, false)) AS waiting, CAST(coalesce(sum(pages) FILTER (WHERE ingested), 0) AS BIGINT) AS pages, CAST(coalesce(sum(words) FILTER (WHERE ingested), 0) AS BIGINT) AS words, CAST(coalesce(sum(sections) FILTER (WHERE ingested), 0) AS BIGINT) AS sections FROM docs")
def ingest_totals(spark, d):
    return catalog.ingest_totals(table(spark, d, "docs"))


# Orders and what is shown of many


_TYPE_RANK = "coalesce(list_position([" + values(K.TYPE_ORDER) + f"], doc_type), {len(K.TYPE_ORDER) + 1})"


@query(f"WITH n AS (SELECT machine, doc_type, count(*) AS n FROM (SELECT DISTINCT lower(trim(machine)) AS machine, coalesce(doc_type, 'Document') AS doc_type, id FROM docs) GROUP BY ALL) SELECT machine, doc_type, n, CAST(row_number() OVER (PARTITION BY machine ORDER BY {_TYPE_RANK}, lower(doc_type), doc_type) AS INTEGER) AS place FROM n")
def type_sections(spark, d):
    docs = table(spark, d, "docs").select(F.lower(F.trim("machine")).alias("machine"), F.coalesce("doc_type", F.lit("Document")).alias("doc_type"), "id").distinct()
    return catalog.type_sections(docs)


@query(f"WITH {FIRST} SELECT id, ord, schematic FROM f ORDER BY coalesce(schematic, false) DESC, ord")
def reading_order(spark, d):
    return catalog.schematics_first(catalog.first_wins(table(spark, d, "docs"))).select("id", "ord", "schematic")


@query(f"WITH {FIRST}, r AS (SELECT machine, id, CAST(row_number() OVER (PARTITION BY machine ORDER BY ord, id) AS INTEGER) AS place FROM f WHERE ingested AND schematic AND coalesce(pages, 0) <= 4) SELECT * FROM r WHERE place <= 6")
def first_sheets(spark, d):
    return catalog.first_sheets(catalog.first_wins(table(spark, d, "docs"))).select("machine", "id", "place")


@query("SELECT slug, full_name AS name, mfr FROM machines ORDER BY mfr, name, slug")
def boards_in_order(spark, d):
    return board.boards_in_order(table(spark, d, "machines").select("slug", F.col("full_name").alias("name"), "mfr"))


@query("WITH p AS (SELECT DISTINCT doc_id || '-' || page || '.png' AS name, page FROM ocr_lines WHERE doc_id IS NOT NULL AND page IS NOT NULL) SELECT name, page AS number FROM p")
def page_order(spark, d):
    names = table(spark, d, "ocr_lines").filter("doc_id is not null and page is not null").select(F.concat("doc_id", F.lit("-"), F.col("page").cast("string"), F.lit(".png")).alias("name")).distinct()
    return names.select("name", files.page_number().alias("number")).orderBy("number", "name")


@query(f"WITH {_DIAG}, q AS (SELECT *, CAST(row_number() OVER (PARTITION BY machine, kind ORDER BY place) AS INTEGER) AS nth, count(*) OVER (PARTITION BY machine, kind) AS n FROM r WHERE place <= 200) SELECT machine, doc, section, page, kind, nth, n FROM q WHERE nth <= 12")
def diagnostics_by_kind(spark, d):
    return extract.diagnostics_by_kind(corpus.diagnostic_classify(spark, d)).select("machine", "doc", "section", "page", "kind", "nth", "n")


@query(f"""WITH {_DIAG}, n AS (SELECT machine, kind, count(*) AS n FROM r GROUP BY ALL), t AS (SELECT machine, CAST(sum(n) AS BIGINT) AS total FROM n GROUP BY machine ORDER BY total DESC, machine NULLS FIRST LIMIT 6),
q AS (SELECT n.machine, total, kind, n, CAST(row_number() OVER (PARTITION BY n.machine ORDER BY n DESC, kind) AS INTEGER) AS place FROM n JOIN t ON n.machine IS NOT DISTINCT FROM t.machine) SELECT * FROM q WHERE place <= 4""")
def largest_machines(spark, d):
    every = extract.diagnostics(corpus.outline_rows(spark, d), catalog.last_wins(table(spark, d, "docs")), top=2**31 - 1)
    return extract.largest_machines(every)


_SIGNALS = corpus.SQL["signal_index"]


@query(f"WITH si AS ({_SIGNALS}), n AS (SELECT machine, signal, CAST(sum(n) AS BIGINT) AS n, string_agg(DISTINCT sheet, ',' ORDER BY sheet) AS sheets FROM si GROUP BY ALL), q AS (SELECT *, CAST(row_number() OVER (PARTITION BY machine ORDER BY n DESC, signal) AS INTEGER) AS place FROM n) SELECT * FROM q WHERE place <= 14")
def top_signals(spark, d):
    return extract.top_signals(corpus.signal_index(spark, d))


@query(f"WITH si AS ({_SIGNALS}) SELECT machine, signal, sheet, n FROM (SELECT *, sum(n) OVER (PARTITION BY machine, signal) AS s FROM si) WHERE s >= 2")
def frequent_signals(spark, d):
    return extract.signal_index(corpus.words(spark, d), least=2)


@query(f"WITH si AS ({_SIGNALS}) SELECT signal, string_agg(DISTINCT sheet, ',' ORDER BY sheet) AS sheets FROM si WHERE contains(lower(signal), 'a') GROUP BY signal ORDER BY signal LIMIT 12")
def signal_search(spark, d):
    return board.find_signals(corpus.signal_index(spark, d), "A")


# Signature codes and votes


_SIG_AT = rf"""{ORD_LINES}, sw AS (SELECT doc, page, ord * 1000 + n AS pid, upper(w) AS code, x + n AS x, y FROM (SELECT *, unnest(regexp_split_to_array(t, '\s+')) AS w, generate_subscripts(regexp_split_to_array(t, '\s+'), 1) AS n FROM o WHERE c >= 45) WHERE regexp_matches(upper(w), '{K.SIGNATURE}') AND NOT regexp_matches(upper(w), '{K.NOT_SIGNATURE}')),
mk AS (SELECT doc, page, ord AS mid, t AS label, x, y FROM o WHERE regexp_matches(t, '{DESIG}')),
nj AS (SELECT sw.doc, sw.page, pid, label, abs(sw.x - mk.x) + abs(sw.y - mk.y) AS dist, row_number() OVER (PARTITION BY sw.doc, sw.page, pid ORDER BY abs(sw.x - mk.x) + abs(sw.y - mk.y), mid) AS r FROM sw JOIN mk USING (doc, page) WHERE abs(sw.x - mk.x) + abs(sw.y - mk.y) <= {K.SIGNATURE_DISTANCE}),
pl AS (SELECT sw.doc, sw.page, sw.pid, code, coalesce(label, '(unplaced)') AS device FROM sw LEFT JOIN nj ON nj.doc = sw.doc AND nj.page = sw.page AND nj.pid = sw.pid AND r = 1)"""


def placed_codes(spark: SparkSession, d: str) -> DataFrame:
    """(doc, page, code, device): signature codes, as if read from pages of 3,000 lines turned by a quarter, put back upright and given to the nearest designator."""
    l = corpus.read_lines(spark, d)
    w = l.filter("c >= 45").select("doc", "page", "ord", "x", "y", F.posexplode(F.split("t", r"\s+")).alias("n", "t")).withColumns({"code": F.upper("t"), "n": F.col("n") + 1})
    turned = w.filter(extract.is_signature(F.col("code"))).select("doc", "page", (F.col("ord") * 1000 + F.col("n")).alias("pid"), "code", (F.lit(2999) - F.col("y")).alias("x"), (F.col("x") + F.col("n")).alias("y"), F.lit(3000).alias("height"))
    points = extract.unrotate(turned)
    marks = l.filter(F.col("t").rlike(DESIG)).select("doc", "page", F.col("ord").alias("mid"), F.col("t").alias("label"), "x", "y")
    near = assoc.nearest(points, marks, ["doc", "page"])
    return points.select("doc", "page", "pid", "code").join(near.select("doc", "page", "pid", F.col("label").alias("device")), ["doc", "page", "pid"])


@query(f"WITH {_SIG_AT} SELECT * FROM pl")
def signature_places(spark, d):
    return placed_codes(spark, d)


@query(f"WITH {_SIG_AT} SELECT doc AS machine, device, string_agg(DISTINCT code, ',' ORDER BY code) AS codes, count(DISTINCT page) AS sheets FROM pl WHERE device <> '(unplaced)' GROUP BY ALL")
def device_codes(spark, d):
    p = placed_codes(spark, d).select(F.col("doc").alias("machine"), F.col("page").alias("sheet"), "code", "device")
    return extract.device_codes(p).withColumn("codes", F.array_join("codes", ","))


@query(rf"""WITH {CUR}, {LAST}, tx AS (SELECT id, list_aggregate(list_transform(coalesce(pages[1:6], []), lambda p: coalesce(array_to_string(list_filter(list_transform(coalesce(p.blocks, []), lambda b: b.t), lambda t: t IS NOT NULL), ' '), '')), 'string_agg', ' ') AS text FROM cur)
SELECT machine, l.id, title FROM l JOIN tx USING (id) WHERE regexp_matches(coalesce(title, ''), '(?i)parts') OR regexp_matches(coalesce(text, ''), '(?i)flyback\s+\w+')""")
def mentions(spark, d):
    return extract.mentions(current_bodies(spark, d), catalog.last_wins(table(spark, d, "docs")), "(?i)parts", r"(?i)flyback\s+\w+")


_VOTES = """mv AS (SELECT machine, coalesce(schematic, false) AS sheet, doc_type AS part, count(*) AS n, min(ord) AS o FROM docs WHERE machine IS NOT NULL AND doc_type IS NOT NULL GROUP BY ALL), mw AS (SELECT machine, sheet, part, n AS votes FROM (SELECT *, row_number() OVER (PARTITION BY machine, sheet ORDER BY n DESC, o) AS r FROM mv) WHERE r = 1)"""


@query(f"WITH {_VOTES} SELECT machine, part, votes, sheet FROM (SELECT *, row_number() OVER (PARTITION BY machine ORDER BY votes DESC, sheet) AS r FROM mw) WHERE r = 1")
def strongest_votes(spark, d):
    docs = table(spark, d, "docs").filter("machine is not null and doc_type is not null").select("machine", F.coalesce("schematic", F.lit(False)).alias("sheet"), F.col("doc_type").alias("part"), "ord")
    return assoc.strongest(assoc.majority(docs, ["machine", "sheet"]), ["machine"])


@query(r"""WITH c AS (SELECT unnest(list_concat(coalesce(cpu, []), coalesce(audio, []))).n AS n FROM machines), w AS (SELECT DISTINCT upper(unnest(regexp_split_to_array(n, '\s+'))) AS u FROM c), q AS (SELECT u AS word, CASE WHEN regexp_matches(u, '^[A-Z]?[0-9]') THEN translate(u, 'O', '0') ELSE u END AS v FROM w),
n AS (SELECT word, regexp_extract(v, '^(?:74)?(LS?[0-9]{2,3}|[0-9]{4,5}|82S[0-9]{2,3})', 1) AS p FROM q) SELECT word, CASE WHEN starts_with(p, 'LS') THEN '74' || p ELSE p END AS part FROM n WHERE p <> ''""")
def part_names(spark, d):
    """Of the words in the names of machines' chips those that are parts."""
    chips = table(spark, d, "machines").select(F.explode(F.concat(*(F.coalesce(F.transform(c, lambda x: x["n"]), F.array().cast("array<string>")) for c in ("cpu", "audio")))).alias("n"))
    w = chips.select(F.explode(F.split(F.upper("n"), r"\s+")).alias("word")).distinct()
    return w.select("word", extract.normalise_part(F.col("word")).alias("part")).filter("part is not null")


# Boards


_CELLS = f"ce AS (SELECT 'S' || l_suppkey AS board, 'U' || l_orderkey || '-' || l_linenumber AS ref, {_LIST}[l_partkey % {len(_PARTS)} + 1] AS part FROM lineitem)"


@query(f"WITH {_CELLS}, n AS (SELECT board, part, count(*) AS n FROM ce GROUP BY ALL) SELECT board, CAST(sum(n) AS BIGINT) AS devices, count(*) AS kinds, arg_min(part, (-n, part)) AS most FROM n GROUP BY board")
def board_report(spark, d):
    l = table(spark, d, "lineitem")
    part = F.array(*(F.lit(p) for p in _PARTS))[(F.col("l_partkey") % len(_PARTS)).cast("int")]
    return board.board_report(l.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("board"), F.concat_ws("-", F.concat(F.lit("U"), F.col("l_orderkey").cast("string")), F.col("l_linenumber").cast("string")).alias("ref"), part.alias("part")))


_REV = """rev(revision, late) AS (VALUES ('r1', false), ('r2', true)), dv AS (SELECT substr('ABCDEFGHZ', CAST(p_partkey % 9 AS INTEGER) + 1, 1) || p_partkey AS primary_ref, CASE WHEN p_partkey % 4 = 0 THEN 'B' || (p_partkey + 100000) WHEN p_partkey % 7 = 0 THEN 'IC?' END AS alternate_ref, p_brand AS part FROM part),
rt AS (SELECT revision, CASE WHEN late THEN coalesce(alternate_ref, primary_ref) ELSE primary_ref END AS ref, part FROM dv, rev), fit AS (SELECT *, regexp_matches(ref, '^\\p{L}[0-9]+$') AND contains('ABCDEFGH', ref[1]) AS fits FROM rt),
bo AS (SELECT revision, ref, part, 0 AS p FROM fit WHERE fits UNION ALL SELECT 'r2', 'A' || s_suppkey, 'M' || s_suppkey, 1 FROM supplier),
pd AS (SELECT revision, ref, arg_max(part, (p, part)) AS part FROM bo GROUP BY ALL)"""


def _revisions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = F.col("p_partkey")
    far = F.when(n % 4 == 0, F.concat(F.lit("B"), (n + 100000).cast("string"))).when(n % 7 == 0, F.lit("IC?"))
    devices = table(spark, d, "part").select(F.concat(F.substring(F.lit("ABCDEFGHZ"), (n % 9 + 1).cast("int"), F.lit(1)), n.cast("string")).alias("primary"), far.alias("alternate"), F.col("p_brand").alias("part"))
    memory = table(spark, d, "supplier").select(F.lit("r2").alias("revision"), F.concat(F.lit("A"), F.col("s_suppkey").cast("string")).alias("ref"), F.concat(F.lit("M"), F.col("s_suppkey").cast("string")).alias("part"))
    return board.place_revisions(devices, spark.createDataFrame([("r1", False), ("r2", True)], "revision string, late boolean"), memory, "ABCDEFGH")


@query(f"WITH {_REV} SELECT * FROM pd")
def revision_placement(spark, d):
    return _revisions(spark, d)[0]


@query(f"WITH {_REV}, c AS (SELECT revision, count(*) AS placed FROM pd GROUP BY ALL) SELECT revision, coalesce(placed, 0) AS placed, off_grid FROM (SELECT revision, count(*) FILTER (WHERE NOT fits) AS off_grid FROM fit GROUP BY ALL) LEFT JOIN c USING (revision)")
def revision_report(spark, d):
    return _revisions(spark, d)[1]


@query("SELECT 'A' || p_partkey AS device, p_name AS part, p_type AS section FROM part WHERE starts_with('a' || p_partkey, 'a1') OR contains(lower(p_name), 'a1') OR contains(lower(p_type), 'a1') ORDER BY device, part LIMIT 40")
def chip_search(spark, d):
    chips = table(spark, d, "part").select(F.concat(F.lit("A"), F.col("p_partkey").cast("string")).alias("device"), F.col("p_name").alias("part"), F.col("p_type").alias("section"))
    return board.find_chips(chips, " A1 ")


@query("SELECT p_name AS part, p_brand AS refs, CAST(p_size AS INTEGER) AS qty FROM part ORDER BY lower(p_brand) DESC, p_name")
def bom_sorted(spark, d):
    return board.sort_bom(table(spark, d, "part").select(F.col("p_name").alias("part"), F.col("p_brand").alias("refs"), F.col("p_size").cast("int").alias("qty")), "refs", False)


@query("SELECT p_name AS name, CAST(i AS INTEGER) AS i, i * 2.5::DOUBLE AS x FROM part, LATERAL (SELECT unnest(range(0, CAST(p_size % 5 AS BIGINT))) AS i)")
def array_positions(spark, d):
    return board.array_positions(table(spark, d, "part").select(F.col("p_name").alias("name"), (F.col("p_size") % 5).cast("int").alias("count")), 2.5)


# Supply and signal nets


_PADS = f"""pv AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'C' ELSE 'U' END || p_partkey AS ref, CASE WHEN p_partkey % 5 = 0 THEN '0.1uF' ELSE {_LIST}[p_partkey % {len(_PARTS)} + 1] END AS value, CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 16 END AS n FROM part),
pad AS (SELECT ref, value, CAST(unnest(range(1, n + 1)) AS VARCHAR) AS pin FROM pv)"""


def pads(spark: SparkSession, d: str) -> DataFrame:
    """(ref, value, pin): every part as a footprint, a fifth of them capacitors with two pads, the others circuits with sixteen."""
    n = F.col("p_partkey")
    cap = n % 5 == 0
    value = F.when(cap, F.lit("0.1uF")).otherwise(F.array(*(F.lit(p) for p in _PARTS))[(n % len(_PARTS)).cast("int")])
    return table(spark, d, "part").select(F.concat(F.when(cap, "C").otherwise("U"), n.cast("string")).alias("ref"), value.alias("value"), F.explode(F.sequence(F.lit(1), F.when(cap, 2).otherwise(16)).cast("array<string>")).alias("pin"))


_POWER = f"{_DEV}, {_PADS}, pp AS (SELECT ref, pin, CASE WHEN pin = CAST(vcc AS VARCHAR) THEN '+5V' ELSE 'GND' END AS net FROM pad JOIN dev ON part = value WHERE pin IN (CAST(vcc AS VARCHAR), CAST(gnd AS VARCHAR)) UNION ALL SELECT ref, pin, CASE WHEN pin = '1' THEN '+5V' ELSE 'GND' END FROM pad WHERE value = '0.1uF')"


@query(f"WITH {_POWER} SELECT * FROM pp")
def power_nets(spark, d):
    return circuit.connect_power(pads(spark, d), circuit.device_pins(spark)[0])


@query(f"WITH {_DEV} SELECT part, CAST(unnest([vcc, gnd]) AS VARCHAR) AS pin, unnest(['+5V', 'GND']) AS net FROM dev")
def power_pins(spark, d):
    return circuit.power_pins(circuit.device_pins(spark)[0])


_WANTED = f"{_PADS}, wa AS (SELECT DISTINCT 'N' || l_orderkey AS net, CASE WHEN l_partkey % 5 = 0 THEN 'C' ELSE 'U' END || (l_partkey + l_linenumber) AS ref, CAST(l_linenumber * 3 AS VARCHAR) AS pin FROM lineitem)"
_STATE = "st AS (SELECT net, wa.ref, wa.pin, CASE WHEN h.ref IS NOT NULL THEN 'connected' WHEN r.ref IS NOT NULL THEN 'no pad' ELSE 'no footprint' END AS state FROM wa LEFT JOIN pad h ON h.ref = wa.ref AND h.pin = wa.pin LEFT JOIN pv r ON r.ref = wa.ref)"


def _wanted(spark: SparkSession, d: str) -> DataFrame:
    """(net, ref, pin) of every order line; lines that repeat one another aren't merged yet."""
    l = table(spark, d, "lineitem")
    ref = F.concat(F.when(F.col("l_partkey") % 5 == 0, "C").otherwise("U"), (F.col("l_partkey") + F.col("l_linenumber")).cast("string"))
    return l.select(F.concat(F.lit("N"), F.col("l_orderkey").cast("string")).alias("net"), ref.alias("ref"), (F.col("l_linenumber") * 3).cast("string").alias("pin"))


@query(f"WITH {_WANTED}, {_STATE} SELECT * FROM st")
def signal_nets(spark, d):
    return circuit.connect_signals(_wanted(spark, d).distinct(), pads(spark, d))


@query(f"WITH {_WANTED}, {_STATE} SELECT net, count(*) AS pads, count(DISTINCT ref) AS parts FROM st WHERE state = 'connected' GROUP BY net")
def pad_tally(spark, d):
    wired = circuit.connect_signals(_wanted(spark, d), pads(spark, d)).filter("state = 'connected'")
    return circuit.pad_tally(wired.distinct())  # merged where they met their footprint, which needs no shuffle of its own


_LIBRARY = f"""{_DEV}, {_GATES}, nm(part, symbol) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in K.LIBRARY_NAMES.items())}),
rl AS (SELECT part, pin, CASE WHEN bool_or(role = 'out') THEN 'output' ELSE 'input' END AS kind FROM gt GROUP BY ALL),
sy AS (SELECT symbol, CAST(p AS VARCHAR) AS pin, CASE WHEN p = CASE WHEN s.part = '7490' THEN 14 ELSE vcc END THEN 'VCC' WHEN p = gnd THEN 'GND' ELSE 'P' || p END AS name, CASE WHEN p IN (vcc, gnd) THEN 'power_in' WHEN s.part = '7486' AND p = 3 THEN 'input' ELSE coalesce(kind, 'passive') END AS kind FROM (SELECT dev.*, symbol, unnest(range(1, pins + CASE WHEN dev.part = '7410' THEN 3 ELSE 1 END)) AS p FROM dev JOIN nm USING (part)) s LEFT JOIN rl ON rl.part = s.part AND rl.pin = s.p WHERE NOT (s.part = '7404' AND p = 2) AND s.part <> '7433')"""


def _symbols(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The pinouts, their names in a library, and a library made of the pinouts with one fault of each kind."""
    devices, gates = circuit.device_pins(spark)
    names = spark.createDataFrame(list(K.LIBRARY_NAMES.items()), "part string, symbol string")
    roles = gates.groupBy("part", F.col("pin").alias("p")).agg(F.when(F.bool_or(F.col("role") == "out"), "output").otherwise("input").alias("kind"))
    every = devices.join(names, "part").filter("part <> '7433'").withColumn("p", F.explode(F.sequence(F.lit(1), F.col("pins") + F.when(F.col("part") == "7410", 2).otherwise(0)))).filter("not (part = '7404' and p = 2)").join(roles, ["part", "p"], "left")
    name = F.when(F.col("p") == F.when(F.col("part") == "7490", 14).otherwise(F.col("vcc")), "VCC").when(F.col("p") == F.col("gnd"), "GND").otherwise(F.concat(F.lit("P"), F.col("p").cast("string")))
    kind = F.when(F.col("p").isin(F.col("vcc"), F.col("gnd")), "power_in").when((F.col("part") == "7486") & (F.col("p") == 3), "input").otherwise(F.coalesce("kind", F.lit("passive")))
    return devices, gates, names, every.select("symbol", F.col("p").cast("string").alias("pin"), name.alias("name"), kind.alias("kind"))


@query(f"""WITH {_LIBRARY}, n AS (SELECT symbol, count(*) AS n FROM sy GROUP BY ALL), dk AS (SELECT dev.*, symbol, n FROM dev LEFT JOIN nm USING (part) LEFT JOIN n USING (symbol)), us AS (SELECT DISTINCT gt.part, dk.symbol, CAST(gt.pin AS VARCHAR) AS pin, role, sy.kind FROM gt JOIN dk ON dk.part = gt.part AND n IS NOT NULL LEFT JOIN sy ON sy.symbol = dk.symbol AND sy.pin = CAST(gt.pin AS VARCHAR)),
su AS (SELECT part, dk.symbol, name, string_agg(pin, '/' ORDER BY pin) AS got, bool_or(pin = CASE WHEN name = 'VCC' THEN CAST(vcc AS VARCHAR) ELSE CAST(gnd AS VARCHAR) END) AS fine FROM dk JOIN sy USING (symbol) WHERE name IN ('VCC', 'GND') GROUP BY ALL),
fd AS (SELECT part, symbol, 'more pins than the package' AS problem, CAST(n AS VARCHAR) AS detail FROM dk WHERE n > pins UNION ALL SELECT part, symbol, 'supply pin differs', name || ' ' || got FROM su WHERE NOT fine
 UNION ALL SELECT DISTINCT part, symbol, 'pin not on symbol', pin FROM us WHERE kind IS NULL UNION ALL SELECT part, symbol, 'output typed otherwise', pin || ' ' || kind FROM us WHERE role = 'out' AND kind NOT IN ({values(K.OUTPUT_TYPES)}))
SELECT * FROM fd UNION ALL SELECT part, symbol, 'not checked', NULL FROM dk WHERE n IS NULL UNION ALL SELECT part, symbol, NULL, NULL FROM dk WHERE n IS NOT NULL AND part NOT IN (SELECT part FROM fd)""")
def library_check(spark, d):
    return circuit.library_check(*_symbols(spark))


# What a reader sees


_KINDS = "bk AS (SELECT id AS doc, pi, p.n AS page, unnest(p.blocks) AS b, generate_subscripts(p.blocks, 1) AS bi FROM (SELECT id, unnest(pages) AS p, generate_subscripts(pages, 1) AS pi FROM cur)), kb AS (SELECT doc, pi, page, bi, CASE WHEN b.k IN ('h', 'note', 'li', 'tr') THEN b.k ELSE 'p' END AS k, b.t AS t FROM bk WHERE b.t IS NOT NULL)"


@query(f"""WITH {CUR}, {_KINDS}, g AS (SELECT *, CASE WHEN k IN ('li', 'tr') AND lag(k) OVER (PARTITION BY doc, pi ORDER BY bi) = k THEN 0 ELSE 1 END AS s FROM kb), r AS (SELECT *, CAST(sum(s) OVER (PARTITION BY doc, pi ORDER BY bi) - 1 AS INTEGER) AS run FROM g)
SELECT doc, page, run, k, string_agg(CASE WHEN k = 'li' THEN regexp_replace(t, '{K.BULLET_MARK}', '') ELSE t END, '|' ORDER BY bi) AS items FROM r GROUP BY doc, pi, page, run, k""")
def block_runs(spark, d):
    return structure.block_runs(current_bodies(spark, d)).withColumn("items", F.array_join("items", "|"))


@query(f"""WITH {CUR}, u AS (SELECT id AS doc, unnest(outline) AS o, generate_subscripts(outline, 1) AS n FROM cur WHERE len(pages) >= 3 AND len(outline) > 0), p AS (SELECT id AS doc, unnest(pages).n AS page, generate_subscripts(pages, 1) AS n FROM cur WHERE NOT coalesce(len(pages) >= 3 AND len(outline) > 0, false))
SELECT doc, CAST(n - 1 AS INTEGER) AS place, o.t AS label, o.p AS page, o.lvl AS lvl FROM u UNION ALL SELECT doc, CAST(n - 1 AS INTEGER), 'Page ' || page, page, 1 FROM p""")
def reader_contents(spark, d):
    return structure.contents(current_bodies(spark, d))


@query(f"WITH {CUR}, {_KINDS} SELECT doc, page, CAST(bi - 1 AS INTEGER) AS block, regexp_replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '(?i)(flyback)', '<mark>\\1</mark>', 'g') AS html FROM kb WHERE contains(lower(t), 'flyback')")
def highlighted(spark, d):
    p = current_bodies(spark, d).select(F.col("id").alias("doc"), F.explode("pages").alias("p")).select("doc", F.col("p.n").alias("page"), F.posexplode("p.blocks").alias("block", "b"))
    return p.filter(F.contains(F.lower("b.t"), F.lit("flyback"))).select("doc", "page", "block", structure.highlight(F.col("b.t"), "flyback").alias("html"))


@query(r"SELECT doc_id, coalesce(text, '') AS text, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS INTEGER) AS words FROM documents")
def page_word_counts(spark, d):
    return structure.word_counts(table(spark, d, "documents").select("doc_id", "text"))


@query(f"WITH {CUR} SELECT id FROM cur WHERE outline IS NULL OR len(list_filter(pages, lambda p: p.blocks IS NULL)) > 0")
def backfill_todo(spark, d):
    return structure.needs_structure(current_bodies(spark, d)).select("id")


@query(f"WITH {CUR} SELECT id, CAST(coalesce(len(pages), 0) AS INTEGER) AS page_count, CAST(coalesce(list_sum(list_transform(pages, lambda p: p.words)), 0) AS BIGINT) AS words, CAST(coalesce(list_sum(list_transform(pages, lambda p: len(p.blocks))), 0) AS BIGINT) AS blocks, CAST(coalesce(len(outline), 0) AS INTEGER) AS sections FROM cur")
def body_meta(spark, d):
    return structure.body_meta(current_bodies(spark, d))


@query(f"WITH {CUR}, {FIRST} SELECT cur.id, len(cur.pages) AS n_pages, title, doc_type, machine, machine_name, src, schematic, f.parts FROM cur LEFT JOIN f ON f.id = cur.id")
def doc_projection(spark, d):
    docs = catalog.first_wins(table(spark, d, "docs")).select("id", "title", "doc_type", "machine", "machine_name", "src", "schematic", "parts")
    return current_bodies(spark, d).select("id", F.size("pages").cast("bigint").alias("n_pages")).join(docs, "id", "left")


@query("""WITH s AS (SELECT m.*, instr(lower(coalesce(full_name, '')), 'a') AS pos FROM machines m WHERE slug IN (SELECT lower(trim(machine)) FROM docs WHERE schematic)),
r AS (SELECT slug, CAST(CASE WHEN lower(full_name) = 'a' THEN 1000 WHEN pos = 1 THEN 500 - length(full_name) WHEN pos > 0 THEN 201 - pos WHEN contains(lower(coalesce(mfr, '')), 'a') THEN 50 ELSE -1 END AS INTEGER) AS score FROM s) SELECT slug, score, count(*) OVER () AS total FROM r WHERE score >= 0 ORDER BY score DESC, slug LIMIT 200""")
def api_machines(spark, d):
    return Archive(spark, d).machines("a", 500, with_docs=True, with_schematics=True).select("slug", "score", "total")


@query(f"WITH si AS ({_SIGNALS}) SELECT signal, sheet, n FROM si WHERE lower(trim(machine)) = (SELECT min(lower(trim(machine))) FROM si)")
def api_signals(spark, d):
    m = corpus.signal_index(spark, d).agg(F.min(F.lower(F.trim("machine")))).first()[0]
    return Archive(spark, d).signals(m)


@query(f"""WITH {CUR}, {LAST}, p AS (SELECT id, unnest(pages) AS p FROM cur), tx AS (SELECT id, string_agg(coalesce(array_to_string(list_filter(list_transform(coalesce(p.blocks, []), lambda b: b.t), lambda t: t IS NOT NULL), ' '), ''), chr(10)) AS text FROM p GROUP BY id),
tf AS (SELECT token, id AS doc, count(*) AS cnt FROM (SELECT id, unnest(regexp_extract_all(lower(text), '{K.TOKEN}')) AS token FROM tx) GROUP BY ALL), n AS (SELECT count(*) AS n FROM tx), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
post AS (SELECT token, doc, cnt FROM (SELECT tf.*, row_number() OVER (PARTITION BY token ORDER BY cnt DESC, doc) AS r FROM tf JOIN df USING (token), n WHERE NOT (df > {K.MAX_DF_RATIO} * n.n AND df > {K.MIN_DF_PRUNED})) WHERE r <= {K.MAX_POSTINGS}),
h AS (SELECT doc, CAST(sum(cnt) AS BIGINT) AS hits, max(CASE WHEN token = 'meter' THEN cnt END) AS cnt_first FROM post WHERE token IN ('meter', 'between') AND doc IN (SELECT id FROM l) GROUP BY doc HAVING count(DISTINCT token) = 2)
SELECT doc, hits, cnt_first, count(*) OVER () AS total, title, machine FROM h JOIN l ON id = doc ORDER BY hits DESC, cnt_first DESC, doc LIMIT 60""")
def api_search(spark, d):
    """Over the index written by shard."""
    return Archive(spark, d).search("Meter between meter")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, d):
    return ingest.windowed_counts(table(spark, d, "events"))


@query("WITH a AS (SELECT event_id AS id, event_type = 'error' AS bad FROM events), s AS (SELECT id FROM a GROUP BY id HAVING bool_or(NOT bad)) SELECT DISTINCT event_id AS id FROM events WHERE event_id NOT IN (SELECT id FROM s)")
def pending_ids(spark, d):
    """Ids none of whose attempts succeeded are tried again."""
    ev = table(spark, d, "events")
    return ingest.pending(ev.select(F.col("event_id").alias("id")).distinct(), ingest.state(ingest.attempts(ev)))
