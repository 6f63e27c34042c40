"""Queries of the core over boards and circuits, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import constants as K
from ..operators import assoc, board, circuit
from ..operators.graph import components
from ..session import shared_dir
from ..sources import files
from ..sources.tables import table
from .corpus import ORD_LINES, lines

QUERIES: dict = {}
SQL: dict[str, str] = {}
DESIG, LABEL = r"^[A-Z]/?[A-Z]?[0-9]{1,3}$", r"^[+]?[0-9]{1,2}V?$"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _labels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    l = lines(spark, d)
    marks = l.filter(F.col("t").rlike(DESIG)).select("doc", "page", F.col("ord").alias("mid"), F.col("t").alias("label"), "x", "y")
    points = l.filter(F.col("t").rlike(LABEL)).select("doc", "page", F.col("ord").alias("pid"), F.col("t").alias("part"), "x", "y")
    return points, marks


_LABELS = f"{ORD_LINES}, pt AS (SELECT doc, page, ord AS pid, t AS part, x, y FROM o WHERE regexp_matches(t, '{LABEL}')), mk AS (SELECT doc, page, ord AS mid, t AS label, x, y FROM o WHERE regexp_matches(t, '{DESIG}'))"


@query(f"""WITH {_LABELS}, j AS (SELECT pt.doc, pt.page, pid, label, abs(pt.x - mk.x) + abs(pt.y - mk.y) AS dist, row_number() OVER (PARTITION BY pt.doc, pt.page, pid ORDER BY abs(pt.x - mk.x) + abs(pt.y - mk.y), mid) AS r FROM pt JOIN mk USING (doc, page) WHERE abs(pt.x - mk.x) + abs(pt.y - mk.y) <= {K.SIGNATURE_DISTANCE})
SELECT pt.doc, pt.page, pt.pid, coalesce(j.label, '(unplaced)') AS label, j.dist AS distance FROM pt LEFT JOIN j ON j.doc = pt.doc AND j.page = pt.page AND j.pid = pt.pid AND r = 1""")
def nearest_designator(spark, d):
    points, marks = _labels(spark, d)
    return assoc.nearest(points, marks, ["doc", "page"])


@query(f"""WITH {_LABELS}, j AS (SELECT mk.doc, mk.page, mid AS did, label AS desig, part, abs(pt.x - mk.x) + abs(pt.y - mk.y) AS distance, row_number() OVER (PARTITION BY mk.doc, mk.page, mid ORDER BY abs(pt.x - mk.x) + abs(pt.y - mk.y), pid) AS r FROM mk JOIN pt USING (doc, page) WHERE abs(pt.x - mk.x) <= 70 AND pt.y - mk.y BETWEEN -8 AND 70)
SELECT doc, page, did, desig, part, distance FROM j WHERE r = 1""")
def window_nearest_part(spark, d):
    points, marks = _labels(spark, d)
    return assoc.window_nearest(marks.withColumnsRenamed({"mid": "did", "label": "desig"}), points, ["doc", "page"])


@query("""WITH n AS (SELECT machine, doc_type, count(*) AS n, min(ord) AS o FROM docs WHERE machine IS NOT NULL AND doc_type IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY machine ORDER BY n DESC, o) AS r, CAST(sum(n) OVER (PARTITION BY machine) AS BIGINT) AS candidates FROM n)
SELECT machine, doc_type, n AS votes, candidates FROM r WHERE r = 1""")
def majority_vote(spark, d):
    return assoc.majority(table(spark, d, "docs").filter("machine is not null and doc_type is not null"), ["machine"], "doc_type")


_BOM = "bom AS (SELECT CAST(l_partkey AS VARCHAR) AS part, string_agg(ref, ',' ORDER BY ref) AS refs, count(*) AS qty FROM (SELECT DISTINCT l_partkey, l_orderkey || '-' || l_linenumber AS ref FROM lineitem) GROUP BY l_partkey)"


def _bom(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    return board.bom(l.select(F.col("l_partkey").cast("string").alias("part"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("ref")))


@query(f"WITH {_BOM} SELECT * FROM bom")
def bom_rollup(spark, d):
    return _bom(spark, d)


@query(f"WITH {_BOM} SELECT count(*) AS lines, CAST(coalesce(sum(qty), 0) AS BIGINT) AS devices FROM bom WHERE contains(lower(part), '17') OR contains(lower(refs), '17')")
def bom_filter_totals(spark, d):
    return board.bom_totals(_bom(spark, d), "17")


@query(f"WITH {_BOM} SELECT part, refs, qty FROM bom")
def csv_bom_roundtrip(spark, d):
    """Writes the bill of materials as CSV to the shared folder and reads it back."""
    import os
    import uuid

    path = os.path.join(shared_dir(spark), f"glyphmill-bom-{uuid.uuid4().hex}")
    files.write_bom_csv(_bom(spark, d), path)
    return files.read_bom_csv(spark, path).select("part", F.array_join("refs", ",").alias("refs"), F.col("qty").cast("bigint").alias("qty"))


_PARTS = [x[0] for x in K.DEVICES] + ["74LS999"]
_DEV = "dev(part, pins, vcc, gnd, description) AS (VALUES " + ", ".join(f"('{a}', {b}, {c}, {e}, '{f}')" for a, b, c, e, f, _ in K.DEVICES) + ")"


_PINS = [(d[0], g, pin, role) for d in K.DEVICES for g, gate in enumerate(d[5], 1) for role, pins in zip(("in", "ctrl", "out"), gate) for pin in pins]
_GATES = "gt(part, gate, pin, role) AS (VALUES " + ", ".join(f"('{a}', {b}, {c}, '{e}')" for a, b, c, e in _PINS) + ")"
_LIST = "[" + ", ".join(f"'{p}'" for p in _PARTS) + "]"


@query(f"WITH {_DEV}, c AS (SELECT substr('ABCDEFGHZ', CAST(p_partkey % 9 AS INTEGER) + 1, 1) AS row, p_partkey AS col, {_LIST}[p_partkey % {len(_PARTS)} + 1] AS part FROM part) SELECT 'U' || row || col AS ref, c.part, 'DIP-' || coalesce(pins, 14) AS package, CAST(10 + (col - 1) * 2.5 AS DOUBLE) AS x, CAST(5 + (instr('ABCDEFGH', row) - 1) * 4.0 AS DOUBLE) AS y FROM c LEFT JOIN dev ON dev.part = c.part WHERE instr('ABCDEFGH', row) > 0")
def grid_placement(spark, d):
    c = table(spark, d, "part").select(F.substring(F.lit("ABCDEFGHZ"), (F.col("p_partkey") % 9 + 1).cast("int"), F.lit(1)).alias("row"), F.col("p_partkey").alias("col"), F.array(*(F.lit(p) for p in _PARTS))[(F.col("p_partkey") % len(_PARTS)).cast("int")].alias("part"))
    return board.place_on_grid(c, circuit.device_pins(spark)[0], "ABCDEFGH", 10.0, 5.0, 2.5, 4.0)


@query("""WITH rev(revision, late) AS (VALUES ('r1', false), ('r2', false), ('r3', true), ('r4', true)), b AS (SELECT revision, 'S' || s_suppkey AS ref, CASE WHEN late THEN coalesce(CASE WHEN s_suppkey % 3 = 0 THEN 'A' || s_nationkey END, 'P' || s_suppkey) ELSE 'P' || s_suppkey END AS part FROM supplier, rev)
SELECT revision, ref, CASE WHEN revision = 'r2' AND ref IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_suppkey % 5 = 0) THEN 'M' || ref ELSE part END AS part FROM b""")
def revision_override(spark, d):
    s = table(spark, d, "supplier")
    ref = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
    dev = s.select(ref.alias("ref"), F.concat(F.lit("P"), F.col("s_suppkey").cast("string")).alias("primary"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("A"), F.col("s_nationkey").cast("string"))).alias("alternate"))
    rev = spark.createDataFrame([("r1", False), ("r2", False), ("r3", True), ("r4", True)], "revision string, late boolean")
    return board.revise(dev, rev, s.filter("s_suppkey % 5 = 0").select(F.lit("r2").alias("revision"), ref.alias("ref"), F.concat(F.lit("M"), ref).alias("part")))


@query("SELECT slug, full_name, mfr FROM (SELECT slug, full_name, mfr FROM machines WHERE slug NOT IN (SELECT DISTINCT lower(trim(machine)) FROM docs WHERE machine IS NOT NULL) UNION ALL SELECT lower(trim(machine)), max_by(machine_name, ord), 'listed' FROM docs WHERE trim(machine) <> '' GROUP BY 1)")
def upsert_registry(spark, d):
    new = table(spark, d, "docs").filter("trim(machine) <> ''").groupBy(F.lower(F.trim("machine")).alias("slug")).agg(F.max_by("machine_name", F.when(F.col("machine_name").isNotNull(), F.col("ord"))).alias("full_name")).withColumn("mfr", F.lit("listed"))
    return board.upsert(table(spark, d, "machines").select("slug", "full_name", "mfr"), new, "slug")


def netlist(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Order lines as a netlist: ref = order, pin = line number times two, net = part number (a supply net for some), one row per pin."""
    l = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("k"))
    net = F.when(F.col("k") % 11 == 0, "GND").when(F.col("k") % 13 == 0, "+5V").when(F.col("k") % 7 == 0, F.concat_ws("-", F.lit("L"), F.col("k").cast("string"), F.col("l_orderkey").cast("string"))).otherwise(F.concat(F.lit("N"), F.col("k").cast("string")))
    pin = F.when(F.col("k") % 97 == 0, "x").otherwise((F.col("l_linenumber") * 2).cast("string"))
    nets = l.select(F.col("l_orderkey").cast("string").alias("ref"), pin.alias("pin"), net.alias("net")).groupBy("ref", "pin").agg(F.min("net").alias("net"))
    parts = table(spark, d, "orders").filter("o_orderkey % 23 <> 0").select(F.col("o_orderkey").cast("string").alias("ref"), F.array(*(F.lit(p) for p in _PARTS))[(F.col("o_orderkey") % len(_PARTS)).cast("int")].alias("part"))
    return nets, parts


_NET = f"""{_DEV}, {_GATES}, k AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS k FROM lineitem GROUP BY ALL),
nets AS (SELECT ref, pin, min(net) AS net FROM (SELECT CAST(l_orderkey AS VARCHAR) AS ref, CASE WHEN k % 97 = 0 THEN 'x' ELSE CAST(l_linenumber * 2 AS VARCHAR) END AS pin, CASE WHEN k % 11 = 0 THEN 'GND' WHEN k % 13 = 0 THEN '+5V' WHEN k % 7 = 0 THEN 'L-' || k || '-' || l_orderkey ELSE 'N' || k END AS net FROM k) GROUP BY ALL),
pa AS (SELECT CAST(o_orderkey AS VARCHAR) AS ref, {_LIST}[o_orderkey % {len(_PARTS)} + 1] AS part FROM orders WHERE o_orderkey % 23 <> 0),
kn AS (SELECT nets.*, pa.part, pins, vcc, gnd, description, try_cast(pin AS INTEGER) AS p FROM nets LEFT JOIN pa USING (ref) LEFT JOIN dev ON dev.part = pa.part),
ro AS (SELECT part, pin, role FROM (SELECT *, row_number() OVER (PARTITION BY part, pin ORDER BY o) AS r FROM (SELECT part, vcc AS pin, 'vcc' AS role, -2 AS o FROM dev UNION ALL SELECT part, gnd, 'gnd', -1 FROM dev UNION ALL SELECT part, pin, role, gate * 4 + CASE role WHEN 'out' THEN 1 WHEN 'ctrl' THEN 2 ELSE 3 END FROM gt)) WHERE r = 1),
pr AS (SELECT kn.*, ro.role, net IN ('+5V', 'VCC', '5V', 'GND', '0V') AS power FROM kn LEFT JOIN ro ON ro.part = kn.part AND ro.pin = kn.p)"""


def _findings(spark: SparkSession, d: str) -> DataFrame:
    return circuit.validate(*netlist(spark, d), *circuit.device_pins(spark))


@query(f"WITH {_NET} SELECT 'several outputs' AS rule, CASE WHEN bool_and(ends_with(description, '(OC)')) THEN 'warning' ELSE 'error' END AS severity, net FROM pr WHERE pins IS NOT NULL AND role = 'out' AND p BETWEEN 1 AND pins AND NOT power GROUP BY net HAVING count(*) > 1")
def net_multi_driver(spark, d):
    return _findings(spark, d).filter("rule = 'several outputs'").select("rule", "severity", "net")


@query(f"WITH {_NET} SELECT net FROM nets WHERE net NOT IN ('+5V', 'VCC', '5V', 'GND', '0V') GROUP BY net HAVING count(*) = 1")
def net_single_pin(spark, d):
    return _findings(spark, d).filter("rule = 'one pin only'").select("net")


@query(f"""WITH {_NET}, f AS (SELECT ref, pin, net, CASE WHEN p IS NULL THEN 'pin is no number' WHEN p < 1 OR p > pins THEN 'pin outside' WHEN role IS NULL THEN 'no-connect' WHEN role IN ('vcc', 'gnd') AND NOT power THEN 'supply pin without supply' WHEN role IN ('in', 'out', 'ctrl') AND power THEN 'signal pin on supply' END AS rule FROM pr WHERE pins IS NOT NULL)
SELECT rule, CASE WHEN rule IN ('no-connect', 'signal pin on supply') THEN 'warning' ELSE 'error' END AS severity, ref, pin, net FROM f WHERE rule IS NOT NULL
UNION ALL SELECT DISTINCT CASE WHEN part IS NULL THEN 'unknown part' ELSE 'no pinout' END, 'warning', ref, NULL, NULL FROM kn WHERE pins IS NULL""")
def pin_rule_errors(spark, d):
    return _findings(spark, d).filter(~F.col("rule").isin("several outputs", "one pin only", "output of the wrong gate", "output without inputs"))


@query(f"""WITH {_NET}, g AS (SELECT ref, gate, count(DISTINCT CASE WHEN gt.role = 'in' THEN p END) AS i, count(DISTINCT CASE WHEN gt.role = 'out' THEN p END) AS o FROM kn JOIN gt ON gt.part = kn.part AND gt.pin = kn.p GROUP BY ALL),
s AS (SELECT ref, min(CASE WHEN o > 0 AND i = 0 THEN gate END) AS a, min(CASE WHEN i >= 2 AND o = 0 THEN gate END) AS b FROM g GROUP BY ref)
SELECT CASE WHEN b IS NOT NULL THEN 'output of the wrong gate' ELSE 'output without inputs' END AS rule, CASE WHEN b IS NOT NULL THEN 'error' ELSE 'warning' END AS severity, ref, CAST(a AS VARCHAR) AS gate FROM s WHERE a IS NOT NULL""")
def gate_coherence(spark, d):
    return _findings(spark, d).filter(F.col("rule").isin("output of the wrong gate", "output without inputs")).select("rule", "severity", "ref", F.col("pin").alias("gate"))


@query(f"WITH {_DEV}, {_GATES} SELECT part, array_to_string(list_filter(range(1, pins + 1), lambda p: p <> vcc AND p <> gnd), ',') AS signal_pins, array_to_string(list_filter(range(1, pins + 1), lambda p: p <> vcc AND p <> gnd AND NOT list_contains(u, p)), ',') AS unused FROM dev JOIN (SELECT part, list(pin) AS u FROM gt GROUP BY part) USING (part)")
def pinout_set_ops(spark, d):
    s = circuit.pin_sets(*circuit.device_pins(spark))
    return s.select("part", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("signal_pins", "unused")))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'd' || id AS a, 'm' || lower(trim(machine)) AS b FROM docs WHERE id IS NOT NULL AND machine IS NOT NULL), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(n, c) AS (SELECT a, a FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.n)
SELECT n AS node, min(c) AS component FROM r GROUP BY n""")
def net_components(spark, d):
    e = table(spark, d, "docs").filter("id is not null and machine is not null").select(F.concat(F.lit("d"), "id").alias("a"), F.concat(F.lit("m"), F.lower(F.trim("machine"))).alias("b"))
    return components(e)


@query(f"WITH {_NET}, f AS (SELECT CASE WHEN p IS NULL OR p < 1 OR p > pins OR (role IN ('vcc', 'gnd') AND NOT power) THEN 1 ELSE 0 END AS bad FROM pr WHERE pins IS NOT NULL) SELECT CAST(sum(bad) AS BIGINT) AS errors FROM f")
def circuit_verdict(spark, d):
    v = _findings(spark, d).filter(F.col("rule").isin("pin is no number", "pin outside", "supply pin without supply"))
    return circuit.verdict(v).select("errors")
