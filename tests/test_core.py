from __future__ import annotations

import importlib
import os
import random
import re
import sys
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from glyphmill import session
from glyphmill.functions import constants as K
from glyphmill.api import Archive
from glyphmill.operators import assoc, board, catalog, circuit, extract, raster, search, structure
from glyphmill.operators.graph import components
from glyphmill.plans import registry
from glyphmill.sources import files
from glyphmill.sources.tables import bounded_rows, current_rows, document_machines
from glyphmill.streaming import ingest

DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(DATA):
        p = f"{DATA}/{t}"
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    session.release(spark)
    cur = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    assert got == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in cur.fetchall())


def test_llm_is_optional():
    for at, _, names in os.walk(os.path.dirname(importlib.import_module("glyphmill").__file__)):
        for n in names:
            if n.endswith(".py") and f"{os.sep}llm" not in at:
                assert not re.search(r"^\s*(from|import)\s.*\bllm\b", open(os.path.join(at, n)).read(), re.M), n


def test_llm_that_cannot_be_imported_leaves_the_core(monkeypatch):
    entry = importlib.import_module("__spark_entry__")
    real = importlib.import_module

    def fail(name, *args):
        if ".llm." in name:
            raise ModuleNotFoundError(name)
        return real(name, *args)

    monkeypatch.setattr("importlib.import_module", fail)
    for name in [m for m in sys.modules if m.startswith("glyphmill.llm")]:
        monkeypatch.delitem(sys.modules, name)
    assert set(entry.queries()) == set(registry.queries()) and set(entry.oracle_sql()) == set(registry.oracle_sql())


def test_shared_folder():
    assert session.on_one_machine("local") and session.on_one_machine("local[*]") and session.on_one_machine("local[8, 3]")
    assert not any(map(session.on_one_machine, ("spark://host:7077", "yarn", "k8s://host", "local-cluster[3,2,1024]")))
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(getConf=dict, getCheckpointDir=lambda: None, master="yarn"))
    with pytest.raises(RuntimeError):
        session.shared_dir(cluster)


def test_release(spark):
    session.release(spark)
    df = session.materialize(spark.range(5))
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 5 and os.path.exists(path)
    assert session.release(spark) == 1 and session.release(spark) == 0 and not os.path.exists(path)


def test_bounded_rows(spark):
    assert len(bounded_rows(spark.range(3), 3)) == 3
    with pytest.raises(ValueError):
        bounded_rows(spark.range(4), 3)


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab1 2-Z", max_size=40))
def test_query_terms(q):
    t = search.query_terms(q)
    assert len(t) == len(set(t)) and all(len(x) >= 3 and not re.search(r"\s", x) for x in t)


def test_search_prunes_caps_and_ranks(spark):
    docs = spark.createDataFrame([(i, "common alpha " * (1 + i % 3) + ("beta" if i % 2 else "")) for i in range(20)], "doc_id long, text string")
    c = search.token_counts(docs)
    kept = search.prune(c, docs.agg(F.count(F.lit(1)).alias("n")))
    assert {r.token for r in kept.select("token").distinct().collect()} == {"beta"}  # in all 20 documents: over 92 % and over 8
    p = search.capped_postings(c, cap=3)
    assert [r.doc for r in p.filter("token = 'alpha'").orderBy(F.desc("cnt"), "doc").collect()] == [2, 5, 8]
    hits = search.search(search.capped_postings(c), "beta alpha x").collect()
    assert {r.total for r in hits} == {10} and len(hits) == 10 and [r.hits for r in hits] == sorted((r.hits for r in hits), reverse=True)
    assert search.search(p, "zz").count() == 0
    with pytest.raises(ValueError):
        search.check_limit(-1, 60, 200)


def test_exactly_eight_documents_are_kept(spark):
    docs = spark.createDataFrame([(i, "everywhere") for i in range(8)], "doc_id long, text string")
    c = search.token_counts(docs)
    assert search.prune(c, docs.agg(F.count(F.lit(1)).alias("n"))).count() == 8


def test_current_rows(spark, tmp_path):
    df = spark.sql("SELECT * FROM VALUES ('a', 1, timestamp'2020-01-01'), ('a', 2, timestamp'2021-01-01'), ('a', 2, timestamp'2021-01-01'), ('b', 3, NULL), (NULL, 4, NULL) t(id, v, ingested_at)")
    assert rows(current_rows(df).select("id", "v")) == [("a", 2), ("b", 3)]
    df.write.parquet(str(tmp_path / "x"))
    stored = spark.read.parquet(str(tmp_path / "x"))
    assert rows(current_rows(stored).select("id", "v")) == [("a", 2), ("b", 3)]
    assert current_rows(stored.limit(0)).count() == 0


def test_document_machines(spark):
    d = spark.createDataFrame([("1", " Ab "), ("1", "ab"), ("2", None), ("3", " ")], "id string, machine string")
    assert rows(document_machines(d)) == [("1", "ab")]


def test_catalog(spark):
    d = spark.createDataFrame([("x", 1, "m"), ("x", 2, "n"), (None, 3, "o")], "id string, ord int, machine string")
    assert rows(catalog.first_wins(d)) == [("x", 1, "m")] and rows(catalog.last_wins(d)) == [("x", 2, "n")]
    n = catalog.number_slugs(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "ord int, base string"))
    assert [r.slug for r in n.orderBy("ord").collect()] == ["a", "a-2", "b"]
    s = spark.createDataFrame([("Café  Ünit_9!",), ("--",), (None,)], "name string").select(catalog.slugify("name").alias("s"))
    assert [r.s for r in s.collect()] == ["cafe-unit-9", "unknown", "unknown"]
    m = spark.createDataFrame([("a", [("Z80", 4.0), ("z80", 4.0)], []), ("b", [("Z80", 4.0)], None)], "slug string, cpu array<struct<n:string,mhz:double>>, audio array<struct<n:string,mhz:double>>")
    assert catalog.chip_index(m).collect()[0].machines == ["a", "a", "b"]  # two spellings in one machine list it twice
    f = spark.createDataFrame([("a", "Storm", None), ("b", "Storm Two", None), ("c", "Dark Storm", None), ("d", "X", "Storm Inc"), ("e", "Y", "Z")], "slug string, full_name string, mfr string")
    assert [(r.slug, r.score) for r in catalog.search_machines(f, "storm").collect()] == [("a", 1000), ("b", 491), ("c", 195), ("d", 50)]


def test_classification_and_parts(spark):
    t = spark.createDataFrame([("Self Test",), ("Fault finding",), ("Test points",), ("Wiring  Diagram",), ("DIP switch",), ("CAUTION",), ("Intro",)], "t string")
    assert [r[0] for r in t.select(extract.classify(F.col("t"))).collect()] == ["self-test", "troubleshooting", "test equipment", "schematic", "dip switches", "safety", None]
    p = spark.createDataFrame([("d", 1, "Item Part No. Description 1 A12-3456 Bolt .- 2 A12-3457 Nut wide 12A 92-047 Cap"), ("d", 2, "1 A12-3456 Bolt 2 A12-3457 Nut")], "doc string, page int, text string")
    assert [(r.item, r.part, r.description) for r in extract.parts_rows(p).orderBy("pos").collect()] == [("1", "A12-3456", "Bolt"), ("2", "A12-3457", "Nut wide"), ("12A", "92-047", "Cap")]
    r = spark.createDataFrame([("d", 1, i, str(i), f"P{i % 7}", "Same") for i in range(8)] + [("e", 1, 0, "1", "P", "Few")], "doc string, page int, pos int, item string, part string, description string")
    assert extract.distinct_parts(r).count() == 7
    s = spark.createDataFrame([("m", "s", "ABO", 90.0), ("m", "s", "AB10,", 60.0), ("m", "s", "RESET", 90.0), ("m", "s", "R12", 90.0), ("m", "s", "HALT", 59.9)], "machine string, sheet string, t string, c double")
    assert rows(extract.signal_index(s).select("signal", "n")) == [("AB0", 1), ("AB10", 1)]
    n = spark.createDataFrame([("LS04",), ("74LS138",), ("S04",), ("74O4",), ("82S129",)], "t string").select(extract.normalise_part(F.col("t")))
    assert [r[0] for r in n.collect()] == ["74LS04", "74LS138", None, "7404", "82S129"]


LINE = "doc string, page int, ord int, t string, x int, y int, h int, c double"


def test_structure(spark):
    body = [("d", p, k, f"plain text line {chr(96 + 5 * p + k)} here", 10, 100 + 30 * k, 20, 90.0) for p in range(1, 5) for k in range(1, 6)]
    heads = [("d", p, 0, f"Manual {p}", 10, 20, 20, 90.0) for p in range(1, 3)]
    l = spark.createDataFrame(body + heads, LINE)
    assert rows(structure.running_headers(l)) == [("d", "manual", 2)]  # on 2 of 4 pages; two of three pages wouldn't do:
    assert structure.running_headers(l.filter("page <= 3")).count() == 0
    h = spark.createDataFrame([("d", 1, 0, "Maintenance", "Maintenance", 1, 10, 100, 40), ("d", 1, 1, "and Repair", "and Repair", 1, 12, 150, 40), ("d", 1, 2, "2. Tools", "2. Tools", 1, 10, 195, 40), ("d", 2, 0, "MAINTENANCE and repair", "x", 1, 10, 100, 40)], "doc string, page int, ord int, t string, raw string, lvl int, x int, y int, h int")
    m = structure.merge_headings(h)
    assert [(x.t, x.parts) for x in m.filter("page = 1").collect()[0].heads] == [("Maintenance and Repair", ["Maintenance", "and Repair"]), ("2. Tools", ["2. Tools"])]
    assert rows(structure.outline(m).select("t", "p")) == [("2. Tools", 1), ("Maintenance and Repair", 1)]
    j = spark.createDataFrame([(["volt-", "age x-", "Y z--", "w"],), ([],)], "a array<string>").select(structure.join_lines(F.col("a")))
    assert [r[0] for r in j.collect()] == ["voltage x- Y z-- w", ""]
    para = spark.createDataFrame([("d", 1, 0, "One", 0, 0, 20, 90.0), ("d", 1, 1, "two", 0, 25, 20, 90.0), ("d", 1, 2, "12", 0, 50, 20, 90.0), ("d", 1, 3, "NOTE: far", 0, 60, 20, 90.0), ("d", 1, 4, "gone", 0, 200, 20, 90.0)], LINE)
    assert [(r.k, r.t) for r in structure.paragraph_blocks(para).orderBy("block").collect()] == [("p", "One two"), ("note", "NOTE: far"), ("p", "gone")]
    assert structure.paragraph_blocks(para.limit(0)).count() == 0


def test_association(spark):
    p = spark.createDataFrame([("g", 1, 0, 0), ("g", 2, 0, 421)], "g string, pid int, x int, y int")
    m = spark.createDataFrame([("g", 7, "B", 210, 210), ("g", 3, "A", -210, 210)], "g string, mid int, label string, x int, y int")
    assert rows(assoc.nearest(p, m, ["g"])) == [("g", 1, "A", 420), ("g", 2, "(unplaced)", None)]
    far = spark.createDataFrame([("g", 1, "A", 421, 0)], "g string, mid int, label string, x int, y int")
    assert rows(assoc.nearest(p.limit(1), far, ["g"])) == [("g", 1, "(unplaced)", None)]
    d = spark.createDataFrame([("g", 1, "A1", 0, 0)], "g string, did int, desig string, x int, y int")
    q = spark.createDataFrame([("g", 1, "up", 0, -9), ("g", 2, "far", 71, 0), ("g", 3, "ok", 70, 70), ("g", 4, "ok2", 70, 70)], "g string, pid int, part string, x int, y int")
    assert rows(assoc.window_nearest(d, q, ["g"])) == [("g", 1, "A1", "ok", 140)]
    v = spark.createDataFrame([("k", "b", 1), ("k", "a", 2), ("k", "a", 3), ("k", "b", 4)], "k string, part string, ord int")
    assert rows(assoc.majority(v, ["k"])) == [("k", "b", 2, 4)]


def test_boards(spark):
    b = spark.createDataFrame([("C10", "x"), ("C4", "x"), ("C4", "x"), ("R1", "y")], "ref string, part string")
    assert rows(board.bom(b)) == [("x", "C10,C4", 2), ("y", "R1", 1)]
    assert board.upsert(b, spark.createDataFrame([("R1", "z")], "ref string, part string"), "ref").filter("part = 'z'").count() == 1
    devices, _ = circuit.device_pins(spark)
    c = spark.createDataFrame([("A", 1, "555"), ("B", 2, "none"), ("Z", 1, "555")], "row string, col int, part string")
    assert rows(board.place_on_grid(c, devices, "AB", col_pitch=2.0, row_pitch=3.0)) == [("UA1", "555", "DIP-8", 0.0, 0.0), ("UB2", "none", "DIP-14", 2.0, 3.0)]
    assert [r.x for r in board.array_positions(spark.createDataFrame([("c", 3), ("d", 0)], "name string, count int"), 2.5).orderBy("i").collect()] == [0.0, 2.5, 5.0]


def test_circuit_rules(spark):
    dev = circuit.device_pins(spark)
    nets = [("U1", "14", "VCC"), ("U1", "7", "n1"), ("U1", "1", "GND"), ("U1", "0", "n2"), ("U1", "x", "n2"), ("U1", "17", "n2"), ("U2", "6", "bus"), ("U3", "8", "bus"), ("U4", "1", "oc"), ("U5", "4", "oc"), ("U6", "1", "q"), ("U7", "3", "n3"), ("U7", "4", "n4"), ("U7", "5", "n5")]
    parts = [("U1", "7400"), ("U2", "7400"), ("U3", "7400"), ("U4", "7433"), ("U5", "7433"), ("U6", "nope"), ("U7", "7400")]
    f = circuit.validate(spark.createDataFrame(nets, "ref string, pin string, net string"), spark.createDataFrame(parts, "ref string, part string"), *dev)
    got = Counter((r.rule, r.severity, r.ref or r.net) for r in f.collect())
    for want in [("supply pin without supply", "error", "U1"), ("signal pin on supply", "warning", "U1"), ("pin outside", "error", "U1"), ("pin is no number", "error", "U1"), ("several outputs", "error", "bus"), ("several outputs", "warning", "oc"), ("no pinout", "warning", "U6"), ("output of the wrong gate", "error", "U7"), ("one pin only", "warning", "q")]:
        assert got[want] >= 1, want
    assert got["pin outside", "error", "U1"] == 2
    assert circuit.verdict(f).collect()[0].errors > 0
    assert len(K.DEVICES) == 20 and all({p for gate in d[5] for side in gate for p in side} <= set(range(1, d[1] + 1)) - {d[2], d[3]} for d in K.DEVICES)


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 101), (None, 5), (200, 200)], "a long, b long")
    got = dict(rows(components(e)))
    assert all(got[i] == 0 for i in range(31)) and got[101] == 100 and got[200] == 200
    assert components(e.limit(0)).count() == 0


def test_files(spark, tmp_path):
    d = tmp_path / "j"
    d.mkdir()
    (d / "a.json").write_text('{"id": "a", "pages": [{"n": 1, "blocks": [{"k": "p", "t": "x"}]}]}')
    (d / "b.json").write_text("{broken")
    ok, n = files.read_json_dir(spark, str(d), files.BODY)
    assert [(r.key, r.pages[0].blocks[0].t) for r in ok.collect()] == [("a", "x")] and n.collect()[0].n == 2
    (tmp_path / "w.tsv").write_text("level\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n5\t1\t1\t1\t1\t10\t5\t20\t8\t90\tA\"b\n5\t1\t1\t1\t2\t40\t4\t10\t9\t80.5\tc\n5\t1\t1\t1\t3\tx\t4\t10\t9\t80\tbad\n4\t1\t1\t1\t0\t0\t0\t0\t0\t-1\t\n")
    l = files.ocr_lines(files.read_ocr_tsv(spark, str(tmp_path / "w.tsv"))).collect()
    assert [(r.t, r.x, r.y, r.w, r.h) for r in l] == [('A"b c', 10, 4, 40, 9)]
    (tmp_path / "b.csv").write_text('Reference,Value,Quantity\n"C1,C2",10u,2\nR1,"a ""b""",0\n')
    assert rows(files.read_bom_csv(spark, str(tmp_path / "b.csv")))[0][1:] == ("10u", 2) and rows(files.read_bom_csv(spark, str(tmp_path / "b.csv")))[1] == (["R1"], 'a "b"', 1)
    (tmp_path / "x.kicad_pcb").write_text('(kicad_pcb\n (footprint "Package:DIP-14"\n  (property "Reference" "UA1")\n  (property "Value" "7400"))\n (footprint "R"\n  (property "Reference" "R1")))')
    assert rows(files.read_board_text(spark, str(tmp_path / "x.kicad_pcb"))) == [("x", "R1", None, "R"), ("x", "UA1", "7400", "Package:DIP-14")]
    a = files.file_audit(spark, str(d)).collect()[0]
    assert a.files == 2 and not a.too_many
    out = files.run_tool(spark.read.format("binaryFile").load(str(d / "*.json")), lambda b: [{"size": len(b)}] if b[:2] == b'{"' else 1 / 0, "size long")
    assert sorted((r["size"] is None, r.error is None) for r in out.collect()) == [(False, True), (True, False)]


def test_resume(spark, tmp_path):
    src, log, cp = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "cp")
    one = spark.sql("SELECT * FROM VALUES (1, timestamp'2020-01-01', 'error', 'boom'), (2, timestamp'2020-01-01', 'view', '') t(event_id, ts, event_type, props)")
    one.write.parquet(src)
    run = lambda: ingest.drain(spark, src, "parquet", "event_id int, ts timestamp, event_type string, props string", ingest.attempts, log, cp)
    run()
    assert rows(ingest.state(spark.read.parquet(log))) == [(1, "failed", "boom"), (2, "done", None)]
    one.filter("event_id = 1").withColumn("event_type", F.lit("view")).write.mode("append").parquet(src)
    run()
    run()
    st_ = ingest.state(spark.read.parquet(log))
    assert rows(st_.select("id", "status")) == [(1, "done"), (2, "done")] and spark.read.parquet(log).count() == 3
    assert ingest.pending(spark.createDataFrame([(1,), (3,)], "id int"), st_).collect()[0].id == 3


def test_headings_and_table_rows_in_blocks(spark):
    """A heading over two lines comes out once, at its first line; table rows stand alone; a repeated heading of a page isn't repeated."""
    l = [("d", 1, 0, "MAIN", 10, 10, 40, 90.0), ("d", 1, 1, "CONTROLS", 10, 55, 40, 90.0), ("d", 1, 2, "the text begins here", 10, 200, 20, 90.0), ("d", 1, 3, "and goes on", 10, 222, 20, 90.0), ("d", 1, 4, "R1   10k   red", 10, 244, 20, 90.0), ("d", 1, 5, "R2   22k   blue", 10, 266, 20, 90.0), ("d", 1, 6, "after the table", 10, 288, 20, 90.0)]
    l += [("d", 1, k, f"more plain text {chr(90 + k)}x", 10, 200 + 22 * k, 20, 90.0) for k in range(20, 30)]
    lines = spark.createDataFrame(l, LINE)
    heads = structure.merge_headings(structure.heading_candidates(lines))
    got = [(r.k, r.t) for r in structure.paragraph_blocks(lines, heads).orderBy("block").collect()]
    assert got[:5] == [("h", "MAIN CONTROLS"), ("p", "the text begins here and goes on"), ("tr", "R1 10k red"), ("tr", "R2 22k blue"), ("p", "after the table")]
    assert [t for k, t in got if k == "h"] == ["MAIN CONTROLS"]
    assert structure.paragraph_blocks(lines.limit(0), heads.limit(0)).count() == 0


def test_reader(spark):
    b = spark.createDataFrame([("x", [(1, [("li", "1. one"), ("li", "- two"), ("p", None), (None, "rest"), ("tr", "a"), ("tr", "b"), ("li", "z")]), (2, None)], [("H", 1, 1)]), ("y", None, None)], "id string, pages array<struct<n:int,blocks:array<struct<k:string,t:string>>>>, outline array<struct<t:string,lvl:int,p:int>>")
    assert [(r.run, r.k, r["items"]) for r in structure.block_runs(b).orderBy("run").collect()] == [(0, "li", ["one", "two"]), (1, "p", ["rest"]), (2, "tr", ["a", "b"]), (3, "li", ["z"])]
    assert rows(structure.contents(b)) == [("x", 0, "Page 1", 1, 1), ("x", 1, "Page 2", 2, 1)] and rows(structure.contents(b, least=2)) == [("x", 0, "H", 1, 1)]
    t = spark.createDataFrame([("a <b> Fly.back fly.BACK flyxback",), (None,)], "t string")
    assert [r[0] for r in t.select(structure.highlight(F.col("t"), "fly.back")).collect()] == ["a &lt;b&gt; <mark>Fly.back</mark> <mark>fly.BACK</mark> flyxback", None]
    assert t.select(structure.highlight(F.col("t"), "f")).first()[0] == "a &lt;b&gt; Fly.back fly.BACK flyxback"
    assert rows(structure.word_counts(spark.createDataFrame([(" a  b\n",), (None,)], "text string"))) == [(" a  b\n", 2), ("", 0)]
    assert rows(structure.needs_structure(b).select("id")) == [("x",), ("y",)] and structure.needs_structure(b, True).count() == 2


def test_machines(spark):
    chip = "array<struct<n:string,mhz:double>>"
    raw = spark.createDataFrame([(1, "", "Café Run", "", None, [("Z80", 1.0), (None, 1.0), ("A", 1.0), ("B", 1.0), ("C", 1.0)], None, None, [("u", None, None), ("", "x", "y"), (None, "x", "y"), ("v", "Drawing Set", "T")]), (2, None, "Cafe run", "1980", "M", None, None, None, None), (3, "m3", None, None, None, None, None, None, [])], f"ord int, id string, name string, y string, m string, cpu {chip}, aud {chip}, dip array<int>, docs array<struct<l:string,t:string,f:string>>")
    m = catalog.normalise_machines(raw)
    assert rows(catalog.machine_index(m)) == sorted([("cafe-run", "Café Run", "", "", 2, 1, 0, ["Z80", "A", "B"]), ("cafe-run-2", "Cafe run", "1980", "M", 0, 0, 0, []), ("m3", "Unknown", "", "", 0, 0, 0, [])], key=repr)
    assert [(r.machine, r.title, r.doc_type, r.schematic, r.place) for r in catalog.flatten_docs(m).orderBy("place").collect()] == [("cafe-run", "", "Document", False, 0), ("cafe-run", "T", "Drawing Set", True, 1)]
    assert catalog.machine_index(catalog.normalise_machines(raw.limit(0))).count() == 0


def test_archive(spark, tmp_path):
    import json

    (tmp_path / "chips.json").write_text(json.dumps([{"board": "b-1", "device": "C4", "part": "7400", "section": "sync"}, {"board": "other", "device": "C4"}]))
    (tmp_path / "power.json").write_text(json.dumps([{"machine": "m", "title": "T", "fuses": {"F1": "2 A"}}]))
    (tmp_path / "related.json").write_text(json.dumps([{"board": "b-1", "name": "B2"}]))
    (tmp_path / "boards.json").write_text(json.dumps([{"slug": "b-2", "name": "Z", "mfr": "A"}, {"slug": "b-1", "name": "A", "mfr": "A"}]))
    a = Archive(spark, DATA, str(tmp_path))
    assert [r.slug for r in a.boards().collect()] == ["b-1", "b-2"] and a.chips("b-1").count() == 1 and a.related("b-1").first().name == "B2" and a.power("m").first().fuses == {"F1": "2 A"}
    assert a.find_chip("b-1", "SYN").first().device == "C4" and a.find_chip("b-1", " ").count() == 0
    plain = Archive(spark, DATA)
    assert plain.boards().count() == plain.chips("b").count() == plain.power("m").count() == 0
    for ask, bad in ((plain.machine, "a b"), (plain.doc, "xyz"), (plain.parts, "0"), (plain.pdf, ""), (plain.chips, "B_1"), (plain.signals, "/"), (plain.signatures, "-"), (plain.related, "x" * 41)):
        with pytest.raises(KeyError):
            ask(bad)
    one = plain._t("doc_bodies").filter("id is not null").first().id
    assert plain.doc(one).count() == 1 and plain.pdf(one).count() == 1 and plain.stats().count() == 1
    m = plain._t("docs").filter("machine is not null").first().machine.strip().lower()
    assert plain.machine(m).count() <= 1 and plain.diagnostics(m).count() >= 0 and plain.signatures(m).count() >= 0 and plain.parts(one).count() >= 0 and plain.chip("Z80").count() <= 1
    found = plain.search("meter between")
    assert found.count() == min(60, found.first().total) and plain.find("meter").count() > 0
    plan = plain.search("meter")._jdf.queryExecution().executedPlan().toString()
    assert "shard" in plan and "PartitionFilters" in plan  # only the shards of the terms are read
    every, some = plain.machines("a"), plain.machines("a", with_docs=True)
    assert every.first().total >= some.first().total >= some.count() or some.count() == 0


def test_more_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"slug": "x", "year": "1980"}, {"slug": "y"}]')
    (tmp_path / "b.json").write_text("{broken")
    assert rows(files.read_json_array(spark, str(tmp_path / "*.json"), files.MACHINE).select("ord", "slug", "year").filter("slug is not null")) == [(0, "x", "1980"), (1, "y", None)]
    for n in (9, 10):
        (tmp_path / f"sheet-{n}.pbm").write_bytes(b"P4\n8 1\n\xf0")
    p = files.read_pages(spark, str(tmp_path / "*.pbm"))
    assert [r.page for r in p.orderBy("page").collect()] == [9, 10] and files.read_pages(spark, str(tmp_path / "*.pbm"), [10]).count() == 1
    svg = spark.createDataFrame([("sheet", 9, '<?xml?><svg a="1"><g fill="#000000"><path d=""/><path d=""/></g></svg>')], "sheet string, page int, text string")
    assert svg.select(files.theme_aware()).first()[0] == '<?xml?><svg a="1"><rect width="100%" height="100%" fill="var(--paper,#fff)"/><g fill="currentColor"><path d=""/><path d=""/></g></svg>'
    assert rows(files.trace_totals(p, svg)) == [("sheet", 1, 8, len(svg.first().text), 2)]
    (tmp_path / "lib.kicad_sym").write_text('(lib\n (symbol "74LS00"\n  (symbol "74LS00_1_1"\n   (pin output line\n (at 0 0)\n (name "Q" (effects)) (number "3" (effects)))\n   (pin power_in line\n (name "VCC") (number "14"))))\n (symbol "7400" (extends "74LS00"))\n (symbol "7401" (extends "7400"))\n (symbol "lost" (extends "none")))')
    got = rows(files.read_symbols(spark, str(tmp_path / "lib.kicad_sym")))
    assert [x for x in got if x[0] == "7401"] == [("7401", "14", "VCC", "power_in"), ("7401", "3", "Q", "output")] and {x[0] for x in got} == {"74LS00", "7400", "7401"}
    b = spark.createDataFrame([(["C1", "C2"], "b", 2), (["R1"], 'a "q"', 1)], "refs array<string>, part string, qty int").withColumn("refs", F.array_join("refs", ","))
    files.write_bom_csv(b, str(tmp_path / "bom"))
    back = files.read_bom_csv(spark, str(tmp_path / "bom"))
    assert rows(back) == [(["C1", "C2"], "b", 2), (["R1"], 'a "q"', 1)]
    files.write_json_by_key(spark.createDataFrame([("k", 1, None), ("l", 2, "x")], "key string, n int, t string"), "key", str(tmp_path / "out"))
    assert rows(spark.read.json(str(tmp_path / "out")).select("key", "n", "t")) == [("k", 1, None), ("l", 2, "x")]
    assert os.path.exists(tmp_path / "out" / "key=k")


def test_supply_and_library(spark):
    devices, gates = circuit.device_pins(spark)
    pads = spark.createDataFrame([("U1", "7490", str(p)) for p in range(1, 15)] + [("C1", "0.1uF", "1"), ("C1", "0.1uF", "2"), ("R1", "0.1uF", "1"), ("U2", None, "1")], "ref string, value string, pin string")
    assert rows(circuit.connect_power(pads, devices)) == [("C1", "1", "+5V"), ("C1", "2", "GND"), ("U1", "10", "GND"), ("U1", "5", "+5V")]
    want = spark.createDataFrame([("n", "U1", "3"), ("n", "U1", "99"), ("n", "U9", "1")], "net string, ref string, pin string")
    assert rows(circuit.connect_signals(want, pads).select("pin", "state")) == [("1", "no footprint"), ("3", "connected"), ("99", "no pad")]
    names = spark.createDataFrame([("7404", "L04"), ("555", "none")], "part string, symbol string")
    sym = spark.createDataFrame([("L04", str(p), {14: "VCC", 7: "GND"}.get(p, "x"), "output" if p in (2, 4, 6, 8, 10) else "input") for p in range(1, 15) if p != 1], "symbol string, pin string, name string, kind string")
    got = {(r.part, r.problem, r.detail) for r in circuit.library_check(devices.filter("part in ('7404', '555', '7400')"), gates, names, sym).collect()}
    assert got == {("7404", "pin not on symbol", "1"), ("7404", "output typed otherwise", "12 input"), ("555", "not checked", None), ("7400", "not checked", None)}


def _unfolded_pads(spark, n):
    """Pads unfolded from their parts: 500 to each, of which the planner knows nothing."""
    return spark.range(n).select(F.concat(F.lit("U"), F.col("id").cast("string")).alias("ref"), F.explode(F.sequence(F.lit(1), F.lit(500)).cast("array<string>")).alias("pin"))


def test_pads_are_not_broadcast(spark):
    pads = _unfolded_pads(spark, 3).unionByName(spark.sql("SELECT * FROM VALUES ('E1', NULL), (NULL, '1'), ('U0', '7'), ('U0', NULL) p(ref, pin)"))
    want = spark.sql("SELECT * FROM VALUES ('n', 'U0', '7'), ('n', 'U0', '500'), ('n', 'U2', '501'), ('n', 'U3', '1'), ('n', 'E1', '1'), ('n', NULL, '1'), ('n', 'U1', NULL), (NULL, 'U1', '1') w(net, ref, pin)")
    got = circuit.connect_signals(want, pads)
    assert rows(got) == sorted([("n", "U0", "7", "connected"), ("n", "U0", "500", "connected"), ("n", "U2", "501", "no pad"), ("n", "U3", "1", "no footprint"), ("n", "E1", "1", "no pad"), ("n", None, "1", "no footprint"), ("n", "U1", None, "no pad"), (None, "U1", "1", "connected")], key=repr)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["signal_nets", "pad_tally"])
def test_signal_nets_have_no_broadcast(spark, name):
    """Pads grow with the parts, the connections with the orders: neither is broadcast, whatever the planner takes them for."""
    assert "Broadcast" not in registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_pad_tally_moves_connections_once(spark, tmp_path):
    """Repeated lines are merged where they met their footprint: besides the footprints' and the tally's own, one shuffle; each pad counts once."""
    lines, parts = spark.read.parquet(f"{DATA}/lineitem.parquet"), spark.read.parquet(f"{DATA}/part.parquet")
    odd = lines.limit(40).withColumn("l_partkey", F.when(F.col("l_orderkey") % 2 == 0, -F.col("l_partkey"))).unionByName(lines.limit(40).withColumn("l_linenumber", F.lit(None).cast("int")))
    lines.unionByName(odd).unionByName(lines).write.parquet(str(tmp_path / "lineitem.parquet"))
    parts.unionByName(parts.limit(2).withColumn("p_partkey", F.lit(None).cast("bigint"))).write.parquet(str(tmp_path / "part.parquet"))
    got = registry.queries()["pad_tally"](spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert rows(got.select("net", "pads", "parts")) == sorted(con.execute(f"SELECT net, pads, parts FROM ({registry.oracle_sql()['pad_tally']})").fetchall(), key=repr)
    assert registry.queries()["pad_tally"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3


def _sheet():
    """A drawing: two solid bodies joined by a bent wire, a crossing, and a round dot."""
    ink = np.zeros((420, 640), bool)
    ink[70:114, 100:144] = ink[190:234, 450:494] = True
    ink[89:92, 147:300] = ink[89:212, 297:300] = ink[209:212, 297:447] = True
    ink[300:303, 50:250] = ink[260:360, 150:153] = True
    yy, xx = np.ogrid[:420, :640]
    ink[(yy - 301) ** 2 + (xx - 501) ** 2 <= 30] = True
    return ink


def test_raster_parts():
    r = random.Random(1)
    mask = np.array([[r.random() < 0.45 for _ in range(40)] for _ in range(30)])
    for diagonal in (False, True):
        lab, boxes = raster.label(mask, diagonal)
        seen, n = np.zeros(mask.shape, int), 0
        for y, x in zip(*np.nonzero(mask)):
            if not seen[y, x]:
                n += 1
                todo = [(y, x)]
                seen[y, x] = n
                while todo:
                    a, b = todo.pop()
                    for i in (-1, 0, 1):
                        for j in (-1, 0, 1):
                            c, e = a + i, b + j
                            if (diagonal or not i or not j) and 0 <= c < 30 and 0 <= e < 40 and mask[c, e] and not seen[c, e]:
                                seen[c, e] = n
                                todo.append((c, e))
        assert (lab == seen).all() and len(boxes) == n
        assert all((y0, x0, y1, x1) == (np.nonzero(seen == k)[0].min(), np.nonzero(seen == k)[1].min(), np.nonzero(seen == k)[0].max() + 1, np.nonzero(seen == k)[1].max() + 1) for k, (y0, x0, y1, x1) in enumerate(boxes, 1))
    brute = np.zeros_like(mask)
    for y in range(30 - 1):
        for x in range(40 - 2):
            if mask[y : y + 2, x : x + 3].all():
                brute[y : y + 2, x : x + 3] = True
    assert (raster.opened(mask, 2, 3) == brute).all() and not raster.opened(mask, 50, 1).any()
    assert raster.numbers([(0, 0, 10, 5), (1, 8, 11, 13), (30, 8, 40, 13), (0, 20, 10, 25), (0, 60, 10, 65)]) == [(0, 0, 11, 25), (30, 8, 40, 13), (0, 60, 10, 65)]


def test_raster_sheet(spark):
    ink = _sheet()
    wires = raster.wire_mask(ink)
    assert wires[150, 298] and wires[90, 298] and not wires[100, 110]  # the bend stays, the body goes
    assert raster.junction_dots(ink) == [(301, 501)]
    pnm = b"P5\n# made\n640 420\n255\n" + np.where(ink, 0, 255).astype(np.uint8).tobytes()
    bits = b"P4 640 420\n" + np.packbits(ink, axis=1).tobytes()
    assert (raster.read_pnm(pnm) == ink).all() and (raster.read_pnm(bits) == ink).all() and (raster.read_pnm(b"P1 2 1 1 0") == [[True, False]]).all() and (raster.read_pnm(b"P2 2 1 4 0 4") == [[True, False]]).all()
    t = raster.trace_sheets(spark.createDataFrame([("s", pnm), ("bad", b"x"), ("none", None)], "sheet string, content binary"), lambda cut: str(cut.shape[0]))
    got = t.collect()
    assert [r.sheet for r in got if r.error] == ["bad"]
    assert len([r for r in got if r.kind == "component"]) == 2 and [tuple(r.box) for r in got if r.kind == "dot"] == [(301, 501)]
    ends = [(r.component, r.net) for r in got if r.kind == "attachment"]
    assert len({c for c, _ in ends}) == 2
    assert raster.net_degree(t).count() == 2
    assert raster.trace_sheets(spark.createDataFrame([], "sheet string, content binary")).count() == 0


def test_pins():
    lab = np.zeros((100, 100), np.int32)
    lab[50, 60:100] = 3
    lab[20, 60:100] = 2
    assert raster.pins([(45, 52, 55, 58), (0, 0, 5, 5)], [(40, 10, 60, 40)], lab, {2, 3}) == [(0, (45, 52, 55, 58), 3, 15)]


def test_tiles(spark):
    b = [("s", 0, 1, 5, 9), ("s", 1, 1, 5, 10), ("s", 0, 2, 9, 9), ("s", 2, 4, 10, 8), ("s", 3, 7, 10, 10), ("s", 3, 8, 19, 10), ("t", 1, 1, 5, 10)]
    got = dict(rows(raster.join_tiles(spark.createDataFrame(b, "sheet string, tile int, net int, y int, x int"))))
    assert got["s/1/1"] == got["s/0/1"] and got["s/0/2"] == got["s/2/4"] == got["s/3/7"] and len(set(got.values())) == 4
