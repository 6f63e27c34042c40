"""Each operator against a brute-force version or an exact property, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

from __future__ import annotations

import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from glyphmill.llm import bpe, hashing, p1_quality as p1, p2_near_dups as p2, p3_boilerplate as p3, p4_split as p4, p5_terms as p5, p6_scan_noise as p6, p7_tokens as p7, p8_mixing as p8, p9_spans as p9

PAGES = "array<struct<n:int,words:int,blocks:array<struct<k:string,t:string>>>>"
BODY = f"id string, pages {PAGES}, outline array<struct<t:string,lvl:int,p:int>>, meta int, ingested_at timestamp, lang string"


def body(id_, *pages, outline=None):
    return (id_, [(i + 1, 5, [("p", t) for t in p] if p is not None else None) for i, p in enumerate(pages)], outline, None, None, "x")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def words(seed, n, vocab=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocab)}" for _ in range(n))


ODD = [body("none", None), body("empty", [], [None, ""]), ("null", None, None, None, None, "x"), body("blank", ["  ", "　"])]
SENT = "When the relay is open, the bearing under the counter must be cleaned until it turns freely by hand."


def test_p1(spark):
    common = spark.createDataFrame([("the", "en"), ("is", "en"), ("der", "de"), (None, "en")], "word string, lang string")
    tables = ["SW1-4 ON OFF | speaker grille 1730 | R97", "32 B20-06488 Linkage rod, temporary 11"] * 8
    long = body("long", [SENT * 5000])
    b = spark.createDataFrame([body("prose", [SENT, SENT.upper()], [SENT.replace(".", "")]), body("table", tables), long, body("prose", [SENT]), *ODD], BODY)
    s = p1.quality_stats(b, common)
    got = {r.id: r for r in s.collect()}
    assert set(got) == {"prose", "table", "long"} and s.count() == 4
    assert got["table"].sentence_share < 0.1 and got["prose"].sentence_share == 1 and got["long"].sentence_share == 1 and got["prose"].lang == "en"
    f = {r.id: r for r in p1.flag_tails(s, limits={"sentence_share": 0.5}).collect()}
    assert "sentence_share" in f["table"].tails and f["table"].pct_sentence_share < f["long"].pct_sentence_share + 1
    assert p1.flag_tails(p1.quality_stats(b.limit(0), common)).count() == 0
    merged = s.unionByName(s).groupBy("lang").agg(F.kll_sketch_agg_double("n_words", 400).alias("k")).select(F.kll_sketch_get_n_double("k").alias("n"))
    assert sum(r.n for r in merged.collect()) == 8


def _jaccard(texts, k=3, least=20):
    sets = {}
    for i, t in texts:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        if len(w) >= least:
            sets[i] = set(zip(*(w[j:] for j in range(k))))
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}


def test_p2(spark):
    r = random.Random(1)
    texts = []
    for g in range(25):
        base = words(g, r.choice([22, 60, 300])).split()
        for v in range(3):
            w = base[:]
            for _ in range(v * len(w) // 40):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            if v == 2:
                w = w[len(w) // 2 :] + w[: len(w) // 2]
            texts.append((f"t{g:02}{v}", " ".join(w)))
    texts += [("copy1", texts[5][1]), ("copy2", texts[5][1].upper().replace(" ", "  ")), ("none", None), ("", ""), ("short", "a b c"), ("long", words(99, 60_000))]
    df = spark.createDataFrame([(a, b, "x") for a, b in texts], "id string, text string, same string")
    links, members = p2.near_duplicates(df, t=0.6, words=3)
    got = {(r.id_a, r.id_b) for r in p2.expand(links, members).collect()}
    assert got == {k for k, s in _jaccard(texts).items() if s >= 0.6} and len(got) > 20
    star = {(r.id_a, r.id_b) for r in p2.expand(links, members, most=1).collect()}
    assert star <= got and ("copy1", "t012") in star | {tuple(sorted(x)) for x in star} and len(star) < len(got)
    empty = p2.near_duplicates(df.limit(0))
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_p2_crowded_keys(spark, monkeypatch):
    """Near copies that share most keys: cut into blocks, each pair comes out once, and the same links are found as without blocks."""
    r = random.Random(6)
    base = words(7, 200).split()
    texts = []
    for i in range(90):
        w = base[:]
        for _ in range(3):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        texts.append((f"t{i:02}", " ".join(w)))
    df = spark.createDataFrame(texts + [(f"u{i}", words(100 + i, 60)) for i in range(10)], "id string, text string")
    exp = {k for k, s in _jaccard(texts, 3).items() if s >= 0.6}
    came = []
    real = p2._hot_pairs
    monkeypatch.setattr(p2, "_hot_pairs", lambda rows, t: came.append(real(rows, t)) or came[-1])
    for hot, block in ((1000, 1000), (20, 1000), (20, 16)):
        monkeypatch.setattr(p2, "HOT", hot), monkeypatch.setattr(p2, "BLOCK", block)
        links, _ = p2.near_duplicates(df, t=0.6, words=3)
        assert {(x.id_x, x.id_y) for x in links.collect()} == exp and len(exp) > 3000
        if hot == 20:
            assert came[-1].count() == came[-1].distinct().count() > 3000


@pytest.mark.parametrize("part", [1000, 7])
def test_copies_keep_their_links(spark, monkeypatch, part):
    """30 copies, 25 of another text and a single one, all linked: every pair across stands, within the large classes those with the representative."""
    monkeypatch.setattr(p2, "PART", part)
    kinds = {**{i: 0 for i in range(30)}, **{i: 30 for i in range(30, 55)}, 55: 55}
    members = spark.createDataFrame([(i, k, {0: 30, 30: 25, 55: 1}[k]) for i, k in kinds.items()], "id long, class_rep long, copies long")
    links = spark.createDataFrame([(0, 30, 0.7), (0, 55, 0.7), (30, 55, 0.9)], "id_x long, id_y long, similarity double")
    exp = {(a, b) for a in kinds for b in kinds if a < b and (kinds[a] != kinds[b] or a == kinds[a])}
    assert rows(p2.expand(links, members)) == sorted(exp, key=repr)


def test_p9_copies_keep_their_links(spark, tmp_path):
    text = words(4, 60)
    spark.createDataFrame([(i, text) for i in range(30)] + [(50, "x" + text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(x) for x in p9.QUERIES["p9_found"](spark, str(tmp_path)).collect()}
    assert got == {(0, i) for i in range(1, 30)} | {(i, 50) for i in range(30)}
    assert rows(p9.QUERIES["p9_copies"](spark, str(tmp_path))) == sorted([(i, 0, 30) for i in range(30)] + [(50, 50, 1)], key=repr)


def test_p9_passages(spark, tmp_path):
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abcd é😀") for _ in range(n))
    one, two = text(850), text(230)
    docs = [(1, "a" + one + "b" + two), (2, one), (3, "é" + two + text(40)), (4, one[:300]), (5, None), (6, one[100:400] * 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(x) for x in p9.QUERIES["p9_passages"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1, 851, True), (2, 0, 850, True), (1, 852, 1082, True), (3, 1, 231, True), (4, 0, 300, False), (6, 0, 300, False), (6, 300, 600, False)}


def test_p2_token_sets_match_python():
    texts = ["Über-Teil 12 KK \x00 a-b_c", "", None, "x" * 100_000 + " y z", "a b c d"]
    sets = p2.token_sets(texts, 3, 3)
    for t, s in zip(texts, sets):
        w = re.findall("[a-z0-9]+", (t or "").lower())
        assert (len(set(zip(w, w[1:], w[2:]))) if len(w) >= 3 else None) == (None if s is None else len(s))


def test_p3(spark):
    line = "Order further copies from your distributor quoting form {} and mention the relay supplement."
    bad = [line, line.replace("further", "furfher"), line.replace("distributor", "distrib@tor").upper(), "  " + line.replace(" ", "  ") + " 7"]
    b = [body(f"d{i}", [SENT + f" unique{chr(97 + i)} text", bad[i % 4].format(i)], ["x"]) for i in range(8)] + [body("solo", [line.format(1)])] + ODD
    docs = [(f"d{i}", " M ") for i in range(8)] + [("d0", "m"), ("d1", None), ("solo", "other"), (None, "m")]
    bodies, d = spark.createDataFrame(b, BODY), spark.createDataFrame(docs, "id string, machine string")
    got = p3.repeated_blocks(bodies, d, min_docs=5)
    assert rows(got) == [(f"d{i}", 1, 0, 1) for i in range(8)]
    clean = {r.id: r for r in p3.without_lines(bodies, got).collect()}
    assert len(clean) == len(b) and len(clean["d3"].pages[0].blocks) == 1 and clean["d3"].dropped == 1 and clean["solo"].dropped == 0 and clean["null"].pages is None and clean["d3"].lang == "x"
    assert p3.repeated_blocks(bodies, d, min_docs=9).count() == 0
    assert p3.repeated_blocks(bodies, d, min_docs=5, min_share=1.1).count() == 0
    assert p3.repeated_blocks(bodies.limit(0), d).count() == 0
    assert [(x.machine, x.docs, x.share) for x in p3.line_report(bodies, d).collect()] == [("m", 8, 1.0)] and p3.line_report(bodies.limit(0), d).count() == 0


def test_p3_every_misprint_meets_its_line(spark):
    """Whatever letter or letter pair is misread, in lines of any length, a half of the line stays that meets the line as meant."""
    base = "abandon bearing counter deliver engines further grounds harness inspect jumpers"
    rows_ = []
    for n in range(len(base) - 30):
        line = base[: 30 + n]
        flat = line.replace(" ", "")
        for k in range(len(flat)):
            rows_ += [(n, flat, flat[:k] + x + flat[k + d :]) for x, d in (("z", 1), ("zz", 1), ("", 1), ("z", 2), ("", 2))]
    df = spark.createDataFrame(rows_, "g int, meant string, letters string")
    keys = lambda c: F.array(*p3._halves(c, F.length(c)))
    n = F.length("letters")
    other = F.when(F.floor((n - 2) / p3.WIDTH) != F.floor(n / p3.WIDTH), n - 2).when(F.floor((n + 2) / p3.WIDTH) != F.floor(n / p3.WIDTH), n + 2)
    probes = F.concat(keys("letters"), F.when(other.isNotNull(), F.array(*p3._halves("letters", other))).otherwise(F.array().cast("array<long>")))
    assert df.filter(~F.arrays_overlap(keys("meant"), probes)).count() == 0


def test_p3_stock_opening(spark, monkeypatch):
    """Lines that share an opening of many letters, but not half of the line, don't meet each other: candidates stay as many as the lines."""
    r = random.Random(9)
    opening = "Please observe before servicing"
    tail = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(9))
    lines_ = [f"{opening} {tail()}" for _ in range(1500)]
    b = [body(f"d{i}", [lines_[i // 2]]) for i in range(3000)]
    made = {}
    real = p3.materialize
    monkeypatch.setattr(p3, "materialize", lambda df, name: made.setdefault(name, real(df, name)))
    got = p3.repeated_blocks(spark.createDataFrame(b, BODY), spark.createDataFrame([(f"d{i}", "m") for i in range(3000)], "id string, machine string"), min_docs=2)
    assert got.count() == 3000 and made["edges"].count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab .\n", min_size=1, max_size=300).filter(str.strip), min_size=1, max_size=12), st.integers(40, 200), st.integers(0, 19))
def test_p4_cut(texts, limit, overlap):
    full = " ".join(texts)
    pieces = p4.cut_text(texts, [0.0] * len(texts), limit, overlap, 2)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(full)
    for (a, b, o), nxt in zip(pieces, pieces[1:] + [None]):
        assert 0 < b - a <= limit and o <= overlap
        if nxt:
            assert nxt[0] == b - nxt[2] and nxt[1] > b


def test_p4_long_body_costs_its_length():
    """The words that move over the gaps are counted, not timed: each unit enters and leaves both windows once."""
    r = random.Random(4)
    units = [Counter(f"w{r.randrange(20_000)}" for _ in range(15)) for _ in range(5000)]
    looked = Counter()

    class Unit(Counter):
        def items(self):
            looked["n"] += len(self)
            return super().items()

    brute = []
    for g in range(len(units) - 1):
        a, b = sum(units[max(0, g - 3) : g + 1], Counter()), sum(units[g + 1 : g + 5], Counter())
        brute.append(sum(n * b[w] for w, n in a.items()) / (sum(n * n for n in a.values()) * sum(n * n for n in b.values())) ** 0.5)
    sims = p4.cohesion([Unit(u) for u in units], 4)
    assert looked["n"] <= 4 * sum(map(len, units)) and sims == pytest.approx(brute)


def test_p4(spark):
    long = "x" * 20_000
    b = spark.createDataFrame([body("fit", ["a" * 2999, "b" * 3000]), body("over", ["a" * 3000, "b" * 3000]), body("wall", [long]), body("topic", *[[f"{w} {w}s about {w} " * 60] for w in ("relay", "screen", "coin", "sound")], outline=[("screen", 1, 2)]), *ODD], BODY)
    p = p4.split_bodies(b).toPandas()
    assert dict(p.groupby("id").size()) | {"wall": 4} == {"fit": 1, "over": 2, "wall": 4, "topic": 2} and p.piece.str.len().max() <= 6000
    assert set(p.id) == {"fit", "over", "wall", "topic"}
    w = p[p.id == "wall"].sort_values("piece_no")
    assert "".join(t[o:] for t, o in zip(w.piece, w.overlap)) == long
    assert p4.split_bodies(b.limit(0)).count() == 0
    with pytest.raises(ValueError):
        p4.split_bodies(b, 100, 60)


def test_p5(spark):
    r = random.Random(3)
    docs = [(f"d{i}", [" ".join(r.choice(["common", "aa", "x12y", f"t{i:03}x", "Mid", "9"]) for _ in range(30)), None]) for i in range(300)] + [("n", None), (None, ["lost"]), ("e", []), ("long", ["word " * 100_000])]
    df = spark.createDataFrame([(a, b, "x") for a, b in docs], "id string, t array<string>, term string")
    exp, seen = Counter(), defaultdict(set)
    for i, ts in docs:
        for t in ts or [] if i else []:
            for w in re.findall(p5.TERM, (t or "").lower()):
                exp[w] += 1
                seen[w].add(i)
    post = spark.createDataFrame([("c", " COMMON ", "zz", 5), ("c", "common", "zz", None), ("c", None, "zz", 1), ("c", "common", "d1", 1)], "shard string, token string, doc_id string, cnt int")
    exp["common"] += 5
    seen["common"].add("zz")
    counts = p5.term_counts(p5.term_pairs(df).unionByName(p5.posting_pairs(post)), 7)
    got = {x.token: (x.n, x.docs, x.mark) for x in p5.mark_terms(counts).select(F.col("term").alias("token"), "n", "docs", "mark").collect()}
    total = len(set().union(*seen.values()))  # a document of postings alone holds a term as well
    assert {k: v[:2] for k, v in got.items()} == {w: (exp[w], len(seen[w])) for w in exp}
    assert all(v[2] == ("rare" if v[1] < 3 else "common" if v[1] > 0.4 * total else None) for v in got.values())
    assert p5.term_counts(p5.term_pairs(df.limit(0))).count() == 0
    alone = p5.mark_terms(p5.term_counts(p5.term_pairs(df.limit(0)).unionByName(p5.posting_pairs(post))))
    assert rows(alone.select("term", "n", "docs", "mark")) == [("common", 6, 2, "rare")]


def test_p6_lines():
    for t in ("12", "[42]", "- 48 -", "Page 12", "xii", "3-58", "4-l2", "l3", "Page 3O", "[2S]"):
        assert p6.is_page_number(t), t
    for t in ("GND", "R128", "the insert.", "SW1-4", "+5V", "", "Page one", "IC 4A and more"):
        assert not p6.is_page_number(t), t
    assert p6.header_key("Jorgano Quest K17-12873  4") == p6.header_key("JORGAN0 QUEST K17-12873") == p6.header_key("jorgano quesf")


def test_p6(spark):
    good = ["When the relay is open the bearing under the counter must be cleaned", "Before moving the cabinet connect the meter between the connector and the bearing", "One cross-hatch pattern on the monitor shows the bearing near the counter"]
    scan = [("m", "big", p, k, t) for p in range(1, 60) for k, t in enumerate(good)]
    doc = []
    for p in range(1, 5):
        doc += [("m", "s", p, 0, f"Jorgano Quest {p}"), ("m", "s", p, 1, f"{good[p % 3]} {'relay meter counter fan'.split()[p - 1]}"), ("m", "s", p, 2, "the bcaring near the con-" if p == 2 else good[0]), ("m", "s", p, 3, "nector and the cross-" if p == 2 else good[1]), ("m", "s", p, 4, "hatch pattern" if p == 2 else f"{'monitor cabinet open hatch'.split()[p - 1]} {good[2]}"), ("m", "s", p, 5, f"- {p + 20} -")]
    ocr = spark.createDataFrame([(a, b, c, d, t, None, "x") for a, b, c, d, t in scan + doc + doc[:5] + [("m", None, 1, 1, "x"), (None, "s", 1, 9, None), ("m", "s", 1, 10, "  ")]], "machine string, doc_id string, page int, ord int, t string, c double, origin string")
    bodies = spark.createDataFrame([body("b", [SENT, "As soon as the fan stops the bear‐ ing must be cleaned and the counter connected until the relay is open"]), *ODD], BODY)
    lines = p6.lines_table(bodies, ocr)
    assert {r.doc_id for r in lines.collect()} == {"big", "s", "b"}
    counts = p6.Counts(p6.corpus_counts(lines))
    assert counts.word("bearing") == pytest.approx(sum(t.lower().count("bearing") for *_, t in scan + doc), rel=0.1)
    one = next(r for r in lines.collect() if r.doc_id == "s")
    found, fixed = p6.faults([x.page for x in one.l], [x.pos for x in one.l], [x.t for x in one.l], counts)
    got = {(one.l[k].page, one.l[k].pos, f) for k, f in found}
    assert {(p, 0, "header") for p in range(1, 5)} | {(p, 5, "page_number") for p in range(1, 5)} | {(2, 2, "misread"), (2, 2, "hyphen")} == got
    assert any("the bearing near the connector" in t for t in fixed.values())
    b = next(r for r in lines.collect() if r.doc_id == "b")
    assert p6.faults([1, 1], [0, 1], [x.t for x in b.l], counts)[0] == [(1, "hyphen")]
    assert p6.corpus_counts(lines.limit(0)).sum() == 0
    cut = ["When the relay is open the bear-", "ing must be cleaned", "The counter must be cleaned"]
    assert [r[2:] for r in p6._paragraphs("doc_bodies", "d", [1, 1, 2], [0, 1, 0], cut, counts)] == [(1, 0, "When the relay is open the bearing must be cleaned"), (2, 0, cut[2])]
    assert p6._paragraphs("doc_bodies", "d", [], [], [], counts) == []


def _scaled(texts, by):
    """Counts of a corpus ``by`` times ``texts``."""
    w, q = Counter(), Counter()
    for t in texts:
        x = p6.words_of(t)
        w.update(x), q.update(zip(x, x[1:]))
    counts = p6.Counts(_corpus({k: n * by for k, n in w.items()}, {k: n * by for k, n in q.items()}))
    return counts


def _corpus(w, q):
    """Corpus counts as the operator sends them: what is below the floor stays behind."""
    floor = p6.floor_of(sum(w.values()))
    tables = []
    for pair, n in ((False, w), (True, {"\0".join(k): v for k, v in q.items()})):
        n = {k: v for k, v in n.items() if v >= floor}
        tables.append(p6.pack(p6._hashes(list(n), 3 if pair else 1), np.array([*n.values()], np.int64), pair))
    return p6.Corpus(*tables, sum(w.values()))


def test_p6_counted(spark, monkeypatch):
    r = random.Random(11)
    docs = [[" ".join(r.choice(["the", "cross-hatch", "c0in", "Über", "a"]) for _ in range(r.randrange(0, 9))) for _ in range(4)] for _ in range(60)]
    words_, pairs = Counter(), Counter()
    for d in docs:
        w = p6.words_of("\n".join(d))
        words_.update(w), pairs.update(zip(w, w[1:]))
    df = spark.createDataFrame([("x", str(i), [(1, k, t) for k, t in enumerate(d)]) for i, d in enumerate(docs)], "origin string, doc_id string, l array<struct<page:int,pos:int,t:string>>")
    for flush in (p6.FLUSH_WORDS, 20):
        monkeypatch.setattr(p6, "FLUSH_WORDS", flush)
        got = p6.counted(df).collect()
        assert {x.w: x.n for x in got if x.w is not None} == words_
        assert {x.h: x.n for x in got if x.w is None} == {int(p6._hashes(["\0".join(k)], 3).view(np.int64)[0]): n for k, n in pairs.items()}


def test_p6_counts_of_many_words():
    """Half a million words and pairs: the counts are those given, and forms that don't occur read as none."""
    w = {f"w{i}": 1 + i % 7 for i in range(500_000)} | {"the": 10**7}
    counts = p6.Counts(_corpus(w, {(f"w{i}", f"w{i + 1}"): 1 + i % 7 for i in range(500_000)} | {("of", "the"): 10**6}))
    assert all(counts.word(k) == w[k] for k in [*list(w)[::50], "the"]) and not any(counts.word(f"x{i}") for i in range(20_000))
    assert all(counts.pair(f"w{i}", f"w{i + 1}") == pytest.approx(1 + i % 7, rel=0.1) for i in range(0, 500_000, 50)) and counts.pair("of", "the") == pytest.approx(1e6, rel=0.05)
    assert sum(counts.pair(f"w{i}", "x") > 0 for i in range(20_000)) < 20


@pytest.mark.parametrize("by", [1, 100, 3000, 1_000_000])
def test_p6_any_size(by):
    """A misread form grows with the corpus as its word does, and parts of words with them."""
    good = "when the relay is open the bearing under the counter must be cleaned"
    counts = _scaled([good] * 100_000 + ["when the relay is open the bcaring under the counter must be cleaned"] * 30 + ["turn bo@rd over"] * 3 + ["qued rast"] * 5, by)
    lines = ["when the relay is open the bcaring under the counter", "the counter under the bo@rd must be cleaned", "the relay is qued-rast open"]
    found, fixed = p6.faults([1] * 3, [0, 1, 2], lines, counts)
    assert found == [(0, "misread"), (1, "misread"), (2, "hyphen")] and "bearing" in fixed[0] and "the board must" in fixed[1]
    assert len(counts.words[2]) <= p6.RESOLUTION


def test_p6_bounded_by_resolution(monkeypatch):
    """However many words a corpus has, no more than RESOLUTION are sent: rarer ones stay behind."""
    monkeypatch.setattr(p6, "RESOLUTION", 1000)
    c = _corpus({f"w{i}": 1 + i % 50 for i in range(5000)} | {"often": 10**4}, {})
    assert 0 < len(p6.Counts(c).words[2]) <= 1000 and p6.Counts(c).word("often") == 10**4


@pytest.mark.parametrize("query", [p6.p6_found, p6.p6_paragraphs])
def test_p6_rare_words_count_at_any_size(spark, monkeypatch, query):
    """However few words and pairs are sent to the tasks, the result is the same: each document gets the counts of the others that it asks for."""
    whole = rows(query(spark, "/root/testdata/sf0.001"))
    monkeypatch.setattr(p6, "RESOLUTION", 300)
    monkeypatch.setattr(p6, "SENT", 300, raising=False)
    assert whole and rows(query(spark, "/root/testdata/sf0.001")) == whole


def test_p6_rare_words_in_a_large_corpus():
    """What a word seen sixty times and its misprint seen once say doesn't depend on how much else the corpus holds."""
    line = "the bcaring and the cali-brator"
    for rest in (10**3, 10**6, 10**9, 10**12):
        counts = p6.Counts(_corpus({"the": rest, "and": rest}, {}))
        counts.partly, counts.rare = True, {int(h): n for w, n in (("bearing", 60), ("bcaring", 1), ("calibrator", 2), ("cali-brator", 1), ("over-load", 3), ("overload", 1)) for h in p6._hashes([w], 1)} | {int(p6._hashes(["the\0bearing"], 3)[0]): 60}
        found, fixed = p6.faults([1, 1], [0, 1], [line, "over-load"], counts)
        assert fixed == {0: "the bearing and the calibrator", 1: "over-load"} and found == [(0, "hyphen"), (0, "misread")], rest


def test_p6_confusion_rates(spark):
    """A confusion that happens more often than others is the more probable, within SPREAD of the mean."""
    words = {"meter": 10_000, "mcter": 150, "motor": 10_000, "mofor": 2, "m0tor": 1, "relay": 10_000, "rclay": 160, "rare": 3, "rarc": 1}
    df = spark.createDataFrame(list(words.items()), "w string, n long")
    got = p6.confusion_rates(df, 1.0)
    assert got["e", "c"] > p6.RATE > got["t", "f"] == pytest.approx(p6.RATE / p6.SPREAD) and max(got.values()) <= p6.RATE * p6.SPREAD
    assert p6.confusion_rates(df.limit(0), 1.0) == {}


def test_p6_long_footer():
    note = "This notice stands at the foot of every page and is long: " + "keep the cabinet closed and dry while the relay is open, " * 3 + "page"
    page = [p for p in range(1, 5) for _ in range(2)]
    found, fixed = p6.faults(page, [0, 1] * 4, [x for p in range(1, 5) for x in (f"{'relay meter counter fan'.split()[p - 1]} text", f"{note} {p}")], _scaled([note] * 1000, 1))
    assert found == [(k, "header") for k in (1, 3, 5, 7)] and set(fixed) == {0, 2, 4, 6}


def test_p6_fixes_and_joins_in_one_text():
    counts = _scaled(["when the relay is open the bearing under the counter must be cleaned"] * 1000, 1)
    found, fixed = p6.faults([1], [0], ["When the re- lay is open the bcaring under the coun-ter must bc cleaned"], counts)
    assert found == [(0, "hyphen"), (0, "misread")] and fixed[0] == "When the relay is open the bearing under the counter must be cleaned"


VOCAB = bpe.vocabulary()


@pytest.mark.skipif(not os.path.exists(VOCAB), reason="vocabulary file not there")
def test_p7(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(VOCAB)
    tok.encode_special_tokens = True
    texts = ["", None, " ", "a" * 3001, "\r\n\t  x", "<|endoftext|> hi", "naïve Ünïcode 日本語 🎛️", "don't WE'LL 12345", " " * 5000 + "x", SENT, SENT, "\u0000 ", "abababab" * 50]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    got = {r.doc_id: r.ids for r in p7.encode(df).collect()}
    assert got == {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert [r.n_tokens for r in p7.encode(df, only_count=True).orderBy("doc_id").collect()] == [len(got[i]) for i in range(len(texts))]
    assert p7.encode(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists(VOCAB), reason="vocabulary file not there")
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_p7_any_text(texts):
    from tokenizers import Tokenizer

    tok = _tok.setdefault("t", Tokenizer.from_file(VOCAB))
    tok.encode_special_tokens = True
    flat, ends = bpe.load(VOCAB).encode(texts)
    assert [x.tolist() for x in np.split(flat, ends[:-1])] == [tok.encode(t, add_special_tokens=False).ids for t in texts] if texts else len(flat) == 0


_tok: dict = {}


def test_p8(spark):
    r = random.Random(5)
    docs = [(i, r.choice(["big", "Big ", "BIG", "small_one" if i % 20 == 0 else "big", None]), r.randrange(0, 200), "x") for i in range(4000)] + [(None, "big", 5, "x"), (9999, "untargeted", 5, "x")]
    d = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long, place string")
    t = spark.sql("SELECT * FROM VALUES ('big', 0.9D, 1, timestamp'2020-01-01'), ('big', 0.7D, 1, timestamp'2021-01-01'), ('big', 0.7D, 1, timestamp'2021-01-01'), ('Small-One', 0.3D, 4, timestamp'2021-01-01'), ('gone', 0.1D, 2, timestamp'2021-01-01') t(source, target_share, max_repeats, set_at)")
    sel, shares = p8.mix_sources(d, t)
    s = {r.source: r for r in shares.collect()}
    assert s["gone"].tokens == 0 and abs(s["big"].actual_share - 0.7) < 0.02 and abs(s["small-one"].actual_share - 0.3) < 0.02
    n = Counter((r.doc_id, r.source) for r in sel.collect())
    assert max(v for (_, src), v in n.items() if src == "big") == 1 and max(v for (_, src), v in n.items() if src == "small-one") <= 4
    assert rows(sel) == rows(p8.mix_sources(d, t)[0])  # seeded
    places = [r.place for r in sel.collect()]
    assert places == sorted(places)
    assert p8.mix_sources(d.limit(0), t)[0].count() == 0 and p8.mix_sources(d, t.limit(0))[1].count() == 0


def test_p8_superseded_targets(spark):
    t = spark.sql("SELECT * FROM VALUES ('a', 0.9D, 1, timestamp'2020-01-01'), ('a', 0.0D, 1, timestamp'2021-01-01'), ('b', 0.5D, 2, timestamp'2020-01-01'), ('b', 0.6D, 0, timestamp'2021-01-01'), ('c', 1.0D, 2, NULL), (NULL, 1.0D, 2, NULL) t(source, target_share, max_repeats, set_at)")
    assert rows(p8.current_targets(t)) == [("c", 1.0, 2)]


@pytest.mark.parametrize("rate,cap", [(0.2, 1), (0.9, 1), (1.7, 2), (3.0, 4), (0.5, 4)])
def test_p8_distribution(rate, cap):
    u = (np.arange(200_000) + 0.5) / 200_000
    assert abs(sum((u >= s).mean() for s in p8.steps(rate, cap)) - rate) < 1e-3


def test_p9(spark):
    r = random.Random(2)
    text = lambda n: "".join(r.choice("abcd é😀") for _ in range(n))
    shared = [text(200), text(199), text(850), "z" * 400]
    docs = [(i, text(r.randrange(0, 400)) + (shared[i % 5] if i % 5 < 4 else "") + text(r.randrange(0, 300))) for i in range(25)] + [(100, None), (101, ""), (102, shared[2]), (103, shared[2]), (104, text(150_000)), (105, text(300) * 2), (None, shared[2])]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, doc int")
    occ = defaultdict(set)
    for i, t in docs:
        if i is not None:
            for k in range(len(t or "") - 199):
                occ[t[k : k + 200]].add(i)
    exp = {(a, b) for s in occ.values() if len(s) > 1 for a in s for b in s if a < b}
    assert {tuple(x) for x in p9.span_pairs(p9.candidates(df)).collect()} == exp and exp
    assert rows(p9.document_pairs(df)) == sorted(exp, key=repr)
    many = spark.createDataFrame([(i, shared[2]) for i in range(30)] + [(50, "x" + shared[2])], "doc_id long, text string")
    assert {tuple(x) for x in p9.document_pairs(many).collect()} == {(0, i) for i in range(1, 30)} | {(0, 50)}
    assert p9.document_pairs(df.limit(0)).count() == 0
    cover = {}
    for i, t in docs:
        if i is not None:
            cover[i] = len({c for k in range(len(t or "") - 199) if len(occ[t[k : k + 200]]) > 1 for c in range(k, k + 200)})
    got = {x.doc_id: x for x in p9.shared_chars(df).collect()}
    assert {i: got[i].shared_chars for i in cover} == cover and got[102].longest == 800 and got[105].longest == 0
    assert p9.span_pairs(p9.candidates(df.limit(0))).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 12))
def test_windows_and_winnowing(x, n):
    a = np.array(x, np.uint32)
    h = hashing.Rolling(a).windows(n)
    assert len(h) == max(0, len(x) - n + 1)
    same = defaultdict(set)
    for k in range(len(h)):
        same[tuple(x[k : k + n])].add(int(h[k]))
    assert all(len(v) == 1 for v in same.values()) and len({v for s in same.values() for v in s}) == len(same)
    for w in (1, 3, 7):
        keep = set(hashing.winnow(h, w).tolist())
        assert all(keep & set(range(k, k + w)) for k in range(len(h) - w + 1))
