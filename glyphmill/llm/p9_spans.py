"""Problem 9: spans of at least a given length that stand verbatim in more than one document.

Level-wise doubling. A level takes windows of one length; those that repeat in another document survive, and only where one survived
are windows of twice the length tried. Below the least length sought the windows are thinned: winnowing picks windows by content so that any span
of the least length has one picked at the same place in each copy (about 2 in every ``span`` - ``length`` characters). From the least length
on every place counts, and the lengths go on doubling until no candidate is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialize
from ..sources.tables import small_or_plain, table
from .hashing import U, Rolling, mix, winnow
from .p2_near_dups import expand
from .p7_tokens import _steps

SPAN = 200


def _symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after another, and the ends."""
    raw = [t.encode("utf-32-le", "surrogatepass") if t else b"" for t in texts]
    ends = np.cumsum([len(r) // 4 for r in raw])
    return np.frombuffer(b"".join(raw), np.uint32), ends


def _level(df: DataFrame, length: int, pick: int = 1, before: bool = False) -> DataFrame:
    """(h, doc, pos) of windows of ``length`` characters in the areas of each document, thinned to one in ``pick`` neighbours. With ``before`` also ``prev``, the hash of the
    window one place before; at the start of a text it is one of the document's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, col = batch.column("doc").to_numpy(), batch.column("text")
            for a, b in _steps(col):
                sym, ends = _symbols(col.slice(a, b - a).to_pylist())
                roll = Rolling(sym)
                h, doc, pos, prev = [], [], [], []
                for k, (end, size) in enumerate(zip(ends, np.diff(np.append(0, ends)))):
                    base = end - size
                    for lo, hi in areas_of(batch, a + k, int(size)):
                        if hi - lo < length:
                            continue
                        early = int(before and lo > 0)
                        at = np.arange(base + lo - early, base + hi - length + 1)
                        w = roll.at(at, at + length)
                        if before:
                            own = mix(np.array([docs[a + k]]).astype(np.int64).view(np.uint64) ^ U(0x5851F42D4C957F2D))
                            prev.append(w[:-1] if early else np.concatenate([own, w[:-1]]))
                            at, w = at[early:], w[early:]
                        if pick > 1:
                            keep = winnow(w, pick)
                            at, w = at[keep], w[keep]
                        h.append(w), pos.append(at - base), doc.append(np.full(len(w), docs[a + k]))
                if h:
                    made = [pa.array(np.concatenate(h).view(np.int64)), pa.array(np.concatenate(doc)), pa.array(np.concatenate(pos).astype(np.int32))]
                    if before:
                        made.append(pa.array(np.concatenate(prev).view(np.int64)))
                    yield pa.RecordBatch.from_arrays(made, names=["h", "doc", "pos", "prev"][: len(made)])

    def areas_of(batch: pa.RecordBatch, k: int, size: int) -> np.ndarray:
        if "areas" not in batch.schema.names:
            return np.array([[0, size]])
        return np.asarray(batch.column("areas")[k].as_py(), np.int64).reshape(-1, 2)

    return df.mapInArrow(run, "h long, doc long, pos int" + ", prev long" * before)


def _repeated(windows: DataFrame) -> DataFrame:
    """The windows whose hash stands in more than one document. The documents of a hash are never gathered: their least and greatest tell."""
    hot = windows.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("h")
    return windows.join(hot, "h", "left_semi")


def _areas_around(hits: DataFrame, left: int, right: int) -> DataFrame:
    """Per document the merged areas [pos - left, pos + right) around its surviving windows, as a flat array of starts and ends."""
    spots = hits.groupBy("doc").agg(F.array_sort(F.collect_set("pos")).alias("p"))  # places of one document: no more than it has characters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p in batch.column("p").to_pylist():
                p = np.asarray(p, np.int64)
                cut = np.flatnonzero(np.diff(p) > left + right)
                start, end = p[np.append(0, cut + 1)] - left, p[np.append(cut, len(p) - 1)] + right
                out.append(np.stack([start, end], 1).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(out, pa.list_(pa.int64()))], names=["doc", "areas"])

    return spots.mapInArrow(run, "doc long, areas array<long>")


def _clip(df: DataFrame) -> DataFrame:
    """Areas cut to the text."""
    n = F.length("text").cast("long")
    return df.withColumn("areas", F.transform("areas", lambda x: F.greatest(F.lit(0).cast("long"), F.least(x, n))))


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, first: int | None = None) -> DataFrame:
    """(doc, text, areas): the texts that may share a run of ``span`` characters, and the areas in which such runs must lie, by the levels below ``span``.

    ``first`` is the length of the first level, by default ``span`` / 2. Null keys, null texts and texts shorter than ``span`` are left out. Keys are bigint.
    """
    first = first or max(1, span // 2)
    src = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).filter(F.col("doc").isNotNull() & (F.length("text") >= span))
    length, area = first, src
    while length < span:
        # a run of ``span`` characters holds one of the windows picked, so it begins at most span - length before that one
        hits = _repeated(materialize(_level(area, length, span - length + 1), f"level{length}"))
        area = _clip(src.join(_areas_around(hits, span - length, span), "doc"))
        length = min(2 * length, span)
    return materialize(area, "candidates")


def shared_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, first: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(windows of ``span`` characters that stand in several documents: h, doc, pos; the documents' texts that may hold such: doc, text, areas).

    Runs must lie in different keys; a passage repeated within one text alone doesn't count.
    """
    area = candidates(docs, key, text, span, first)
    return materialize(_repeated(materialize(_level(area, span), "windows")), "shared"), area


def _runs(windows: DataFrame) -> DataFrame:
    """(doc, s, e): maximal rows of following places of one document; e is the last place."""
    w = windows.groupBy("doc").agg(F.array_sort(F.collect_set("pos")).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, s, e = [], [], []
            for d, p in zip(batch.column("doc").to_pylist(), batch.column("p").to_pylist()):
                p = np.asarray(p, np.int64)
                cut = np.flatnonzero(np.diff(p) > 1)
                a, b = p[np.append(0, cut + 1)], p[np.append(cut, len(p) - 1)]
                doc += [d] * len(a)
                s += a.tolist()
                e += b.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(s, pa.int64()), pa.array(e, pa.int64())], names=["doc", "s", "e"])

    return w.mapInArrow(run, "doc long, s long, e long")


def span_pairs(area: DataFrame, span: int = SPAN) -> DataFrame:
    """Distinct (doc_id_a, doc_id_b) of documents of ``candidates`` with a common run of ``span`` characters.

    Only the first window of each common run makes a pair: of two documents with one window, those whose windows one place before are equal too have met
    there. So windows whose copies all follow the same window are left out before the join, and what meets in it is compared by a second hash of its text.
    """
    windows = materialize(_level(area, span, before=True), "windows")
    g = windows.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.min("prev").alias("x"), F.max("prev").alias("y"))
    starts = windows.join(g.filter("a < b and x <> y").select("h"), "h", "left_semi")
    piece = F.substring("text", F.col("pos") + 1, F.lit(span))
    w = materialize(starts.join(area.select("doc", "text"), "doc").select("h", F.xxhash64(piece).alias("h2"), "doc", "prev").distinct(), "starts")
    a, b = w.select("h", "h2", F.col("doc").alias("doc_id_a"), F.col("prev").alias("pa")), w.select("h", "h2", F.col("doc").alias("doc_id_b"), F.col("prev").alias("pb"))
    return a.join(b, ["h", "h2"]).filter("doc_id_a < doc_id_b and pa <> pb").select("doc_id_a", "doc_id_b").distinct()


def shared_chars(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """Every document once: (doc_id, n_chars, shared_chars, longest): how many of its characters lie in spans of at least ``span``
    characters that stand in another document too, and the length of the longest window level that still had a copy elsewhere.

    ``longest`` is the longest of ``span``, 2 ``span``, 4 ``span`` ... of which a window of the document is repeated elsewhere, 0 without any. Null texts have 0.
    """
    windows, area = shared_windows(docs, key, text, span)
    runs = _runs(windows)
    cover = runs.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("r"))
    covered = F.aggregate("r", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("to")), lambda acc, r: F.struct(
        (acc["n"] + F.greatest(F.lit(0).cast("long"), r["e"] + span - F.greatest(r["s"], acc["to"]))).alias("n"), F.greatest(acc["to"], r["e"] + span).alias("to")), lambda acc: acc["n"])
    levels = windows.select("doc").distinct().select("doc", F.lit(span).alias("level"))
    longest, length = levels, span
    while True:  # windows of twice the length where windows of this length survived, until none survives
        length *= 2
        ranges = runs.filter(F.col("e") - F.col("s") + span >= length).groupBy("doc").agg(F.flatten(F.sort_array(F.collect_list(F.array("s", (F.col("e") + span))))).alias("areas"))
        hits = materialize(_repeated(materialize(_level(_clip(area.drop("areas").join(ranges, "doc")), length), "windows")), "shared")
        if hits.isEmpty():
            break
        longest = longest.unionByName(hits.select("doc").distinct().select("doc", F.lit(length).alias("level")))
        runs = _runs(hits).select("doc", "s", (F.col("e") + (length - span)).alias("e"))
    longest = longest.groupBy("doc").agg(F.max("level").alias("longest"))
    ids = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.length(text), F.lit(0)).alias("n_chars"))
    out = ids.join(cover.select("doc", covered.alias("shared_chars")), "doc", "left").join(longest, "doc", "left")
    return out.select(F.col("doc").alias("doc_id"), "n_chars", F.coalesce("shared_chars", F.lit(0).cast("long")).alias("shared_chars"), F.coalesce("longest", F.lit(0)).alias("longest"))


def shared_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """(doc_id, start, end, whole): the places [start, end) of each document, in code points, whose every window of ``span`` characters stands in another document too.

    Windows that follow place by place are one span; spans may overlap, and the characters they cover are the ``shared_chars`` of the document. ``whole`` tells
    that the span is one verbatim run: it stands as a whole as a span of another document. Otherwise its parts are repeated in different documents, or inside a longer span.
    """
    windows, area = shared_windows(docs, key, text, span)
    runs = materialize(_runs(windows).select("doc", F.col("s").alias("start"), (F.col("e") + span).alias("end")), "runs")
    piece = F.substring("text", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    cut = runs.join(area.select("doc", "text"), "doc").select("doc", "start", "end", F.xxhash64(piece).alias("h1"), F.xxhash64(piece, F.lit(1)).alias("h2"))
    cut = materialize(cut.withColumn("n", F.col("end") - F.col("start")), "cut")
    twice = cut.groupBy("n", "h1", "h2").agg((F.min("doc") < F.max("doc")).alias("whole"))
    return cut.join(twice, ["n", "h1", "h2"]).select(F.col("doc").alias("doc_id"), "start", "end", "whole")


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """(id, class_rep, copies) of the documents of ``span`` characters or more: documents of one whole text share the representative (the least key)."""
    h = docs.filter(F.col(key).isNotNull() & (F.length(text) >= span)).select(F.col(key).cast("long").alias("id"), F.length(text).alias("n"), F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2")).distinct()
    g = h.groupBy("n", "h1", "h2").agg(F.min("id").alias("class_rep"), F.count(F.lit(1)).alias("copies"))
    return h.join(g, ["n", "h1", "h2"]).select("id", "class_rep", "copies")


def document_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, every: bool = False) -> DataFrame:
    """Distinct (doc_id_a, doc_id_b) of documents with a common run of ``span`` characters. Whole copies of one text take part once; they are expanded as in
    problem 2: into all pairs for up to 20 copies, else each copy is paired with its representative. With ``every``, each copy has the pairs of its text with
    other texts, whatever the copies; without, the representative of over 20 copies stands for them there. Keys are unique bigints."""
    members = materialize(copies(docs, key, text, span), "copies")
    others = small_or_plain(members.filter("id <> class_rep").select(F.col("id").alias(key)))
    links = span_pairs(candidates(docs.join(others, key, "left_anti"), key, text, span), span).toDF("id_x", "id_y")
    return expand(materialize(links, "links"), members, every=every).toDF("doc_id_a", "doc_id_b")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_pairs(table(spark, sf_dir, "documents"), every=True)


def p9_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, class_rep, copies): with it the pairs that p9_found leaves out within one text of more than 20 copies are known."""
    return copies(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def p9_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_chars(table(spark, sf_dir, "documents"))


def p9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(table(spark, sf_dir, "documents"))


QUERIES = {"p9_passages": p9_passages, "p9_found": p9_found, "p9_copies": p9_copies, "p9_shared": p9_shared}
_SQL = f"""WITH d AS (SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= {SPAN}),
w AS (SELECT doc_id, i, substr(text, i, {SPAN}) AS w FROM (SELECT doc_id, text, unnest(range(1, length(text) - {SPAN - 2})) AS i FROM d)),
hot AS (SELECT w FROM w GROUP BY w HAVING min(doc_id) < max(doc_id)), s AS (SELECT doc_id, i, w FROM w SEMI JOIN hot USING (w))"""
SQL = {
    "p9_found": _SQL + " SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM s a JOIN s b ON a.w = b.w AND a.doc_id < b.doc_id",
    "p9_copies": f"SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_rep, count(*) OVER (PARTITION BY text) AS copies FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= {SPAN})",
    "p9_shared": _SQL + f""", c AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT doc_id, least({SPAN}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {SPAN})) AS n FROM s) GROUP BY doc_id),
v AS (SELECT doc_id, level, hash(substr(text, i, level)) AS h FROM (SELECT doc_id, text, level, unnest(range(1, length(text) - level + 2)) AS i FROM d, (SELECT unnest([{", ".join(str(SPAN << k) for k in range(8))}]) AS level) WHERE doc_id IN (SELECT doc_id FROM c) AND length(text) >= level)),
t AS (SELECT doc_id, CAST(max(level) AS INTEGER) AS longest FROM v SEMI JOIN (SELECT level, h FROM v GROUP BY level, h HAVING min(doc_id) < max(doc_id)) x USING (level, h) GROUP BY doc_id)
SELECT documents.doc_id, CAST(coalesce(length(text), 0) AS INTEGER) AS n_chars, coalesce(c.n, 0) AS shared_chars, coalesce(longest, 0) AS longest FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
}
