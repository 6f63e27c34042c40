"""Problem 4: cut oversized bodies into pieces under a size limit at natural boundaries.

Lexical-cohesion segmentation: for every gap between two units (blocks, or sentences of a block that is large
itself) the similarity of the words in a window before and after it is taken; a gap whose similarity lies far below the
peaks on either side is a valley, a change of topic. Page ends and headings of the outline deepen a valley. Within each
window of allowed sizes the deepest valley is the cut, and each later piece first repeats the end of the piece before.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import block_texts, current_bodies, not_blank

PIECES = "id string, piece_no int, starts int, ends int, overlap int, piece string"
_WORD = re.compile(r"[^\W\d_]{3,}")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n+")


def _spans(texts: list[str], marks: list[float], most: int) -> tuple[list[int], list[float], list[Counter]]:
    """Unit ends in the joined text, the bonus of a cut there, and each unit's words."""
    ends, bonus, words, at = [], [], [], 0
    for text, mark in zip(texts, marks):
        pieces, last = [], 0
        if len(text) > most:
            for m in _SENTENCE.finditer(text):
                pieces.append((last, m.start()))
                last = m.end()
        pieces.append((last, len(text)))
        for k, (a, b) in enumerate(pieces):
            ends.append(at + b)
            bonus.append(mark if k == len(pieces) - 1 else -0.1)
            words.append(Counter(w.lower() for w in _WORD.findall(text[a:b])))
        at += len(text) + 1
    return ends, bonus, words


def cohesion(words: list[Counter], width: int) -> list[float]:
    """Cosine similarity of the words of the ``width`` units before and after the gap that follows each unit but the last."""
    sims = []
    left, right = {}, {}
    dot = left_sq = right_sq = 0  # kept up to date word by word, so that a gap costs no more than the words that move over it

    def move(side: dict[str, int], other: dict[str, int], unit: Counter, sign: int) -> tuple[int, int]:
        """Add (or with -1 take) a unit's words; returns the changes of the side's squares and of the product with the other side."""
        squares = product = 0
        for w, n in unit.items():
            had = side.get(w, 0)
            now = had + sign * n
            squares += now * now - had * had
            product += sign * n * other.get(w, 0)
            if now:
                side[w] = now
            else:
                del side[w]
        return squares, product

    for w in words[1 : width + 1]:
        right_sq += move(right, left, w, 1)[0]
    for g in range(len(words) - 1):
        for k, sign in ((g, 1), (g - width, -1)):
            if k >= 0:
                squares, product = move(left, right, words[k], sign)
                left_sq, dot = left_sq + squares, dot + product
        norm = (left_sq * right_sq) ** 0.5
        sims.append(dot / norm if norm else 0.0)
        for k, sign in ((g + 1, -1), (g + 1 + width, 1)):
            if k < len(words):
                squares, product = move(right, left, words[k], sign)
                right_sq, dot = right_sq + squares, dot + product
    return sims


def _depths(sims: list[float]) -> list[float]:
    """Depth of the valley at each gap: how far the similarity lies below the nearest peaks."""
    peak_l, best = [], 0.0
    for g, s in enumerate(sims):  # the peak on the left: climb while the curve rises
        best = max(s, best) if g and sims[g - 1] >= s else s
        peak_l.append(best)
    peak_r, best = [0.0] * len(sims), 0.0
    for g in range(len(sims) - 1, -1, -1):
        best = max(sims[g], best) if g + 1 < len(sims) and sims[g + 1] >= sims[g] else sims[g]
        peak_r[g] = best
    return [(peak_l[g] - s) + (peak_r[g] - s) for g, s in enumerate(sims)]


def cut_text(texts: list[str], marks: list[float], limit: int = 6000, overlap: int = 200, width: int = 4) -> list[tuple[int, int, int]]:
    """Pieces (start, end, length of the repeated part) of the texts joined by single blanks; none is longer than ``limit``."""
    full = " ".join(texts)
    if len(full) <= limit:
        return [(0, len(full), 0)]
    ends, bonus, words = _spans(texts, marks, max(200, limit // 8))
    depth = [d + b for d, b in zip(_depths(cohesion(words, width)), bonus)]
    pieces, start, g, back = [], 0, 0, 0
    while True:
        begin = start - back
        if len(full) - begin <= limit:
            pieces.append((begin, len(full), back))
            return pieces
        low, high = begin + limit // 2, begin + limit
        while g < len(depth) and ends[g] <= max(low, start):
            g += 1
        best, cut = None, 0
        k = g
        while k < len(depth) and ends[k] <= high:
            if best is None or depth[k] > best:
                best, cut = depth[k], ends[k]
            k += 1
        if not cut:  # no boundary between units: the last sentence end, else the last blank, else the limit itself
            part = full[max(low, start + 1) : high]
            at = max((m.end() for m in re.finditer(r"[.!?;]\s", part)), default=0) or part.rfind(" ") + 1
            cut = max(low, start + 1) + at if at else high
        pieces.append((begin, cut, back))
        start = cut
        back = min(overlap, limit // 2 - 1, start)
        space = full.find(" ", start - back, start)  # begin the repeated part with a whole word
        if 0 <= space < start - back // 2:
            back = start - space - 1


def split_bodies(bodies: DataFrame, limit: int = 6000, overlap: int = 200, width: int = 4) -> DataFrame:
    """Pieces of every body: (id, piece_no from 1, starts, ends, overlap, piece); ``ends`` and ``starts`` are places in
    the non-blank block texts joined by single blanks, ``overlap`` the number of characters repeated.

    A body under the limit comes out as one piece, a body without text as none. Null pages, blocks and texts count as absent;
    rows of equal id are split each. Extra columns are ignored. A text without blanks is cut at the limit itself.
    """
    if limit < 2 or not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")
    heads = F.transform(F.coalesce(F.col("outline"), F.array().cast("array<struct<t:string,lvl:int,p:int>>")), lambda o: o["t"])
    rows = F.flatten(F.transform(F.array_sort(F.transform(F.col("pages"), lambda p, i: F.struct(p["n"].alias("n"), i.alias("i"), F.transform(
        F.coalesce(p["blocks"], F.array().cast("array<struct<k:string,t:string>>")), lambda b: F.struct(i.alias("i"), b["k"].alias("k"), b["t"].alias("t"))).alias("b")))), lambda p: p["b"]))
    rows = F.coalesce(F.filter(rows, lambda b: b["t"].isNotNull() & not_blank(b["t"])), F.array().cast("array<struct<i:int,k:string,t:string>>"))
    flat = bodies.select("id", rows.alias("b"), heads.alias("heads"))
    flat = flat.select("id", F.col("b.t").alias("t"), F.col("b.k").alias("k"), F.col("b.i").alias("pg"), "heads").filter(F.size("t") > 0)
    size = F.aggregate("t", F.lit(-1), lambda n, t: n + F.length(t) + 1)
    short = flat.filter(size <= limit).select("id", F.lit(1).alias("piece_no"), F.lit(0).alias("starts"), size.alias("ends"), F.lit(0).alias("overlap"), F.array_join("t", " ").alias("piece"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for id_, t, k, pg, hs in zip(pdf["id"], pdf["t"], pdf["k"], pdf["pg"], pdf["heads"]):
                t, k, pg = list(t), list(k), list(pg)
                named = {h for h in hs if h}
                marks = [0.3 * (pg[j] != pg[j + 1]) + 0.4 * (k[j + 1] == "h") + 0.3 * (t[j + 1] in named) - 0.5 * (k[j] == "h") if j + 1 < len(t) else 0.0 for j in range(len(t))]
                full = " ".join(t)
                out += [(id_, n + 1, a, b, o, full[a:b]) for n, (a, b, o) in enumerate(cut_text(t, marks, limit, overlap, width))]
            yield pd.DataFrame(out, columns=["id", "piece_no", "starts", "ends", "overlap", "piece"])

    return short.unionByName(flat.filter(size > limit).mapInPandas(run, PIECES))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_bodies(current_bodies(spark, sf_dir)).filter("piece_no = 2").select("id")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_bodies(current_bodies(spark, sf_dir))


QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces}

_CURRENT = """cur AS (SELECT id, pages FROM (SELECT id, pages, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) AS rn FROM doc_bodies WHERE id IS NOT NULL) WHERE rn = 1)"""
SQL = {
    "p4_found": f"""WITH {_CURRENT}, b AS (SELECT id, unnest(pages, recursive := false) AS p FROM cur), t AS (SELECT id, unnest(p.blocks).t AS t FROM b)
SELECT id FROM t WHERE regexp_matches(t, '\\S') GROUP BY id HAVING sum(length(t) + 1) - 1 > 6000""",
}
