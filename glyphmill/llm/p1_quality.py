"""Problem 1: statistics of each body's words and lines that tell running prose from lists, tables and scan debris.

Per body a fixed set of statistics is taken; per language mergeable KLL sketches of every statistic are built (partial sketches per
task, merged by language), turned into quantile grids, and each value gets a percentile and a robust z-score. Tails are flagged.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialize
from ..sources.tables import block_texts, bounded_rows, current_bodies, table

STATS = ("n_words", "n_lines", "mean_word_len", "symbol_ratio", "digit_ratio", "upper_ratio", "punct_end_share", "common_share", "sentence_share", "repeat_line_share", "page_words_ratio")
SCHEMA = "id string, lang string, n_chars long, " + ", ".join(f"{s} double" for s in STATS)
GRID = 100  # steps of the quantile grid
COMMON_WORDS = 100_000  # a word list of more rows is refused

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_FIELDS = re.compile(r"(?:[^;\s]*;){3,}[^;]*$")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯ก-๛]")
_VOWEL = re.compile(r"[aeiouyà-æè-ïò-öø-ýœаеёиоуыэюяіїαεηιουω]", re.I)
_BROKEN = re.compile(r"[^\W\d_]{2,}[-‐‑¬­]\s*$")


def table_marks(text: str) -> bool:
    """Whether a line has the marks of a table: bars, dot leaders, rules, rows of stars, or fields parted by semicolons at its end."""
    return "|" in text or "...." in text or ". . . " in text or "____" in text or "====" in text or "* * * * " in text or text.count(";") >= 3 and _FIELDS.search(text) is not None


def is_running(text: str, common: set[str], least: int = 9) -> bool:
    """Whether a line or block is running sentences: enough words, mostly letters, shaped like words of a language, no
    table marks. Case, final punctuation and list marks don't matter."""
    dense = len(text) - text.count(" ")
    if not dense or table_marks(text):
        return False
    cjk = 0 if text.isascii() else len(_CJK.findall(text))
    if cjk >= 8 and cjk >= 0.5 * dense:
        return True
    words = _WORD.findall(text)
    if len(words) < least:
        return False
    letters = sum(map(len, words))
    if letters < 0.7 * dense or not 2.8 <= letters / len(words) <= 12:
        return False
    lower = [w.lower() for w in words]
    need = max(1, 0.05 * len(words))
    for w in lower:
        if w in common:
            need -= 1
            if need <= 0:
                return True
    long = [w for w in lower if len(w) > 2]
    return len(long) >= 0.5 * len(words) and sum(1 for w in long if 0.2 <= len(_VOWEL.findall(w)) / len(w) <= 0.8) >= 0.9 * len(long)


_DIGITS, _UPPER = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PLAIN = _DIGITS + _UPPER + _UPPER.lower() + bytes(range(33))
_OTHER = re.compile(r"[^\x00-\x7f]")


def _count_chars(text: str) -> tuple[int, int, int]:
    """Numbers of symbols, digits and capitals; ASCII is counted in bytes."""
    plain = text.encode("ascii", "ignore")
    size = len(plain)
    rest = [] if size == len(text) else _OTHER.findall(text)
    symbols = len(plain.translate(None, _PLAIN)) + sum(not c.isalnum() and not c.isspace() for c in rest)
    return symbols, size - len(plain.translate(None, _DIGITS)) + sum(map(str.isdigit, rest)), size - len(plain.translate(None, _UPPER)) + sum(map(str.isupper, rest))


def _measure(id_: str, texts: list[str], page_words: int, common: dict[str, set[str]], every: set[str]) -> tuple:
    full = "\n".join(texts)
    words = _WORD.findall(full.lower())
    n, kinds = len(words), Counter(words)
    hits = {lang: sum(kinds[w] for w in s if w in kinds) for lang, s in common.items()}
    lang = max(sorted(hits), key=hits.get) if hits and max(hits.values()) else "und"
    running, tail = 0, False
    for t in texts:
        broken = t.rstrip()[-1:] in "-‐‑¬­" and bool(_BROKEN.search(t))
        if (tail or broken) and len(t) < 200 or is_running(t, every):
            running += len(t)
        tail = broken
    size = sum(map(len, texts))
    dense = max(1, sum(map(len, full.split())))
    symbols, digits, upper = _count_chars(full)
    letters = sum(len(w) * k for w, k in kinds.items())
    seen = Counter(" ".join(t.lower().split()) for t in texts)
    return (
        id_, lang, size, float(n), float(len(texts)), letters / n if n else 0.0, symbols / dense, digits / dense, upper / max(1, letters),
        sum(t.rstrip()[-1:] in ".!?。:;" for t in texts) / len(texts), max(hits.values(), default=0) / n if n else 0.0, running / max(1, size),
        sum(v for v in seen.values() if v > 1) / len(texts), page_words / n if n else 0.0,
    )


def quality_stats(bodies: DataFrame, common_words: DataFrame) -> DataFrame:
    """Per body with some non-blank block text: id, lang (by function words, 'und' without any), n_chars and the statistics of ``STATS``.

    ``common_words`` is a word list of fixed size and goes to every task; one of more than COMMON_WORDS rows is an error. Null pages, blocks, texts and word counts count as absent;
    bodies without text give no row; equal rows give a row each; extra columns are ignored.
    """
    common: dict[str, set[str]] = {}
    for r in bounded_rows(common_words.select("word", "lang").filter("word is not null and lang is not null").distinct(), COMMON_WORDS):
        common.setdefault(r.lang, set()).add(r.word.lower())
    every = set().union(*common.values()) if common else set()
    rows = bodies.select("id", block_texts().alias("t"), F.aggregate(F.coalesce(F.transform("pages", lambda p: F.coalesce(p["words"].cast("long"), F.lit(0).cast("long"))), F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, b: a + b).alias("w"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([_measure(i, list(t), w, common, every) for i, t, w in zip(pdf["id"], pdf["t"], pdf["w"])], columns=["id", "lang", "n_chars", *STATS])

    return rows.filter(F.size("t") > 0).mapInPandas(run, SCHEMA)


def quantile_grids(stats: DataFrame, k: int = 400) -> DataFrame:
    """Per language one row with a grid of ``GRID`` + 1 quantiles of each statistic, from KLL sketches with parameter ``k``."""
    ranks = F.array(*(F.lit(i / GRID) for i in range(GRID + 1)))
    sketches = stats.groupBy("lang").agg(*(F.kll_sketch_agg_double(s, k).alias(s) for s in STATS))
    return sketches.select("lang", *(F.kll_sketch_get_quantile_double(s, ranks).alias(f"grid_{s}") for s in STATS))


def flag_tails(stats: DataFrame, tail: float = 0.02, z: float = 6.0, limits: dict[str, float] | None = None, grids: DataFrame | None = None) -> DataFrame:
    """Add to each row ``pct_*`` (percentile within its language), ``z_*`` (distance from the median in robust standard
    deviations) and ``tails``, the names of the statistics in whose tail it lies.

    A value is in the tail below percentile ``tail``, above 1 - ``tail``, or beyond ``z``. ``limits`` gives statistics whose lower tail must reach
    up to a fixed value: its end is the percentile that the language's own sketch gives to that value, so no row below the
    value is missed. ``stats`` is read twice; grids have one row per language.
    """
    grids = quantile_grids(stats) if grids is None else grids
    at = lambda s, v: F.size(F.filter(f"grid_{s}", lambda g: g <= v)) / F.lit(GRID + 1.0)
    rows = stats.join(F.broadcast(grids), "lang")
    for s in STATS:
        spread = (F.element_at(f"grid_{s}", int(GRID * 0.75) + 1) - F.element_at(f"grid_{s}", int(GRID * 0.25) + 1)) / 1.349
        rows = rows.withColumns({f"pct_{s}": at(s, F.col(s)), f"z_{s}": F.when(spread > 0, (F.col(s) - F.element_at(f"grid_{s}", GRID // 2 + 1)) / spread)})
    flags = []
    for s in STATS:
        low = F.lit(tail) if s not in (limits or {}) else F.greatest(F.lit(tail), at(s, F.lit(float(limits[s]))))
        flags.append(F.when((F.col(f"pct_{s}") <= low) | (F.col(f"pct_{s}") > 1 - tail) | (F.abs(f"z_{s}") > z), F.lit(s)))
    return rows.withColumn("tails", F.array_compact(F.array(*flags))).drop(*(f"grid_{s}" for s in STATS))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(quality_stats(current_bodies(spark, sf_dir), table(spark, sf_dir, "common_words")), "quality")
    return flag_tails(stats, limits={"sentence_share": 0.5})


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).filter(F.array_contains("tails", "sentence_share") & (F.col("sentence_share") < 0.5)).select("id")


def p1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


QUERIES = {"p1_found": p1_found, "p1_quality": p1_quality}
SQL: dict[str, str] = {}
