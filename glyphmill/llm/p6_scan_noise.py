"""Problem 6: faults of scanned text (running headers, page numbers, broken words, misread letters) and its repair into paragraphs.

Misreadings are decoded as a noisy channel: each doubtful word of a line gets the words it may have been (one confusion undone), each with the confusion's probability as the
corpus shows it, and the Viterbi path of the line under corpus word and word-pair counts is taken. All words and pairs of the corpus are counted, by shuffle. The most frequent ones are sent
to the tasks, ``SENT`` of either at most: 36 MB of words (8.5 bytes each) and 15 MB of pairs (3.5 bytes each). If there are more, each document gets the counts of the rarer ones that
it may ask for by a join (``with_rare``), so the result is the same however few are sent.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import collect_garbage, materialize
from ..sources.tables import bounded_rows, current_bodies, not_blank, table
from .p1_quality import _BROKEN, COMMON_WORDS, is_running

STEPS = 8  # steps of a pair's count per doubling
RESOLUTION = 2**25  # words of a corpus of which no more than this can be of ``floor_of`` it
SENT = 2**22  # words, and pairs, that are sent to all tasks; the others come with the documents
#: Fixed values: (as meant, as misread) in lower case; those of capitals after it.
CONFUSIONS = [("e", "c"), ("t", "f"), ("i", "l"), ("o", "0"), ("a", "@"), ("l", "1"), ("s", "5"), ("h", "b"), ("u", "ii"), ("g", "9"), ("ri", "n"), ("m", "rn"), ("w", "vv"), ("ti", "h"), ("rn", "m"), ("i", "1"), ("l", "i"), ("b", "8"), ("z", "2"), ("cl", "d"), ("d", "cl"), ("g", "6"), ("li", "h"), ("nn", "m"), ("b", "6")]
CAPITALS = [("e", "f"), ("o", "0"), ("i", "1"), ("s", "5"), ("b", "8"), ("g", "6"), ("z", "2"), ("a", "@"), ("o", "q"), ("c", "g"), ("a", "4"), ("l", "1"), ("i", "l"), ("u", "ii"), ("w", "vv")]
FLUSH_WORDS = 8_000_000  # words a task holds before it sends what it has counted
RATE = 0.03  # mean probability of a word being misread in one given way, set high enough to cover that its misreadings are themselves counted
SPREAD = 3.0  # how far a confusion's probability may lie above or below that mean, as a factor
ODD = 1e-9  # probability of a word proper with a digit or at sign among its letters
#: Counts from which a word is known, and from which both parts of a compound are: those of a corpus of CORPUS words (sf0.1). In a larger corpus they grow with it.
KNOWN, USUAL, CORPUS = 20, 200, 4_200_000
MARKS = "-‐‑¬­"
_TOKEN = re.compile(r"[^\W_]+(?:@[^\W_]*)*|@[^\W_]+(?:@[^\W_]*)*")
_WORDS = re.compile(rf"[^\W_@]+(?:@[^\W_]*)*(?:[{MARKS}][^\W\d_]+)*|@[^\W_]+")
_INSIDE = re.compile(rf"[{MARKS}](\s*)([^\W\d_]+)")
_END = re.compile(rf"([^\W\d_]+)([{MARKS}])\s*$")
_START = re.compile(r"^\W*([^\W\d_]+)")
_ROMAN = re.compile(r"^[ivxl]{1,6}$", re.I)
_CODE = re.compile(r"^[A-Z]{1,4}\d+[A-Z]?$|^\d+[A-Za-z]{0,2}$|^[A-Z]\d|^\d+(?:st|nd|rd|th)$")
_NUMBER = re.compile(r"^(?:page|p\.?|seite|página|pagina|s\.)?\s*[\[\(\-–—~]*\s*(?:\d{1,2}\s*-\s*)?\d{1,4}\s*[\]\)\-–—~.]*$", re.I)
_AS_DIGITS = str.maketrans({"l": "1", "I": "1", "i": "1", "|": "1", "o": "0", "O": "0", "Q": "0", "S": "5", "s": "5", "B": "8", "b": "6", "Z": "2", "z": "2", "g": "9", "G": "6", "q": "9", "@": "0", "T": "7", "A": "4"})
_PAGE_WORD = re.compile(r"^[pP][aA@4][gG96q][eEcCfF]\s+")
_JOINERS = {"and", "or", "und", "oder", "et", "ou", "y", "o", "to", "bis"}


def is_page_number(t: str) -> bool:
    """Whether a line is nothing but a page number: plain, framed, with a chapter, Roman, after the word page; digits may be misread."""
    t = _PAGE_WORD.sub("", t.strip())
    if not t or len(t) > 12:
        return False
    if _NUMBER.match(t):
        return True
    core = t.strip("[]()-–—~. ")
    if _ROMAN.match(core):
        return core.lower() not in {"i", "l", "x", "v"} or len(t) <= 5
    if len(core) > 5 or not any(c.isdigit() for c in core):
        return False
    return bool(_NUMBER.match(t.translate(_AS_DIGITS))) and sum(c.isdigit() for c in core) * 2 >= len(core.replace("-", ""))


_DIGITS = re.compile(r"[0-9@]")
_ANY_MARK = re.compile(f"[{MARKS}]")
_CLASS = str.maketrans({"c": "e", "f": "t", "l": "i", "b": "h", "0": "o", "1": "i", "5": "s", "9": "g", "@": "a", "8": "h"})
_CLASS_ASCII = bytes(_CLASS.get(c, chr(c)).encode()[0] if isinstance(_CLASS.get(c, c), str) else c for c in range(128)) + bytes(range(128, 256))
_NO_LETTERS = bytes(c for c in range(128) if not chr(_CLASS_ASCII[c]).isalpha())


def header_key(t: str) -> str:
    """What stays of a line if digits, case, marks and misreadings don't count."""
    t = t.lower()
    if _DIGITS.search(t):
        keep = []
        for w in t.split():
            letters = sum(map(str.isalpha, w))
            if letters and letters * 2 > sum(map(str.isalnum, w)):
                keep.append(w)
        t = " ".join(keep)
    key = t.encode().translate(_CLASS_ASCII, _NO_LETTERS).decode() if t.isascii() else "".join(filter(str.isalpha, t.translate(_CLASS)))
    for a, b in (("ii", "u"), ("rn", "m"), ("ri", "n"), ("ti", "h"), ("ii", "h"), ("vv", "w")):
        key = key.replace(a, b)
    return key


def words_of(t: str) -> list[str]:
    return _WORDS.findall(t.lower())


class Corpus:
    """Corpus counts as sent to the tasks: packed tables of words and of pairs, the number of all words, and the probability of each confusion (as meant, as misread).
    ``partly``: there are rarer ones too."""

    def __init__(self, words: tuple, pairs: tuple, total: float, rates: dict[tuple[str, str], float] | None = None, partly: bool = False):
        self.words, self.pairs, self.total, self.rates, self.partly = words, pairs, total, rates or {}, partly

    def sum(self) -> float:
        return self.total


def _hashes(keys: list[str], salt: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(k, salt) for k in keys], np.uint64)


def pack(h: np.ndarray, n: np.ndarray, pair: bool) -> tuple[int, bytes, bytes, bytes]:
    """A table of distinct hashes and their counts. Of a hash the bucket (about eight to a bucket, by the first bits) and the last 32 bits are kept (of a pair 16), of a
    count seven digits (of a pair a step of 9 %)."""
    order = np.argsort(h)
    h, n = h[order], n[order]
    bits = max(0, (len(h) // 8).bit_length())
    bucket = h >> np.uint64(64 - bits) if bits else np.zeros(len(h), np.uint64)
    ends = np.searchsorted(bucket, np.arange(1 << bits, dtype=np.uint64), "right").astype(np.uint32)
    if pair:
        return bits, ends.tobytes(), h.astype(np.uint16).tobytes(), np.minimum(255, np.round(np.log2(n + 1.0) * STEPS)).astype(np.uint8).tobytes()
    return bits, ends.tobytes(), h.astype(np.uint32).tobytes(), n.astype(np.float32).tobytes()


class Counts:
    """Corpus counts: those of words exact to seven digits, those of pairs to 4.5 %. An unseen word reads as seen with a probability of about 8 / 2**32, an unseen pair with 8 / 2**16."""

    def __init__(self, corpus: Corpus):
        view = lambda t, fp, n: (64 - t[0], memoryview(t[1]).cast("I"), memoryview(t[2]).cast(fp), memoryview(t[3]).cast(n))
        self.words, self.pairs = view(corpus.words, "I", "f"), view(corpus.pairs, "H", "B")
        self.partly, self.rare = corpus.partly, {}  # by hash, the rarer words and pairs that this document may ask for
        self.cache: dict[str, float] = {}
        self.found: dict[tuple[str, bool], list[tuple[str, float]]] = {}
        self.doubts: dict[str, bool] = {}
        self.fine: set[str] = set()  # what stands between blanks and has no doubtful word
        self.choices: dict[str, tuple[list[str], list[int]]] = {}
        self.plain: set[str] = set()  # what stands between blanks, and each word of it was sent and can't be misread
        self.scale = max(1.0, corpus.total / CORPUS)
        self.known, self.usual = KNOWN * self.scale, USUAL * self.scale
        self.rates = {f: corpus.rates.get(f, RATE) for f in {*CONFUSIONS, *CAPITALS}}

    @staticmethod
    def _get(table: tuple, h: int, mask: int) -> float:
        shift, ends, prints, counts = table
        k = h >> shift
        a = ends[k - 1] if k else 0
        here = prints[a : ends[k]].tolist()
        return counts[a + here.index(h & mask)] if h & mask in here else 0

    def word(self, w: str) -> float:
        n = self.cache.get(w)
        if n is None:
            if len(self.cache) > 1_000_000:
                self.cache.clear()
            h = xxhash.xxh3_64_intdigest(w, 1)
            n = self._get(self.words, h, 0xFFFFFFFF)
            if not n and self.partly:  # not kept: another document may not have asked for it
                return self.rare.get(h, 0)
            self.cache[w] = n
        return n

    def pair(self, a: str, b: str) -> float:
        h = xxhash.xxh3_64_intdigest(f"{a}\0{b}", 3)
        steps = self._get(self.pairs, h, 0xFFFF)
        if not steps and h in self.rare:
            steps = round(math.log2(self.rare[h] + 1) * STEPS)
        return 2 ** (steps / STEPS) - 1


def lines_table(bodies: DataFrame, ocr: DataFrame) -> DataFrame:
    """(origin, doc_id, l): one row per document, ``l`` its non-blank lines (page, pos, t) in order of page and place.

    Repeated rows count once; of several texts at one place the greatest is kept. Null ids and texts are left out, a null page or place is 0.
    A document is the unit of reading here as it is in the table of bodies.
    """
    zero = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    o = ocr.filter("doc_id is not null and t is not null").filter(not_blank(F.col("t"))).select("doc_id", F.struct(zero(F.col("page")).alias("page"), zero(F.col("ord")).alias("pos"), "t").alias("x"))
    o = o.groupBy("doc_id").agg(F.array_sort(F.collect_set("x")).alias("l")).select(F.lit("ocr_lines").alias("origin"), "doc_id", "l")
    kinds = "array<struct<page:int,pos:int,t:string>>"
    l = F.flatten(F.transform("pages", lambda p: F.transform(F.coalesce(p["blocks"], F.array().cast("array<struct<k:string,t:string>>")), lambda b, i: F.struct(zero(p["n"]).alias("page"), i.alias("pos"), b["t"].alias("t")))))
    l = F.array_sort(F.filter(l, lambda x: x["t"].isNotNull() & not_blank(x["t"])))
    b = bodies.filter("id is not null").select(F.lit("doc_bodies").alias("origin"), F.col("id").alias("doc_id"), F.coalesce(l, F.array().cast(kinds)).alias("l"))
    return o.unionByName(b).filter(F.size("l") > 0)


def _rows(batch: pa.RecordBatch, step: int = 500) -> Iterator[tuple[str, str, list[int], list[int], list[str]]]:
    """The documents of a batch, a few at a time in Python."""
    for k in range(0, batch.num_rows, step):
        part = batch.slice(k, step)
        col = part.column("l")
        flat = col.flatten()
        page, pos, text = (x.to_pylist() for x in flat.flatten())
        at = 0
        for origin, doc, n in zip(part.column("origin").to_pylist(), part.column("doc_id").to_pylist(), col.value_lengths().to_pylist()):
            yield origin, doc, page[at : at + n], pos[at : at + n], text[at : at + n]
            at += n


def floor_of(total: float, most: int | None = None) -> float:
    """The count of which a corpus of ``total`` words can have ``most`` words and pairs at most, whatever they are."""
    return max(1.0, total / (most or RESOLUTION))


def counted(lines: DataFrame) -> DataFrame:
    """(w, h, n): every distinct word ``w`` of the corpus with its hash and count, and every distinct pair of following words of a document, ``w`` null. Counted within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: defaultdict[str, int] = defaultdict(itertools.count().__next__)  # the words met, numbered
        seen: list[np.ndarray] = []  # the numbers of each document's words

        def flush() -> pa.RecordBatch:
            keys = list(number)
            once = np.bincount(np.concatenate(seen), minlength=len(keys)) if seen else np.empty(0, np.int64)
            both, twice = np.unique(np.concatenate([x[:-1] << 32 | x[1:] for x in seen]) if seen else np.empty(0, np.int64), return_counts=True)
            names = [f"{keys[a]}\0{keys[b]}" for a, b in zip((both >> 32).tolist(), (both & 0xFFFFFFFF).tolist())]
            h, n = np.concatenate([_hashes(keys, 1), _hashes(names, 3)]), np.concatenate([once, twice]).astype(np.int64)
            out = pa.RecordBatch.from_arrays([pa.array(keys + [None] * len(names), pa.string()), pa.array(h.view(np.int64)), pa.array(n)], names=["w", "h", "n"])
            number.clear(), seen.clear()
            number.default_factory = itertools.count().__next__
            return out

        size = 0
        for batch in batches:
            for _, _, _, _, texts in _rows(batch):
                w = words_of("\n".join(texts))
                seen.append(np.fromiter(map(number.__getitem__, w), np.int64, len(w)))
                size += len(w)
                if size > FLUSH_WORDS:
                    yield flush()
                    size = 0
        yield flush()

    sent = lines.select("origin", "doc_id", "l").mapInArrow(run, "w string, h long, n long")
    return sent.groupBy("w", "h").agg(F.sum("n").alias("n"))


def confusion_rates(words: DataFrame, floor: float = 1.0) -> dict[tuple[str, str], float]:
    """The probability of each confusion: how often distinct words stand that differ from a far more frequent one by just it, against how often it could have happened. The mean over all
    confusions (by how often they happen) is set to RATE, and none may be further from it than by SPREAD.

    ``words`` is (w, n), all distinct words. What comes to the driver is one row per confusion.
    """
    ways = sorted({*CONFUSIONS, *CAPITALS})

    def misread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for c, n in zip(batch.column("w").to_pylist(), batch.column("n").to_pylist()):
                for way, (meant, seen) in enumerate(ways):
                    k = c.find(meant)
                    while k >= 0:
                        out[0].append(c[:k] + seen + c[k + len(meant) :]), out[1].append(way), out[2].append(n)
                        k = c.find(meant, k + 1)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64())], names=["w", "way", "meant"])

    frequent = words.filter((F.col("n") > floor / RATE) & (F.length("w") > 2))
    could = frequent.mapInArrow(misread, "w string, way int, meant long")
    far = F.when(F.col("meant") * RATE > F.col("n"), F.col("n"))
    seen = could.join(words, "w", "left").groupBy("way").agg(F.coalesce(F.sum(far), F.lit(0)).alias("seen"), F.sum("meant").alias("meant")).collect()
    rate = {ways[r.way]: (r.seen, r.seen / r.meant) for r in seen if r.meant}
    mass = sum(n for n, _ in rate.values())
    mean = sum(n * p for n, p in rate.values()) / mass if mass else 0.0
    return {way: RATE * min(SPREAD, max(1 / SPREAD, p / mean)) for way, (_, p) in rate.items()} if mean else {}


def corpus_counts(lines: DataFrame) -> Corpus:
    """The corpus counts that are sent to the tasks: SENT words and pairs at most, the most frequent ones."""
    return sent_and_rare(lines)[0]


def sent_and_rare(lines: DataFrame) -> tuple[Corpus, DataFrame | None]:
    """The corpus counts that are sent to the tasks, and the others as (h, n); None if there are none."""
    n = materialize(counted(lines), "counts")
    words, pairs = n.filter("w is not null"), n.filter("w is null")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = math.ceil(floor_of(total, SENT))

    def least(rows: DataFrame) -> int:
        """The count from which there are SENT rows at most. What comes to the driver is a row per count up to ``top``."""
        number, f = 0, top
        for r in sorted(rows.groupBy(F.least("n", F.lit(top)).alias("n")).agg(F.count(F.lit(1)).alias("rows")).collect(), key=lambda r: -r.n):
            number += r.rows
            if number > SENT:
                return f
            f = r.n
        return 1

    def table(rows: DataFrame, f: int, pair: bool) -> tuple:
        t = rows.filter(F.col("n") >= f).select("h", "n").toArrow()
        return pack(t.column("h").to_numpy().view(np.uint64), t.column("n").to_numpy(), pair)

    f, g = least(words), least(pairs)
    corpus = Corpus(table(words, f, False), table(pairs, g, True), total, confusion_rates(words.select("w", "n")), max(f, g) > 1)
    return corpus, n.filter(F.col("n") < F.when(F.col("w").isNull(), g).otherwise(f)).select("h", "n") if corpus.partly else None


def asked(page: list[int], text: list[str], counts: Counts) -> set[int]:
    """The hashes of all words and pairs not sent to the tasks that ``repair`` may ask for in a document.

    A word that was sent is more frequent than any that wasn't, so of its candidates only those sent count; of another word all.
    """
    out: set[int] = set()

    def known(w: str) -> float:
        n = counts.word(w)
        if not n:
            out.add(xxhash.xxh3_64_intdigest(w, 1))
        return n

    def halves(a: str, b: str) -> None:
        for w in (a, b, a + b, f"{a}-{b}"):
            known(w)

    heads, numbers, _, _ = _edges(page, text)
    body = [k for k in range(len(text)) if k not in heads and k not in numbers]
    for i, k in enumerate(body):
        t = text[k]
        if "-" in t or not t.isascii() and _ANY_MARK.search(t):
            for m in _INSIDE.finditer(t):
                a = m.start()
                while a and t[a - 1].isalpha():
                    a -= 1
                halves(t[a : m.start()].lower(), m[2].lower())
            if end := _END.search(t):
                for j in body[i + 1 : i + 9]:
                    if x := _START.match(text[j]):
                        halves(end[1].lower(), x[1].lower())
        parts = t.split()
        if counts.plain.issuperset(parts):
            continue
        before: list[str] = []
        for raw in _TOKEN.findall(t):
            options, missing = _choices(raw, counts)
            out.update(missing)
            if len(options) > 1 or len(before) > 1:
                out.update(xxhash.xxh3_64_intdigest(f"{a}\0{c}", 3) for a in before for c in options if not counts.pair(a, c))
            before = options
        if len(counts.plain) > 1_000_000:
            counts.plain.clear()
        counts.plain.update(x for x in parts if x not in counts.plain and all(len(o) == 1 and not m for o, m in (_choices(r, counts) for r in _TOKEN.findall(x))))
    return out


def _choices(raw: str, counts: Counts) -> tuple[list[str], list[int]]:
    """A word and all that it may be a misreading of, and the hashes of those that weren't sent; each worker keeps what it has found."""
    kept = counts.choices.get(raw)
    if kept is None:
        w = raw.lower()
        own, upper, options = counts.word(w), _capitals(raw), [w]
        if _doubtful(raw, w):
            options += [c for c, _ in (candidates(w, upper, counts) if own else undone(w, upper))]
        if _odd_shape(raw):
            options += [c for c, _ in shape_candidates(w, upper, counts)]
        if len(counts.choices) > 500_000:
            counts.choices.clear()
        kept = counts.choices[raw] = options, [xxhash.xxh3_64_intdigest(c, 1) for c in options if not counts.word(c)]
    return kept


def with_rare(lines: DataFrame, rare: DataFrame, sent, keep) -> DataFrame:
    """``lines`` with (rh, rn): the hashes and counts of the rarer words and pairs that the document may ask for, of documents that ``keep`` (origin, texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(sent.value)
        for batch in batches:
            for origin, doc, page, _, text in _rows(batch):
                if keep(origin, text) and (h := asked(page, text, counts)):
                    yield pa.RecordBatch.from_arrays([pa.array([origin] * len(h)), pa.array([doc] * len(h)), pa.array(np.fromiter(h, np.uint64, len(h)).view(np.int64))], names=["origin", "doc_id", "h"])

    got = lines.select("origin", "doc_id", "l").mapInArrow(run, "origin string, doc_id string, h long").join(rare.hint("merge"), "h")
    got = got.groupBy("origin", "doc_id").agg(F.collect_list(F.struct("h", "n")).alias("r")).select("origin", "doc_id", F.col("r.h").alias("rh"), F.col("r.n").alias("rn"))
    return lines.join(got.hint("merge"), ["origin", "doc_id"], "left").select("origin", "doc_id", "l", "rh", "rn")


def undone(w: str, upper: bool) -> Iterator[tuple[str, tuple[str, str]]]:
    """Each word of which ``w`` (lower case) is a misreading by one confusion, and that confusion."""
    for way in CAPITALS if upper else CONFUSIONS:
        meant, seen = way
        k = w.find(seen)
        while k >= 0:
            yield w[:k] + meant + w[k + len(seen) :], way
            k = w.find(seen, k + 1)


def candidates(w: str, upper: bool, counts: Counts) -> list[tuple[str, float]]:
    """Words far more frequent than ``w`` (lower case) of which it is a misreading, each with the probability of its confusion; each worker keeps what it has found."""
    kept = counts.found.get((w, upper))
    if kept is not None:
        return kept
    own = max(counts.word(w), 1.0)
    out: dict[str, float] = {}
    for c, way in undone(w, upper):
        if counts.word(c) * counts.rates[way] > own:
            out[c] = max(out.get(c, 0.0), counts.rates[way])
    if len(counts.found) > 500_000:
        counts.found.clear()
    kept = counts.found[w, upper] = sorted(out.items())
    return kept


def shape_candidates(w: str, upper: bool, counts: Counts) -> list[tuple[str, float]]:
    """The letters that the one digit or at sign of an odd word may stand for."""
    out: dict[str, float] = {}
    for way in CAPITALS if upper else CONFUSIONS:
        meant, seen = way
        if seen in w and seen in "01589@" and len(seen) == 1:
            c = w.replace(seen, meant)
            out[c] = max(out.get(c, 0.0), counts.rates[way])
    return sorted(out.items())


def _doubtful(raw: str, w: str) -> bool:
    return len(w) > 1 and not _CODE.match(raw) and any(map(str.isalpha, w))


def _capitals(raw: str) -> bool:
    return not raw.islower() and sum(map(str.isupper, raw)) * 2 > sum(map(str.isalpha, raw)) and len(raw) > 1


def doubted(raw: str, counts: Counts) -> bool:
    """Whether a word, however frequent, may be a misreading: of a far more frequent word, or by its shape; each worker keeps what it has found."""
    kept = counts.doubts.get(raw)
    if kept is None:
        if len(counts.doubts) > 500_000:
            counts.doubts.clear()
        w = raw.lower()
        kept = counts.doubts[raw] = _doubtful(raw, w) and bool(candidates(w, _capitals(raw), counts)) or _odd_shape(raw)
    return kept


def doubtful_text(t: str, counts: Counts) -> bool:
    """Whether a text has a doubtful word. Words don't reach over blanks, so each worker keeps what stands between blanks and has been looked at before."""
    parts = t.split()
    if counts.fine.issuperset(parts):
        return False
    if len(counts.fine) > 1_000_000:
        counts.fine.clear()
    found = False
    for x in parts:
        if x not in counts.fine:
            if any(doubted(r, counts) for r in _TOKEN.findall(x)):
                found = True
            else:
                counts.fine.add(x)
    return found


def decode(raws: list[str], low: list[str], doubt: list[int], counts: Counts) -> list[tuple[int, str]]:
    """Misread words of a line: (place, word as meant), by Viterbi over the candidates of its doubtful words ``doubt``, given by place. A word of odd shape has the letters
    that its digit may stand for as candidates, if no known word explains it, and little chance to be meant as it is."""
    options: list[list[tuple[str, float]]] = [[(w, 0.0)] for w in low]
    any_ = False
    for k in doubt:
        r = raws[k]
        odd = _odd_shape(r)
        found = candidates(low[k], _capitals(r), counts) if _doubtful(r, low[k]) else []
        if odd:
            found = found or shape_candidates(low[k], _capitals(r), counts)
            options[k] = [(low[k], math.log(ODD / counts.scale))] if found else options[k]
        any_ |= bool(found)
        options[k] += [(c, math.log(rate)) for c, rate in found]
    if not any_:
        return []
    best: list[tuple[float, int]] = []
    paths: list[list[int]] = []
    for k, own in enumerate(options):
        now, back = [], []
        for c, channel in own:
            n = counts.word(c) + 0.1
            if k == 0:
                score, at = math.log(n), 0
            else:
                score, at = -1e300, 0
                for j, (a, _) in enumerate(options[k - 1]):
                    lm = math.log((counts.pair(a, c) + 0.05 * min(1.0, n / (1e6 * counts.scale) + 1e-4)) / (counts.word(a) + 1)) if len(own) > 1 or len(options[k - 1]) > 1 else 0.0
                    if best[j][0] + 0.5 * lm > score:
                        score, at = best[j][0] + 0.5 * lm, j
                score += math.log(n)
            now.append((score + channel, at))
            back.append(at)
        best = now
        paths.append(back)
    k = max(range(len(best)), key=lambda j: best[j][0])
    out = []
    for place in range(len(options) - 1, -1, -1):
        if k:
            out.append((place, options[place][k][0]))
        k = paths[place][k]
    return out[::-1]


def _odd_shape(raw: str) -> bool:
    """A word with one digit or at sign among its letters, in letters of one case."""
    odd = [c for c in raw if c in "01589@"]
    letters = [c for c in raw if c.isalpha()]
    if len(odd) != 1 or len(letters) < 4 or len(odd) + len(letters) != len(raw):
        return False
    return all(c.islower() for c in letters[1:]) or len(letters) >= 5 and all(c.isupper() for c in letters)


def broken(a: str, mark: str, gap: bool, b: str, counts: Counts) -> bool:
    """Whether a mark between two word parts breaks a word, rather than belonging to it."""
    a, b = a.lower(), b.lower()
    joined, kept = counts.word(a + b), counts.word(f"{a}-{b}")
    if joined >= 2 and joined > kept:
        return True
    if kept >= 3 and kept >= joined:
        return False
    if mark in "-‑" and (b in _JOINERS or counts.word(a) >= counts.usual and counts.word(b) >= counts.usual):
        return False
    if mark == "-" and not gap:
        return counts.word(a) < counts.known and counts.word(b) < counts.known and len(a) + len(b) >= 5 and len(a) > 1 and kept <= 1
    return len(a) + len(b) >= 4


def _edges(page: list[int], text: list[str]) -> tuple[set[int], set[int], dict[int, str], int]:
    """The lines of a document that are running headers, those that are page numbers, the header keys of lines at the edges of pages, and the number of lines."""
    n = len(text)
    edge: set[int] = set()
    outer: set[int] = set()
    starts = [k for k in range(n) if k == 0 or page[k] != page[k - 1]] + [n]
    for a, b in zip(starts, starts[1:]):
        edge.update(range(a, min(a + 2, b)), range(max(a, b - 2), b))
        outer.update((a, b - 1))
    numbers = {k for k in edge if is_page_number(text[k])}
    alone = {k for k in numbers if k in outer or k - 1 in numbers or k + 1 in numbers}
    keys = {k: header_key(text[k]) for k in edge if k not in numbers}
    pages: dict[str, set[int]] = {}
    for k, key in keys.items():
        if len(key) >= 3:
            pages.setdefault(key, set()).add(page[k])
    heads = {k for k, key in keys.items() if len(pages.get(key, ())) >= 3}
    numbers = {k for k in numbers if k in alone or any(j in heads for j in (k - 1, k + 1))}
    return heads, numbers, keys, n


def faults(page: list[int], pos: list[int], text: list[str], counts: Counts) -> tuple[list[tuple[int, str]], dict[int, str]]:
    """(line, fault) of one document, and the repaired text of each line that is text (headers and page numbers left out)."""
    return repair(page, pos, text, counts)[:2]


def repair(page: list[int], pos: list[int], text: list[str], counts: Counts) -> tuple[list[tuple[int, str]], dict[int, str], set[int]]:
    """As ``faults``, and the lines that begin with the rest of a word broken before them (it now stands there)."""
    heads, numbers, keys, n = _edges(page, text)
    found: list[tuple[int, str]] = []
    forms: dict[str, Counter] = {}
    for k in heads:
        forms.setdefault(keys[k], Counter())["".join(c for c in text[k].lower() if c.isalpha() or c in "@")] += 1
    for k in sorted(heads):
        found.append((k, "header"))
        own = re.findall(r"[^\W\d_]+|\w+|@", text[k].lower())
        usual = forms[keys[k]].most_common(1)[0]
        form = "".join(c for c in text[k].lower() if c.isalpha() or c in "@")
        if form != usual[0] and own and (usual[1] > forms[keys[k]][form]):
            found.append((k, "misread"))
    found += [(k, "page_number") for k in sorted(numbers)]
    body = [k for k in range(n) if k not in heads and k not in numbers]
    fixed: dict[int, str] = {}
    cut_start: dict[int, str] = {}
    for i, k in enumerate(body):
        t = text[k]
        spans: list[tuple[int, int]] = []
        edits: list[tuple[int, int, str]] = []
        end = tail = None
        if "-" in t or not t.isascii() and _ANY_MARK.search(t):
            for m in _INSIDE.finditer(t):
                a = b = m.start()
                while a and t[a - 1].isalpha():
                    a -= 1
                if a < b and broken(t[a:b], t[b], bool(m[1]), m[2], counts):
                    spans.append((a, m.end()))
                    edits.append((m.start(), m.start(2), ""))
            if t.rstrip()[-1] in MARKS:
                end = _END.search(t)
        joined = spans[:]
        rest = ""
        if end and len(end[1]) > 1:
            options = [(j, x[1]) for j in body[i + 1 : i + 9] if (x := _START.match(text[j]))]
            half = end[1].lower()
            nxt = next((o for o in options if counts.word(half + o[1].lower()) >= 2), None)
            if nxt is None and options:
                nxt = next((o for o in options if o[1][0].isupper() == half.isupper() or counts.word(f"{half}-{o[1].lower()}") >= 3), options[0])
            if nxt is not None and broken(end[1], end[2], True, nxt[1], counts):
                tail, rest = nxt
                joined.append(end.span())
                cut_start[tail] = rest
        if joined:
            found.append((k, "hyphen"))
        doubt: list[int] = []
        if doubtful_text(t, counts):
            raws = _TOKEN.findall(t)
            low = [r.lower() for r in raws]
            doubt = [j for j, r in enumerate(raws) if doubted(r, counts)]
        fixes: list[tuple[int, str]] = []
        if doubt:
            if joined or end or k in cut_start:  # halves of broken words aren't words
                tokens = list(_TOKEN.finditer(t))
                skip = {j for j, x in enumerate(tokens) if any(a < x.end() and x.start() < b for a, b in joined) or end and x.end() == end.end(1)}
                if k in cut_start:
                    skip.add(0)
                doubt = [j for j in doubt if j not in skip]
            fixes = decode(raws, low, doubt, counts)
            if fixes and sum(counts.word(w) >= counts.known for w in low) * 2 >= len(low):
                found.append((k, "misread"))
            else:
                fixes = []
        if fixes:
            tokens = list(_TOKEN.finditer(t))
        for j, w in fixes:
            edits.append((*tokens[j].span(), w.upper() if raws[j].isupper() and len(w) > 1 else w.capitalize() if raws[j][0].isupper() else w))
        for a, b, w in sorted(edits, reverse=True):  # from the right, so that places further left stay
            t = t[:a] + w + t[b:]
        if tail is not None:
            t = _END.sub(lambda x: x[1] + rest, t)
        if k in cut_start:
            t = t.lstrip()
            t = t[len(cut_start[k]) :].lstrip() if t.startswith(cut_start[k]) else t
        fixed[k] = t
    return found, fixed, set(cut_start)


def _scan(spark: SparkSession, sf_dir: str, least: float, make, schema: str) -> DataFrame:
    lines = materialize(lines_table(current_bodies(spark, sf_dir), table(spark, sf_dir, "ocr_lines")), "lines")
    common = {r.word.lower() for r in bounded_rows(table(spark, sf_dir, "common_words").filter("word is not null").select("word").distinct(), COMMON_WORDS)}
    corpus, rare = sent_and_rare(lines)
    sent = spark.sparkContext.broadcast(corpus)
    keep = lambda origin, text: origin != "doc_bodies" or mostly_running(text, common, least)
    if rare is not None:
        lines = with_rare(lines, rare, sent, keep)
    collect_garbage(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(sent.value)
        fields = pa.schema([(n, {"string": pa.string(), "int": pa.int32()}[k]) for n, k in (f.split() for f in schema.split(", "))])
        for batch in batches:
            out: list[tuple] = []
            hashes, numbers = (batch.column(c) for c in ("rh", "rn")) if counts.partly else ((), ())
            for k, (origin, doc, page, pos, text) in enumerate(_rows(batch)):
                if not keep(origin, text):
                    continue
                if counts.partly:
                    counts.rare = {h & 0xFFFFFFFFFFFFFFFF: n for h, n in zip(hashes[k].as_py() or (), numbers[k].as_py() or ())}
                out += make(origin, doc, page, pos, text, counts)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=fields)

    return lines.mapInArrow(run, schema)


def mostly_running(texts: list[str], common: set[str], least: float) -> bool:
    """Whether the share of characters in running sentences, as problem 1 counts it, is ``least`` or more."""
    need, tail = least * max(1, sum(map(len, texts))), False
    if need <= 0:
        return True
    for t in texts:
        ends = t.rstrip()[-1:] in MARKS and bool(_BROKEN.search(t))
        if (tail or ends) and len(t) < 200 or is_running(t, common):
            need -= len(t)
            if need <= 0:
                return True
        tail = ends
    return False


def _fault_rows(origin, doc, page, pos, text, counts) -> list[tuple]:
    found, _ = faults(page, pos, text, counts)
    return [(origin, doc, page[k], pos[k], f) for k, f in dict.fromkeys(found)]


def _paragraphs(origin, doc, page, pos, text, counts) -> list[tuple]:
    """Repaired text as paragraphs, placed at their first line. A block of a body is one, with the block that goes on with its last word; scanned lines run
    on until one is short: under 0.6 of the widest (a heading, a last line), or under 0.8 and at the end of a sentence."""
    _, fixed, goes_on = repair(page, pos, text, counts)
    widest = max((len(t) for t in fixed.values()), default=0)
    out, now, where, ended = [], [], None, False
    for k, t in fixed.items():
        t = t.strip()
        if now and ended and k not in goes_on:
            out.append((origin, doc, *where, " ".join(now)))
            now = []
        if t:
            where = where if now else (page[k], pos[k])
            now.append(t)
            ended = origin == "doc_bodies" or len(t) < 0.6 * widest or t[-1] in ".!?:" and len(t) < 0.8 * widest
    if now:
        out.append((origin, doc, *where, " ".join(now)))
    return out


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, 0.5, _fault_rows, "origin string, doc_id string, page int, pos int, fault string").distinct()


def p6_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, 0.5, _paragraphs, "origin string, doc_id string, page int, pos int, paragraph string")


QUERIES = {"p6_found": p6_found, "p6_paragraphs": p6_paragraphs}
SQL: dict[str, str] = {}
