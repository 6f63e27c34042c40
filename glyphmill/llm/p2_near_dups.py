"""Problem 2: near-duplicate bodies by several global token orders.

The tokens are a text's distinct word sequences. Under each of ``ORDERS`` global orders (hash-seeded, the same for all texts) a text's prefix is its
first token of that order; a pair is a candidate if the prefixes agree under all orders of one of the groups, so the filters of a group are
intersected in the join key itself. The intersection over all orders then estimates the similarity, and what remains is
verified exactly on the whole token sets. Copies of one token set are one class and take part once.

Prefixes of one token make the filter probabilistic: a pair of similarity s is missed with (1 - s**4) ** 72, at s = 0.6 in 5 of 100,000
cases. README tells why the complete prefixes (40 % of each text) were measured and not taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.graph import components
from ..session import collect_garbage, materialize
from ..sources.tables import block_texts, current_bodies, first_titles, small_or_plain, table
from .hashing import U, Rolling, mix
from .p7_tokens import _steps

GROUP, GROUPS = 4, 72
ORDERS = GROUP * GROUPS
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
#: Fixed once: the orders from which a text without a token of its own in some order borrows one, attempt by attempt.
_BORROW = np.random.default_rng(7).integers(0, ORDERS, (64, ORDERS))
HOT, BLOCK = 200, 1000  # classes of one key from which they meet in blocks, and classes of a block
COPIES = 20  # classes of up to so many copies are expanded into all pairs
PART = 1000  # copies of a class that meet its links in one place


def token_sets(texts: list[str | None], words: int, least: int) -> list[np.ndarray | None]:
    """For each text its sorted distinct hashes of ``words`` following words (runs of a-z and 0-9 of the lower-cased text), or None for a text of fewer than ``least`` words."""
    joined = "\0".join((t or "").replace("\0", " ").lower() for t in texts) + "\0"
    raw = np.frombuffer(joined.encode("ascii", "replace"), np.uint8)
    word = np.zeros(len(raw) + 1, np.int8)
    word[:-1] = _WORD_BYTE[raw]
    edge = np.diff(word, prepend=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    stops = np.searchsorted(begin, np.flatnonzero(raw == 0))
    hashes = Rolling(raw).at(begin, end) if len(begin) else np.empty(0, np.uint64)
    out: list[np.ndarray | None] = []
    m = max(0, len(hashes) - words + 1)
    seq = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            seq = mix(seq * U(0x2545F4914F6CDD1D) + hashes[k : k + m])
    a = 0
    for b in stops:
        out.append(np.unique(seq[a : max(a, b - words + 1)]) if b - a >= max(least, words) else None)
        a = b
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One byte per text and order: a digest of the text's first token of that order. Each order ranks the tokens that fall to it; a text without
    any borrows that of another order, the same one for all texts."""
    n = np.array([len(s) for s in sets])
    h = np.concatenate(sets)
    own = np.repeat(np.arange(len(sets)), n)
    order = ((h >> U(32)) * U(ORDERS)) >> U(32)
    first = np.full(len(sets) * ORDERS, U(2**64 - 1))
    np.minimum.at(first, own * ORDERS + order.astype(np.int64), mix(h + U(0x1234567)))
    first = first.reshape(len(sets), ORDERS)
    none = first == U(2**64 - 1)
    had = ~none
    for source in _BORROW:
        rows = np.flatnonzero(none.any(1))
        if not len(rows):
            break
        can = none[rows] & had[rows][:, source]
        first[rows] = np.where(can, first[rows][:, source], first[rows])
        none[rows] &= ~can
    for r in np.flatnonzero(none.any(1)):  # very short texts: the next order that has one
        at = np.flatnonzero(had[r])
        first[r, none[r]] = first[r, at[np.searchsorted(at, np.flatnonzero(none[r])) % len(at)]]
    return (first & U(255)).astype(np.uint8)


def sketches(texts: DataFrame, words: int = 3, least: int = 20) -> DataFrame:
    """(id, n, same, sig) of each (id, text): number of tokens, hash of the whole token set, signature. Texts under ``least`` words give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("text")
            for a, b in _steps(col):
                sets = token_sets(col.slice(a, b - a).to_pylist(), words, least)
                keep = [k for k, s in enumerate(sets) if s is not None]
                if keep:
                    chosen = [sets[k] for k in keep]
                    sig = signatures(chosen)
                    with np.errstate(over="ignore"):
                        same = np.array([mix(s).sum(dtype=np.uint64) ^ (s[0] if len(s) else U(0)) for s in chosen], np.uint64)
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a).take(pa.array(keep)), pa.array([len(s) for s in chosen], pa.int32()), pa.array(same.view(np.int64)), pa.array([r.tobytes() for r in sig], pa.binary())], names=["id", "n", "same", "sig"])

    return texts.select("id", "text").mapInArrow(run, "id string, n int, same long, sig binary")


def _keys(classes: DataFrame) -> DataFrame:
    """(key, c, n): one row per class and group of orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 5000):
                part = batch.slice(a, 5000)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint8).reshape(-1, GROUPS, GROUP)
                key = np.ascontiguousarray(sig).view(np.uint32).reshape(-1, GROUPS).astype(np.int64) | np.arange(GROUPS, dtype=np.int64) << 32
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(part.column("same").to_numpy(), GROUPS)), pa.array(np.repeat(part.column("n").to_numpy(), GROUPS))], names=["key", "c", "n"])

    return classes.select("same", "n", "sig").mapInArrow(run, "key long, c long, n int")


def _agree(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, t: float) -> np.ndarray:
    """Whether two signatures agree under so many of all orders that a similarity of ``t`` isn't ruled out by 4.5 standard deviations."""
    seen = np.minimum(ORDERS, np.maximum(nx, ny))
    return (x == y).mean(1) >= t - 4.5 * np.sqrt(t * (1 - t) / seen)


def _hot_pairs(rows: DataFrame, t: float) -> DataFrame:
    """(x, y), x < y, of the classes that share a key of many classes and are likely of similarity ``t``; ``rows`` is (key, m, c, n, sig), ``m`` the classes of the key.

    The classes of a key are cut into blocks of about BLOCK, and each two blocks meet in one place, so no task holds more. There a pair counts only under the first group
    of orders in which it agrees, so that near copies, which agree in most groups, don't come out once for each.
    """
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = rows.withColumn("own", F.pmod(F.xxhash64("c"), blocks).cast("int"))
    spread = own.withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1))).select("key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "c", "n", "sig")

    def meet(group: pa.Table) -> pa.Table:
        g, i, j = (group.column(k)[0].as_py() for k in ("key", "i", "j"))
        g >>= 32
        own, c, n = (group.column(k).to_numpy() for k in ("own", "c", "n"))
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(-1, ORDERS)
        key = np.ascontiguousarray(sig).view(np.uint32).reshape(-1, GROUPS)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        xs, ys = [], []
        for a in left:
            b = right[right > a] if i == j else right
            b = b[np.minimum(n[a], n[b]) >= t * np.maximum(n[a], n[b])]
            for earlier in range(g):
                if not len(b):
                    break
                b = b[key[b, earlier] != key[a, earlier]]
            if len(b):
                b = b[_agree(sig[b], sig[a][None], n[b], n[a], t)]
                xs.append(np.minimum(c[a], c[b])), ys.append(np.maximum(c[a], c[b]))
        none = np.empty(0, np.int64)
        return pa.table({"x": np.concatenate(xs) if xs else none, "y": np.concatenate(ys) if ys else none})

    return spread.groupBy("key", "i", "j").applyInArrow(meet, "x long, y long")


def _likely(pairs: DataFrame, t: float) -> DataFrame:
    """The pairs (x, y, nx, ny, sx, sy) that are likely of similarity ``t``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 20_000):
                part = batch.slice(k, 20_000)
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(-1, ORDERS) for c in ("sx", "sy"))
                ok = _agree(x, y, part.column("nx").to_numpy(), part.column("ny").to_numpy(), t)
                yield part.select(["x", "y"]).filter(pa.array(ok))

    return pairs.select("x", "y", "sx", "sy", "nx", "ny").mapInArrow(run, "x long, y long")


def _verify(pairs: DataFrame, texts: DataFrame, t: float, words: int, least: int) -> DataFrame:
    """(id_x, id_y, similarity) of the pairs of ids that reach ``t`` on their whole token sets."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("text")
            for a, b in _steps(col):
                found = token_sets(col.slice(a, b - a).to_pylist(), words, least)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array([None if s is None else s.tobytes() for s in found], pa.binary())], names=["id", "tokens"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = []
            for x, y in zip(batch.column("tx"), batch.column("ty")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                sims.append(common / (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("id_x"), batch.column("id_y"), pa.array(sims, pa.float64())], names=["id_x", "id_y", "similarity"])

    tokens = materialize(texts.select("id", "text").mapInArrow(sets, "id string, tokens binary"), "tokens")
    both = pairs.join(tokens.select(F.col("id").alias("id_x"), F.col("tokens").alias("tx")), "id_x").join(tokens.select(F.col("id").alias("id_y"), F.col("tokens").alias("ty")), "id_y")
    return both.select("id_x", "id_y", "tx", "ty").mapInArrow(compare, "id_x string, id_y string, similarity double").filter(F.col("similarity") >= t)


def _members(sk: DataFrame, classes: DataFrame) -> DataFrame:
    return sk.select("id", "same").join(classes.select("same", F.col("rep").alias("class_rep"), "copies"), "same").select("id", "class_rep", "copies")


def near_duplicates(texts, t: float = 0.8, words: int = 5, least: int = 20) -> tuple[DataFrame, DataFrame]:
    """(links, members) of texts of Jaccard similarity ``t`` or more on their distinct sequences of ``words`` words.

    ``texts`` is (id, text) with unique ids, or a function of a frame of ids (or None for all) giving it, called twice: for the sketches and, with the
    ids that are left to verify, for their token sets. members: (id, class_rep, copies) with one row per text, texts of one token set sharing the
    representative (the least id). links: (id_x, id_y, similarity) between representatives, id_x < id_y. Null and empty texts and those of fewer than ``least`` words are in neither.
    """
    source = texts if callable(texts) else (lambda ids: texts if ids is None else texts.join(ids, "id", "left_semi"))
    sk = materialize(sketches(source(None), words, least), "sketches")
    collect_garbage(sk.sparkSession)
    classes = materialize(sk.groupBy("same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    members = _members(sk, classes)
    every = _keys(classes)
    hot = materialize(every.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > HOT), "hot")
    few = small_or_plain(hot)
    k = every.join(few, "key", "left_anti")
    x, y = k.select("key", F.col("c").alias("x"), F.col("n").alias("nx")), k.select("key", F.col("c").alias("y"), F.col("n").alias("ny"))
    near = x.join(y, "key").filter((F.col("x") < F.col("y")) & (F.least("nx", "ny") >= t * F.greatest("nx", "ny"))).select("x", "y", "nx", "ny").distinct()
    sig = classes.select("same", "sig")
    near = near.join(sig.toDF("x", "sx"), "x").join(sig.toDF("y", "sy"), "y")
    name = classes.select("same", "rep")
    crowded = every.join(few, "key").join(sig.withColumnRenamed("same", "c"), "c")
    pairs = _likely(near, t).union(_hot_pairs(crowded, t)).distinct().join(name.toDF("x", "rx"), "x").join(name.toDF("y", "ry"), "y")
    pairs = materialize(pairs.select(F.least("rx", "ry").alias("id_x"), F.greatest("rx", "ry").alias("id_y")), "pairs")
    collect_garbage(sk.sparkSession)
    ids = materialize(pairs.select(F.col("id_x").alias("id")).union(pairs.select("id_y")).distinct(), "ids")
    return materialize(_verify(pairs, source(small_or_plain(ids)), t, words, least), "verified"), members


def expand(links: DataFrame, members: DataFrame, most: int = COPIES, every: bool = True) -> DataFrame:
    """Pairs (id_a, id_b) of different ids. Every copy of a class is paired with every copy of a linked class. Within a class of up to ``most`` copies all pairs
    are given, in a larger one each copy with its representative, so that no pair count is the square of a class. Without ``every`` the links of a larger class
    stand for its representative only."""
    multi = members.filter("copies > 1")
    rows = members if every else members.filter((F.col("copies") <= most) | (F.col("id") == F.col("class_rep")))
    parts = F.ceil(F.col("copies") / PART).cast("int")
    rows = rows.select("class_rep", "id", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
    large = small_or_plain(members.filter((F.col("copies") > PART) & (F.col("id") == F.col("class_rep"))).select("class_rep", parts.alias("parts")))

    def members_of(df: DataFrame, rep: str, name: str) -> DataFrame:
        """``df`` with each member of the class ``rep``: a large class is cut by a hash of its ids, and its links go to every part."""
        spread = df.join(large.withColumnRenamed("class_rep", rep), rep, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        return spread.join(rows.toDF(rep, name, "part"), [rep, "part"]).drop(rep, "part")

    across = members_of(members_of(links.select("id_x", "id_y"), "id_x", "a"), "id_y", "b").select("a", "b")
    few = multi.filter(F.col("copies") <= most).select("class_rep", "id")
    within = few.toDF("class_rep", "a").join(few.toDF("class_rep", "b"), "class_rep").filter("a < b").select("a", "b")
    star = multi.filter((F.col("copies") > most) & (F.col("id") != F.col("class_rep"))).select(F.col("class_rep").alias("a"), F.col("id").alias("b"))
    return across.union(within).union(star).select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def body_texts(spark: SparkSession, sf_dir: str):
    """A function of ids for ``near_duplicates``: title of the first listing and all block texts of the current bodies, joined by blanks."""

    def texts(ids: DataFrame | None) -> DataFrame:
        bodies, titles = current_bodies(spark, sf_dir).select("id", F.array_join(block_texts(blank=True), " ").alias("body")), first_titles(table(spark, sf_dir, "docs"))
        if ids is not None:
            bodies, titles = bodies.join(ids, "id", "left_semi"), titles.join(ids, "id", "left_semi")
        return bodies.join(titles, "id", "left").select("id", F.concat_ws(" ", F.coalesce("title", F.lit("")), "body").alias("text"))

    return texts


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand(*near_duplicates(body_texts(spark, sf_dir), t=0.6, words=3))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per body that has text enough: its group (the least id of all it is linked with), copies of its token set, and links of its class to other classes."""
    links, members = near_duplicates(body_texts(spark, sf_dir), t=0.6, words=3)
    group = components(links, "id_x", "id_y")
    n = links.select(F.col("id_x").alias("r")).union(links.select("id_y")).groupBy("r").agg(F.count(F.lit(1)).alias("links"))
    return members.join(group, members.class_rep == group.node, "left").join(n, members.class_rep == n.r, "left").select(
        "id", F.coalesce("component", "class_rep").alias("group_id"), "copies", F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def p2_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, class_rep, copies) of the bodies that have text enough: bodies of one token set share the representative. With it the pairs that p2_found leaves out within classes of more than 20 copies are known."""
    sk = materialize(sketches(body_texts(spark, sf_dir)(None), 3, 20).select("id", "same"), "sketches")
    return _members(sk, sk.groupBy("same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups, "p2_copies": p2_copies}
_SQL = r"""WITH cur AS (SELECT id, pages FROM (SELECT id, pages, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) AS rn FROM doc_bodies WHERE id IS NOT NULL) WHERE rn = 1),
ti AS (SELECT id, arg_min(coalesce(title, ''), (coalesce(ord, 4611686018427387904), coalesce(title, ''))) AS title FROM docs WHERE id IS NOT NULL GROUP BY id),
pg AS (SELECT id, unnest(pages) AS p, generate_subscripts(pages, 1) AS pi FROM cur), bl AS (SELECT id, p.n AS n, pi, unnest(p.blocks) AS b, generate_subscripts(p.blocks, 1) AS bi FROM pg),
tx AS (SELECT cur.id, coalesce(title, '') || ' ' || coalesce(string_agg(b.t, ' ' ORDER BY n NULLS FIRST, pi, bi), '') AS text FROM cur LEFT JOIN bl ON bl.id = cur.id LEFT JOIN ti ON ti.id = cur.id GROUP BY cur.id, title),
wo AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM tx), sh AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM wo WHERE len(w) >= 20)),
n AS (SELECT id, count(*) AS n FROM sh GROUP BY id)"""
SQL = {
    "p2_found": _SQL + ", c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.id < b.id GROUP BY ALL) SELECT id_a, id_b FROM c JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE c >= 0.6 * (x.n + y.n - c)",
    "p2_groups": _SQL.replace("WITH cur", "WITH RECURSIVE cur", 1) + """, k AS (SELECT id, md5(string_agg(s, '|' ORDER BY s)) AS k FROM sh GROUP BY id), m AS (SELECT id, min(id) OVER (PARTITION BY k) AS rep, count(*) OVER (PARTITION BY k) AS copies FROM k),
rs AS (SELECT sh.* FROM sh JOIN m ON m.id = sh.id AND m.rep = m.id), c AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM rs a JOIN rs b ON a.s = b.s AND a.id <> b.id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c >= 0.6 * (x.n + y.n - c)), r(node, g) AS (SELECT a, a FROM e UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.node),
gr AS (SELECT node, min(g) AS g FROM r GROUP BY node), li AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT m.id, coalesce(g, rep) AS group_id, copies, coalesce(links, 0) AS links FROM m LEFT JOIN gr ON node = rep LEFT JOIN li ON a = rep""",
    "p2_copies": _SQL + ", k AS (SELECT id, md5(string_agg(s, '|' ORDER BY s)) AS k FROM sh GROUP BY id) SELECT id, min(id) OVER (PARTITION BY k) AS class_rep, count(*) OVER (PARTITION BY k) AS copies FROM k",
}
