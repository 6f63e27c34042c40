"""Problem 5: occurrences and documents of every term, by a range-partitioned external sort and a run-length scan.

Pairs (term, document, count) are counted within each document before they move, sorted across the cluster by ranges of (term,
document), so that even one term that a third of all pairs hold is spread over several ranges, and scanned in order in one pass with
constant memory; the runs of a term that crosses a range border are added up at the end.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialize
from ..sources.tables import block_texts, current_bodies, table

TERM = r"[a-z]{3,}|[a-z]{0,3}[0-9]{2,}[a-z0-9]*"
RANGE_ROWS, MOST_RANGES = 1_000_000, 100_000
#: Sorts before every term; one pair per document that holds any term, so that its run counts those documents.
ANY = ""


def term_pairs(texts: DataFrame, key: str = "id", text: str = "t") -> DataFrame:
    """(term, doc, cnt) of every document, ``doc`` the 64-bit hash of the key, with a pair (ANY, doc, 0) for each that holds a term.

    ``text`` is an array of texts; terms never span two of them. Null keys and texts give nothing.
    """
    find = re.compile(TERM).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("term", pa.string()), ("doc", pa.int64()), ("cnt", pa.int64())])
        for batch in batches:
            terms, docs, counts = [], [], []
            for d, t in zip(batch.column("doc").to_pylist(), batch.column("t").to_pylist()):
                c = Counter(find(t.lower()))
                if c:
                    terms.append(ANY), counts.append(0)
                    terms.extend(c), counts.extend(c.values())
                    docs.extend([d] * (len(c) + 1))
                if len(terms) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(docs, pa.int64()), pa.array(counts, pa.int64())], schema=schema)
                    terms, docs, counts = [], [], []
            if terms:
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(docs, pa.int64()), pa.array(counts, pa.int64())], schema=schema)

    rows = texts.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.xxhash64(key).alias("doc"), F.array_join(F.col(text), "\n").alias("t"))
    return rows.mapInArrow(run, "term string, doc long, cnt long")


def posting_pairs(postings: DataFrame) -> DataFrame:
    """(term, doc, cnt) of an index: tokens trimmed and in lower case, nulls and blanks left out, null counts as 0. Rows may repeat. As in ``term_pairs`` each document
    that holds a term has a pair (ANY, doc, 0): one listed here alone counts as a document too."""
    term = F.trim(F.lower("token"))
    rows = postings.select(term.alias("term"), F.xxhash64("doc_id").alias("doc"), F.coalesce(F.col("cnt").cast("long"), F.lit(0).cast("long")).alias("cnt"), "doc_id").filter("term is not null and term <> '' and doc_id is not null").select("term", "doc", "cnt")
    return rows.unionByName(rows.select("doc").distinct().select(F.lit(ANY).alias("term"), "doc", F.lit(0).cast("long").alias("cnt")))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run lengths over rows in order of (term, doc). Of several rows of one pair the greatest count holds."""
    schema = pa.schema([("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
    term, doc, top, n, docs = None, None, 0, 0, 0

    def row(*x):
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(x, schema)], schema=schema)

    for b in batches:
        if not b.num_rows:
            continue
        t, d, c = b.column("term"), b.column("doc").to_numpy(), b.column("cnt").to_numpy()
        import numpy as np

        starts = np.ones(b.num_rows, bool)
        starts[1:] = pc.not_equal(t.slice(1), t.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        fresh = starts.copy()
        fresh[1:] |= d[1:] != d[:-1]
        p = np.flatnonzero(fresh)
        per = np.maximum.reduceat(c, p)
        run_at = np.flatnonzero(starts[p])
        sums, counts = np.add.reduceat(per, run_at), np.diff(np.append(run_at, len(p)))
        names = t.take(pa.array(p[run_at])).to_pylist()
        first, last = names[0], len(names) - 1
        if first == term:  # the open run goes on, perhaps within the same pair
            same = d[0] == doc
            n += int(sums[0]) - (min(top, int(per[0])) if same else 0)
            docs += int(counts[0]) - same
            if last == 0:
                top = max(top, int(per[0])) if same and len(p) == 1 else int(per[-1])
                doc = d[-1]
                continue
        if term is not None:
            yield row(term, n, docs)
        a = int(first == term)
        if last > a:
            yield pa.RecordBatch.from_arrays([pa.array(names[a:last], pa.string()), pa.array(sums[a:last], pa.int64()), pa.array(counts[a:last], pa.int64())], schema=schema)
        term, n, docs, doc, top = names[last], int(sums[last]), int(counts[last]), d[-1], int(per[-1])
    if term is not None:
        yield row(term, n, docs)


def _merge_borders(runs: DataFrame) -> DataFrame:
    return runs.groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def term_counts(pairs: DataFrame, partitions: int | None = None) -> DataFrame:
    """(term, n, docs) of every term of ``pairs`` (term, doc, cnt); ``partitions`` ranges, else one for each RANGE_ROWS pairs, but as many as the session shuffles into at least
    and MOST_RANGES at most (a larger range is sorted with spilling).

    Rows of one pair may repeat anywhere, but those of one pair fall into one range, since ranges are cut between pairs. The pairs are
    written first: the ranges are found by a sample, which would otherwise count the terms of all texts once more.
    """
    keys = ["term", "doc"]
    pairs = materialize(pairs, "pairs")
    if not partitions:
        partitions = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, pairs.count() // RANGE_ROWS))
    return _merge_borders(pairs.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).mapInArrow(_scan, "term string, n long, docs long"))


def mark_terms(counts: DataFrame, rare: int = 3, common: float = 0.4) -> DataFrame:
    """Add ``mark``: 'rare' for terms of fewer than ``rare`` documents, 'common' for those of more than the share ``common`` of the
    documents that hold any term, else null; 'rare' goes before 'common' in tiny collections. The row of ANY is used up. ``counts`` is read twice."""
    total = counts.filter(F.col("term") == ANY).select(F.col("docs").alias("_all"))
    mark = F.when(F.col("docs") < rare, "rare").when(F.col("docs") > common * F.col("_all"), "common")
    return counts.filter(F.col("term") != ANY).crossJoin(F.broadcast(total)).select("term", "n", "docs", mark.alias("mark"))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = term_pairs(current_bodies(spark, sf_dir).select("id", block_texts(blank=True).alias("t")))
    return mark_terms(materialize(term_counts(bodies.unionByName(posting_pairs(table(spark, sf_dir, "postings")))), "terms"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).filter("mark is not null").select(F.col("term").alias("token"), "mark")


def p5_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).select(F.col("term").alias("token"), "n", "docs", "mark")


QUERIES = {"p5_found": p5_found, "p5_terms": p5_terms}

_SQL = """WITH cur AS (SELECT id, pages FROM (SELECT id, pages, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) AS rn FROM doc_bodies WHERE id IS NOT NULL) WHERE rn = 1),
b AS (SELECT id, unnest(pages).blocks AS bl FROM cur), t AS (SELECT id, unnest(bl).t AS t FROM b),
w AS (SELECT id, unnest(regexp_extract_all(lower(t), '[a-z]{3,}|[a-z]{0,3}[0-9]{2,}[a-z0-9]*')) AS token FROM t WHERE t IS NOT NULL),
g AS (SELECT token, id, count(*) AS c FROM w GROUP BY ALL UNION ALL SELECT trim(lower(token)), doc_id, coalesce(cnt, 0) FROM postings WHERE trim(lower(token)) <> '' AND doc_id IS NOT NULL),
p AS (SELECT token, id, max(c) AS c FROM g GROUP BY ALL), a AS (SELECT count(DISTINCT id) AS n FROM p),
r AS (SELECT token, CAST(sum(c) AS BIGINT) AS n, count(*) AS docs FROM p GROUP BY token),
m AS (SELECT token, r.n, docs, CASE WHEN docs < 3 THEN 'rare' WHEN docs > 0.4 * a.n THEN 'common' END AS mark FROM r, a)
"""
SQL = {"p5_found": _SQL + "SELECT token, mark FROM m WHERE mark IS NOT NULL", "p5_terms": _SQL + "SELECT token, n, docs, mark FROM m"}
