"""Full-text index: tokens, pruned and capped postings by shard, ranked all-terms search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import constants as K


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(token, doc, cnt): occurrences of every token of each document; null texts hold none."""
    t = docs.select(F.col(key).alias("doc"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(K.TOKEN), F.lit(0))).alias("token"))
    return t.groupBy("token", "doc").agg(F.count(F.lit(1)).alias("cnt"))


def shard_of(token: str = "token") -> Column:
    """The shard of a token: its first character if a letter or digit, else '_'."""
    c = F.substring(token, 1, 1)
    return F.when(c.rlike(r"^[a-z0-9]$"), c).otherwise(F.lit("_"))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def prune(counts: DataFrame, n_docs: DataFrame, ratio: float = K.MAX_DF_RATIO, least: int = K.MIN_DF_PRUNED) -> DataFrame:
    """Counts without tokens that more than ``ratio`` of all documents, and more than ``least``, hold. ``n_docs`` is a one-row frame (n).

    The few pruned tokens (fewer than 1 / ratio times the tokens per document) are anti-joined, so the counts aren't gathered by token for this.
    """
    hot = document_frequency(counts).crossJoin(F.broadcast(n_docs)).filter((F.col("df") > ratio * F.col("n")) & (F.col("df") > least)).select("token")
    return counts.join(hot, "token", "left_anti")


def capped_postings(counts: DataFrame, cap: int = K.MAX_POSTINGS) -> DataFrame:
    """(shard, token, doc, cnt): the ``cap`` documents with the greatest counts per token, ties by document.

    A token of a third of all documents would be one window group: each token is first cut to ``cap`` within salted parts, so that no task sorts more
    of a token than its part, and the window over the whole token sees ``cap`` rows per part at most. The cap is the index's feature.
    """
    salted = counts.withColumn("_part", F.pmod(F.xxhash64("doc"), F.lit(32)))
    part = W.partitionBy("token", "_part").orderBy(F.desc("cnt"), "doc")
    whole = W.partitionBy("token").orderBy(F.desc("cnt"), "doc")
    first = salted.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= cap)
    return first.withColumn("_r", F.row_number().over(whole)).filter(F.col("_r") <= cap).select(shard_of().alias("shard"), "token", "doc", "cnt")


def query_terms(q: str, least: int = 3) -> list[str]:
    """Terms of a query: split at white space, lower case, each once in order, those under ``least`` characters dropped; none for a query as short."""
    q = (q or "").strip().lower()
    return [] if len(q) < least else [t for t in dict.fromkeys(q.split()) if len(t) >= least]


def check_limit(limit: int | None, default: int, most: int) -> int:
    """0 and None mean the default; negative limits are refused."""
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    return min(limit or default, most)


def search(postings: DataFrame, q: str, limit: int | None = None) -> DataFrame:
    """(doc, hits, cnt_first, total): documents that hold every term, by summed counts, then the first term's count, then document; ``total`` before the limit.

    The shards of the terms are filtered along with the terms, so a table partitioned by shard is read only there; one aggregation intersects.
    """
    terms = query_terms(q)
    rows = postings.filter(F.col("token").isin(terms) & F.col("shard").isin(sorted({t[0] if t[0].isascii() and t[0].isalnum() else "_" for t in terms}))) if terms else postings.limit(0)
    first = F.max(F.when(F.col("token") == (terms[0] if terms else ""), F.col("cnt")))
    found = rows.groupBy("doc").agg(F.sum("cnt").alias("hits"), first.alias("cnt_first"), F.count_distinct("token").alias("_n")).filter(F.col("_n") == len(terms)).drop("_n")
    total = found.agg(F.count(F.lit(1)).alias("total"))
    top = found.orderBy(F.desc("hits"), F.desc("cnt_first"), "doc").limit(check_limit(limit, K.SEARCH_LIMIT, K.SEARCH_MOST))
    return top.crossJoin(F.broadcast(total))
