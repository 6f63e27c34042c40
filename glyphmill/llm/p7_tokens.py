"""Problem 7: the whole corpus as ids of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import table
from . import bpe

STEP_CHARS = 2_000_000  # texts encoded in one go


def _steps(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Slices of a column of texts of at most ``STEP_CHARS`` bytes each, or of one text."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + STEP_CHARS, side="right")))
        yield at, to
        at = to


def encode(df: DataFrame, text: str = "text", keys: list[str] | None = None, tokenizer: str | None = None, only_count: bool = False) -> DataFrame:
    """``keys`` (default doc_id) and ``ids``, the token ids of ``text`` without special tokens, or ``n_tokens`` with ``only_count``.

    Null, and empty, texts give an empty list. Text that looks like a special token is ordinary text. Equal rows give a row each.
    """
    keys = keys or ["doc_id"]
    path = tokenizer or bpe.vocabulary()
    src = df.select(*(F.col(f"`{k}`") for k in keys), F.col(f"`{text}`").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path)
        for batch in batches:
            col = batch.column(batch.num_columns - 1)
            for a, b in _steps(col):
                flat, ends = coder.encode(col.slice(a, b - a).to_pylist())
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                made = pa.array(np.diff(offsets).astype(np.int64)) if only_count else pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keys))), made], names=[*keys, "n_tokens" if only_count else "ids"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{kinds}, " + ("n_tokens long" if only_count else "ids array<int>"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


QUERIES = {"p7_ids": p7_ids}
SQL: dict[str, str] = {}
