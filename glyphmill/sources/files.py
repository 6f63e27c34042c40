"""Readers and writers of the archive's file formats."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Schemas of the documents' JSON files; a missing key reads as null.
BODY = "id string, pages array<struct<n:int,words:int,blocks:array<struct<k:string,t:string>>,text:string>>, outline array<struct<t:string,lvl:int,p:int>>, meta struct<pageCount:int,bytes:bigint,words:int,blocks:int,sections:int>"
MACHINE = "slug string, name string, year string, mfr string, rom string, cpu array<struct<n:string,mhz:double>>, audio array<struct<n:string,mhz:double>>, display array<struct<type:string,rot:int,w:int,h:int,hz:double>>, input struct<p:int>"


def read_json_dir(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``key``, the file's name without ending; one-row count ``n`` of all files): one JSON object per file, files that can't be parsed are skipped but counted."""
    raw = spark.read.schema(schema + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    raw = raw.withColumn("key", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""))
    return raw.filter("_corrupt_record is null").drop("_corrupt_record"), raw.agg(F.count_distinct("key").alias("n"))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of files that hold one JSON array each, with ``ord``, the place in the file from 0. A missing key reads as null; a file that is no such array gives nothing."""
    text = spark.read.text(path, wholetext=True)
    rows = F.from_json("value", f"array<struct<{_fields(schema)}>>")
    return text.select(F.posexplode(rows).alias("ord", "r")).select("ord", "r.*")


def _fields(schema: str) -> str:
    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields)


def page_number(name: str = "name") -> Column:
    """The number at the end of a page image's name, so that page 10 comes after page 9; null without one."""
    return F.regexp_extract(F.col(name), r"-([0-9]+)\.[A-Za-z]+$", 1).try_cast("int")


def read_pages(spark: SparkSession, path: str, pages: list[int] | None = None) -> DataFrame:
    """(sheet, page, bytes, content) of page images, those of ``pages`` only if given; the sheet is the name without page number and ending."""
    f = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", "content")
    rows = f.select(F.regexp_replace("name", r"(-[0-9]+)?\.[^.]*$", "").alias("sheet"), page_number().alias("page"), F.col("length").alias("bytes"), "content")
    return rows if pages is None else rows.filter(F.col("page").isin(pages))


def trace_totals(raster: DataFrame, vector: DataFrame) -> DataFrame:
    """(sheet, pages, raster, vector, paths): pages traced, bytes of their images (sheet, page, bytes) and drawings (sheet, page, text), and paths drawn."""
    v = vector.select("sheet", "page", F.octet_length("text").alias("v"), F.regexp_count("text", F.lit("<path")).alias("p"))
    return raster.select("sheet", "page", "bytes").join(v, ["sheet", "page"]).groupBy("sheet").agg(F.count(F.lit(1)).alias("pages"), F.sum("bytes").alias("raster"), F.sum("v").alias("vector"), F.sum("p").alias("paths"))


def theme_aware(svg: str = "text") -> Column:
    """A traced drawing in the page's own colours: black ink becomes the current colour, and a sheet of paper lies behind it."""
    ink = F.replace(F.col(svg), F.lit('fill="#000000"'), F.lit('fill="currentColor"'))
    return F.regexp_replace(ink, r"^([\s\S]*?<svg[^>]*>)", '$1<rect width="100%" height="100%" fill="var(--paper,#fff)"/>')


def read_symbols(spark: SparkSession, path: str, most: int = 4) -> DataFrame:
    """(symbol, pin, name, kind) of the symbols in library files; a symbol that extends another has the pins of the one at the end of the chain, ``most`` steps away at most."""
    head = re.compile(r'^\s*\(symbol\s+"([^"]*)"', re.M)
    base = re.compile(r'\(extends\s+"([^"]*)"')
    pin = re.compile(r'\(pin\s+(\w+)\s.*?\(name\s+"([^"]*)".*?\(number\s+"([^"]*)"', re.S)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["value"]:
                starts = list(head.finditer(text))
                top = [m for m in starts if not re.search(r"_\d+_\d+$", m[1])]  # parts of a symbol are named after it
                for m, nxt in zip(top, top[1:] + [None]):
                    body = text[m.start() : nxt.start() if nxt else len(text)]
                    up = base.search(body)
                    rows.append((m[1], up[1] if up else None, [(x[3], x[2], x[1]) for x in pin.finditer(body)]))
            yield pd.DataFrame(rows, columns=["symbol", "base", "pins"])

    s = spark.read.text(path, wholetext=True).mapInPandas(run, "symbol string, base string, pins array<struct<pin:string,name:string,kind:string>>").dropDuplicates(["symbol"])
    chain = s.select("symbol", "base", "pins")
    for _ in range(most):
        up = s.select(F.col("symbol").alias("base"), F.col("base").alias("_base"), F.col("pins").alias("_pins"))
        chain = chain.join(up, "base", "left").select("symbol", F.col("_base").alias("base"), F.when(F.col("base").isNotNull(), F.col("_pins")).otherwise(F.col("pins")).alias("pins"))
    return chain.select("symbol", F.explode("pins").alias("p")).select("symbol", "p.pin", "p.name", "p.kind")


def read_ocr_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Words of tab-separated recogniser output: (file, block, par, line, word, t, x, y, w, h, c); rows that aren't words or whose numbers don't parse are dropped."""
    raw = spark.read.option("sep", "\t").option("quote", "").option("header", True).csv(path)
    num = lambda c, k="int": F.col(c).try_cast(k)
    out = raw.filter((F.col("level") == "5") & (F.trim("text") != "")).select(F.col("_metadata.file_name").alias("file"), num("block_num").alias("block"), num("par_num").alias("par"), num("line_num").alias("line"), num("word_num").alias("word"), F.trim("text").alias("t"), num("left").alias("x"), num("top").alias("y"), num("width").alias("w"), num("height").alias("h"), num("conf", "double").alias("c"))
    return out.na.drop(subset=["x", "y", "w", "h", "c"])


def ocr_lines(words: DataFrame) -> DataFrame:
    """(file, b, pa, line, t, x, y, w, h, c): words joined in order, their box and mean confidence to one decimal."""
    g = words.groupBy("file", F.col("block").alias("b"), F.col("par").alias("pa"), "line").agg(
        F.array_sort(F.collect_list(F.struct("word", "t"))).alias("a"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("r"), F.max(F.col("y") + F.col("h")).alias("d"), F.bround(F.avg("c"), 1).alias("c"))
    return g.select("file", "b", "pa", "line", F.array_join(F.transform("a", lambda s: s["t"]), " ").alias("t"), "x", "y", (F.col("r") - F.col("x")).alias("w"), (F.col("d") - F.col("y")).alias("h"), "c")


def read_bom_csv(spark: SparkSession, path: str) -> DataFrame:
    """(refs array, part, qty): columns found by name; a missing, unreadable or zero quantity is 1."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    find = lambda p: next((c for c in raw.columns if re.search(p, c, re.I)), None)
    ref, val, qty = find(r"ref|desig"), find(r"val|part"), find(r"q(ua)?n?ti?ty|qty|count")
    q = F.col(qty).try_cast("int") if qty else F.lit(None).cast("int")
    return raw.select(F.filter(F.split(F.coalesce(F.col(ref), F.lit("")), r"\s*,\s*"), lambda x: x != "").alias("refs"), F.col(val).alias("part"), F.coalesce(F.when(q != 0, q), F.lit(1)).alias("qty"))


def write_bom_csv(bom: DataFrame, path: str) -> None:
    """Reference, Value, Quantity, the largest quantities first: one file per range, each with a header, in order of their names."""
    bom.select(F.col("refs").alias("Reference"), F.col("part").alias("Value"), F.col("qty").alias("Quantity")).orderBy(F.desc("Quantity"), "Value").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_postings(postings: DataFrame, path: str) -> None:
    """One folder per shard; what was there before goes."""
    postings.repartition("shard", F.pmod(F.xxhash64("token"), F.lit(8))).write.mode("overwrite").partitionBy("shard").parquet(path)


def write_json_by_key(df: DataFrame, key: str, path: str) -> None:
    df.write.mode("overwrite").partitionBy(key).option("ignoreNullFields", True).json(path)


def file_audit(spark: SparkSession, path: str, most_files: int = 19_000, most_bytes: int = 25 * 2**20) -> DataFrame:
    """(files, bytes, largest, too_many, too_large) of a folder, from file listings alone."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length")
    return f.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.max("length").alias("largest"), F.count_if(F.col("length") > most_bytes).alias("too_large")).withColumn("too_many", F.col("files") > most_files)


def read_board_text(spark: SparkSession, path: str) -> DataFrame:
    """(board, ref, value, footprint) of footprints in S-expression board files."""
    foot = re.compile(r'\(footprint\s+"([^"]*)"(.*?)(?=\n\s*\(footprint\s|\Z)', re.S)
    prop = re.compile(r'\(property\s+"(Reference|Value)"\s+"([^"]*)"')

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for board, text in zip(pdf["board"], pdf["value"]):
                for m in foot.finditer(text):
                    p = dict(prop.findall(m[2]))
                    rows.append((board, p.get("Reference"), p.get("Value"), m[1]))
            yield pd.DataFrame(rows, columns=["board", "ref", "value", "footprint"])

    return spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("board"), "value").mapInPandas(run, "board string, ref string, value string, footprint string")


def run_tool(files: DataFrame, tool: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """Rows an external tool (rasteriser, recogniser) makes of each binary file; a file that fails gives one row with ``error`` only. ``tool`` is passed in; none is bundled."""

    kinds = to_arrow_schema(StructType.fromDDL(f"path string, {schema}, error string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    out += [{**r, "path": path} for r in tool(content.as_py())]
                except Exception as e:  # one bad file doesn't end the job
                    out.append({"path": path, "error": str(e)})
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return files.select("path", "content").mapInArrow(run, f"path string, {schema}, error string")
