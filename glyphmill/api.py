"""The archive's query surface over a data folder: one method per question a reader may ask."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import constants as K
from .operators import board, catalog, extract, search, structure
from .session import scratch_path
from .sources.files import write_postings
from .sources.tables import current_bodies, table


#: Files kept by hand beside the tables, one JSON object (or array of them) per board or machine: what a reader gets of them.
KEPT = {
    "chips": "board string, device string, part string, section string",
    "power": "machine string, title string, note string, fuses map<string,string>, rails map<string,string>, mains map<string,string>",
    "related": "board string, name string, kind string, detail string, confidence string",
    "boards": "slug string, name string, mfr string, year string, machine string",
}


class Archive:
    """Lazy frames over one data folder. The index is built once per object and written to the shared folder by shard; a search reads the shards of its terms. ``kept`` is a folder with
    the files of KEPT, each a folder or file of that name ending in .json; without it those questions have no rows."""

    def __init__(self, spark: SparkSession, sf_dir: str, kept: str | None = None):
        self.spark, self.dir, self.kept = spark, sf_dir, kept
        self._postings: DataFrame | None = None

    def _kept(self, name: str, key: str | None = None, value: str | None = None) -> DataFrame:
        rows = self.spark.createDataFrame([], KEPT[name]) if self.kept is None else self.spark.read.schema(KEPT[name]).option("multiLine", True).json(f"{self.kept}/{name}.json")
        return rows if key is None else rows.filter(F.col(key) == value)

    @staticmethod
    def _check(pattern: str, key: str) -> str:
        if not re.fullmatch(pattern, key):
            raise KeyError(key)
        return key

    def _t(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    def stats(self) -> DataFrame:
        return catalog.corpus_stats(self._t("machines"), self._t("docs"))

    def machines(self, q: str = "", limit: int | None = None, with_docs: bool = False, with_schematics: bool = False, with_board: bool = False) -> DataFrame:
        """Machines by rank, with ``total``, how many there are before the limit. All filters apply before it."""
        m, d = self._t("machines"), self._t("docs")
        slug = F.lower(F.trim("machine")).alias("slug")
        if with_docs:
            m = catalog.only(m, d.select(slug), "slug")
        if with_schematics:
            m = catalog.only(m, d.filter("schematic").select(slug), "slug")
        if with_board:
            m = catalog.only(m, self._kept("boards").select("slug"), "slug")
        return catalog.search_machines(m, q, limit)

    def machine(self, slug: str) -> DataFrame:
        return self._t("machines").filter(F.col("slug") == self._check(K.SLUG_KEY, slug))

    def doc(self, id_: str) -> DataFrame:
        """The current body with the fields of its first listing."""
        self._check(K.DOC_KEY, id_)
        d = catalog.first_wins(self._t("docs").filter(F.col("id") == id_)).select("id", "machine", "machine_name", "title", "doc_type", "src", "schematic", "parts")
        return current_bodies(self.spark, self.dir).filter(F.col("id") == id_).join(d, "id", "left")

    def chips(self, board_: str) -> DataFrame:
        return self._kept("chips", "board", self._check(K.BOARD_KEY, board_)).drop("board")

    def find_chip(self, board_: str, q: str) -> DataFrame:
        return board.find_chips(self.chips(board_), q)

    def signals(self, machine: str) -> DataFrame:
        """(signal, sheet, n) of a machine's scanned sheets."""
        from .plans.corpus import words

        m = self._check(K.SLUG_KEY, machine).lower()
        return extract.signal_index(words(self.spark, self.dir).filter(F.lower(F.trim("machine")) == m)).drop("machine")

    def signatures(self, machine: str) -> DataFrame:
        """(id, title) of the machine's documents on signature analysis."""
        m = self._check(K.SLUG_KEY, machine).lower()
        docs = catalog.last_wins(self._t("docs")).filter(F.lower(F.trim("machine")) == m)
        return extract.mentions(current_bodies(self.spark, self.dir), docs).select("id", "title")

    def power(self, machine: str) -> DataFrame:
        return self._kept("power", "machine", self._check(K.SLUG_KEY, machine)).drop("machine")

    def related(self, board_: str) -> DataFrame:
        return self._kept("related", "board", self._check(K.BOARD_KEY, board_))

    def boards(self) -> DataFrame:
        return board.boards_in_order(self._kept("boards"))

    def pdf(self, id_: str) -> DataFrame:
        self._check(K.DOC_KEY, id_)
        return catalog.first_wins(self._t("docs").filter(F.col("id") == id_)).select("id", "src")

    def parts(self, id_: str) -> DataFrame:
        self._check(K.DOC_KEY, id_)
        return extract.distinct_parts(extract.parts_rows(structure.page_texts(current_bodies(self.spark, self.dir).filter(F.col("id") == id_))), least=1)

    def diagnostics(self, machine: str) -> DataFrame:
        from .plans.corpus import outline_rows

        return extract.diagnostics(outline_rows(self.spark, self.dir), catalog.last_wins(self._t("docs"))).filter(F.lower(F.trim("machine")) == machine.lower())

    def chip(self, part: str) -> DataFrame:
        return catalog.chip_index(self._t("machines")).filter(F.col("chip") == part.lower())

    def postings(self) -> DataFrame:
        if self._postings is None:
            from .plans.corpus import postings

            path = scratch_path(self.spark, "postings")
            write_postings(postings(self.spark, self.dir), path)
            self._postings = self.spark.read.parquet(path)
        return self._postings

    def search(self, q: str, limit: int | None = None) -> DataFrame:
        """Ranked hits of all terms among catalogued documents, with the fields of the last listing."""
        d = catalog.last_wins(self._t("docs")).select(F.col("id").alias("doc"), "title", "machine")
        listed = self.postings().join(d.select("doc"), "doc", "left_semi")
        return search.search(listed, q, limit).join(d, "doc").orderBy(F.desc("hits"), F.desc("cnt_first"), "doc")

    def find(self, q: str) -> DataFrame:
        return structure.find_in_document(structure.page_texts(current_bodies(self.spark, self.dir)), q)
