"""The catalogue: lists, details, searches over a folder of registry files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators import search as S
from ..operators.store import TextStore
from ..sources import tsv
from ..sources.commits import files
from ..sources.registry import DATASETS
from ..sources.shared import shared_dir


def bare(value):
    """Without absent (null) columns, at every depth."""
    if isinstance(value, dict):
        return {k: bare(v) for k, v in value.items() if v is not None}
    return [bare(v) for v in value] if isinstance(value, list) else value


def compact(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


CHILDREN = ("presentations", "compositions", "avis_smr", "avis_asmr", "conditions")
GLOBAL = (("specialite", "specialites"), ("presentation", "presentations"), ("composition", "compositions"))


def rank_order() -> list:
    return [F.desc("_priority"), F.desc(F.round("_score", 6)), "_pos"]


@dataclass(frozen=True)
class Page:
    data: list[dict]
    pagination: dict
    metadata: dict

    def json(self) -> str:
        """Absent columns are left out, empty ones stay."""
        return compact({"data": bare(self.data), "pagination": self.pagination, "metadata": self.metadata})


def substances(compositions: DataFrame) -> DataFrame:
    """Rows per substance code with both code and name: the first name, and how many rows (not distinct drugs)."""
    named = compositions.where(R.present("code_substance", "denomination_substance"))
    found = R.first_and_count(named, "code_substance", "denomination_substance", ["_pos"], "medicaments_count")
    return found.select(F.col("_first._pos").alias("_pos"), F.col("code_substance").alias("code"), F.col("denomination_substance").alias("denomination"), "medicaments_count")


class Engine:
    """What a folder held when it was loaded: rows are parsed once and kept as Parquet in the shared folder, whatever
    becomes of the files, and an index of a dataset is built once, for its first search. ``reload`` swaps in a new load.
    ``names`` loads some datasets alone, and ``load`` more of them later."""

    def __init__(self, spark: SparkSession, folder: str, scoring: S.Scoring = S.Scoring(), names: Iterable[str] | None = None):
        self.spark, self.folder, self.scoring = spark, folder, scoring
        self.home = f"{shared_dir(spark)}/engine-{uuid.uuid4().hex}"
        self.tables: dict[str, DataFrame] = {}
        self.indexes: dict[str, TextStore] = {}
        self.load(*([name for name, d in DATASETS.items() if d.enabled] if names is None else names))
        self._date()

    def _date(self) -> None:
        self.loaded = tsv.modified_at(self.spark, f"{self.folder}/{DATASETS['specialites'].file}").first().asDict()

    def load(self, *names: str) -> "Engine":
        """Load datasets that are not there yet."""
        for name in names:
            d = DATASETS[name]
            if name in self.tables or not d.enabled:
                continue
            if name == "substances":
                self.load("compositions")
                self._keep(name, substances(self.tables["compositions"]))
            else:
                self._keep(name, tsv.scan(self.spark, f"{self.folder}/{d.file}", d))
                if name == "specialites":
                    self._date()
        return self

    def _keep(self, name: str, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.home}/tables/{name}")
        self.tables[name] = self.spark.read.schema(rows.schema).parquet(f"{self.home}/tables/{name}")

    def reload(self) -> "Engine":
        """Load the folder anew and swap it in at once; if that fails, the old load stays. Tables and pages that were
        taken from the old load still read it."""
        self.__dict__ = Engine(self.spark, self.folder, self.scoring, list(self.tables)).__dict__
        return self

    def drop(self) -> None:
        """Delete what is kept, when nothing reads it any more."""
        where, system = files(self.spark, self.home)
        system.delete(where, True)

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"no dataset {name}")
        return self.tables[name]

    def metadata(self) -> dict:
        return self.loaded

    def index(self, name: str) -> TextStore:
        if name not in self.indexes:
            self.indexes[name] = TextStore.create(self.table(name), "_pos", list(DATASETS[name].indexed), f"{self.home}/indexes/{name}", self.scoring)
        return self.indexes[name]

    def search(self, name: str, query: str = "") -> DataFrame:
        """Rows of a dataset in rank order columns ``_priority, _score, _pos``; the whole table without a query."""
        rows, d = self.table(name), DATASETS[name]
        return S.ranked(rows, "_pos", list(d.indexed), d.primary, query, self.scoring, self.index(name) if isinstance(query, str) and S.query_terms(query) else None)

    def _page(self, rows: DataFrame, order: list, number: int, limit: int) -> Page:
        shown = R.page(rows, order, number, limit).drop("_pos", "_priority", "_score", "_src")
        return Page([r.asDict(recursive=True) for r in shown.collect()], R.page_info(rows, number, limit).first().asDict(), self.metadata())

    def rows(self, name: str, q: str = "", page: int = 1, limit: int = 100) -> DataFrame:
        """A page of a dataset as a table."""
        return R.page(self.search(name, q), rank_order(), page, limit).drop("_pos", "_priority", "_score")

    def list(self, name: str, q: str = "", page: int = 1, limit: int = 100) -> Page:
        return self._page(self.search(name, q), rank_order(), page, limit)

    def details(self) -> DataFrame:
        """Every drug with nested children and the members of its first generic group; filter it by ``cis``."""
        return R.with_group(self._nested(), self.table("generiques"), "cis", "id_groupe", "libelle_groupe", "generiques")

    def _nested(self) -> DataFrame:
        rows = self.table("specialites")
        for name in CHILDREN:
            rows = R.nest(rows, self.table(name), "cis", name)
        return rows

    def detail(self, cis: str) -> dict | None:
        """One drug, its first row in file order; None if there is none."""
        found = R.first_match(self.details(), F.col("cis") == cis, ["_pos"]).drop("_pos").first()
        if found is None:
            return None
        row = found.asDict(recursive=True)
        return bare(row) | {"generiques": bare(row["generiques"]), "metadata": self.metadata()}

    def details_json(self, metadata: bool = True) -> DataFrame:
        """``_pos, cis, json`` of every drug, made where its rows are: absent columns are left out at every depth, a drug
        without a group has ``"generiques":null``."""
        rows = self._nested()
        absent = {"ignoreNullFields": "true"}
        own = F.to_json(F.struct(*(c for c in rows.columns if c != "_pos")), absent)
        # text of a group is made once and meets its members last: no shuffle or sort holds it for each of them
        members = self.table("generiques")
        first = R.first_group(members, "cis", "id_groupe", ["_pos"], "libelle_groupe").select("cis", F.col("id_groupe").alias("_group"), F.to_json(F.struct("id_groupe", "libelle_groupe"), absent).alias("_head"))
        texts = R.group_items(members, "id_groupe").select(F.col("id_groupe").alias("_group"), F.to_json("items", absent).alias("_items"))
        rows = rows.select("_pos", "cis", own.alias("_own")).join(first, "cis", "left").join(texts.hint("merge"), "_group", "left")
        own, head = F.col("_own"), F.col("_head")
        opened = lambda text: F.concat(text.substr(F.lit(1), F.length(text) - 1), F.when(text == "{}", "").otherwise(","))
        group = F.when(F.col("_items").isNull(), "null").otherwise(F.concat(opened(head), F.lit('"items":'), F.col("_items"), F.lit("}")))
        parts = [opened(own), F.lit('"generiques":'), group]
        if metadata:
            parts += [F.lit(',"metadata":' + compact(self.metadata()))]
        return rows.select("_pos", "cis", F.concat(*parts, F.lit("}")).alias("json"))

    def detail_json(self, cis: str) -> str | None:
        """One drug, its first row in file order; None if there is none."""
        found = R.first_match(self.details_json(), F.col("cis") == cis, ["_pos"]).first()
        return None if found is None else found.json

    def group_details(self, q: str) -> DataFrame:
        """Details of every member of the groups that a search finds, each once: a group is found by any of its rows."""
        groups = self.search("generiques", q).select("id_groupe").distinct()
        members = self.table("generiques").join(groups, "id_groupe", "left_semi").select("cis").distinct()
        return self.details().join(members, "cis", "left_semi")

    def search_all(self, q: str, page: int = 1, limit: int = 50) -> Page:
        """Three searches, one after the other, each in its own rank order."""
        if not q:
            raise ValueError("a query is needed")
        return self._page(self.found(q), ["_src", *rank_order()], page, limit)

    def found(self, q: str) -> DataFrame:
        """Hits of the three searches with their tag, unordered."""
        return R.tagged_union([(tag, self.search(name, q)) for tag, name in GLOBAL])

    def health(self, pretty: bool = False) -> str:
        return json.dumps({"status": "ok", **self.metadata()}, indent=2 if pretty else None, ensure_ascii=False)
