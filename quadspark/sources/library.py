"""A library of ontologies: files found on a search path, kept as snapshots, read again when they change.

Each ontology's quads stand in the graph of its IRI. Files are looked at through
Spark's readers only, so a search path may lie in any store that Spark reaches.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as v
from . import ntriples, rdfxml
from .store import QuadStore

# The extensions that are tried, in this order.
EXTENSIONS = (".nt", ".ntriples", ".rdf", ".owl")


class Library:
    """Snapshots under ``folder``; ``search_path`` lists the folders in which ontology files are looked for."""

    def __init__(self, spark: SparkSession, folder: str, search_path: list[str]):
        self.spark, self.folder, self.search_path = spark, folder, search_path

    def _changed(self, path: str):
        """A file's time of change, or None where there is no such file."""
        try:
            return self.spark.read.format("binaryFile").load(path).agg(F.max("modificationTime")).first()[0]
        except AnalysisException:
            return None

    def find(self, iri: str) -> tuple[str, object] | None:
        """(path, time of change) of the ontology's file: the last part of its IRI in a folder of the search path, with each extension."""
        if iri.startswith("file://"):
            return (iri, t) if (t := self._changed(iri)) else None
        name = iri.rstrip("#/").rpartition("/")[2]
        for folder in self.search_path:
            for path in [f"{folder}/{name}{x}" for x in ("", *EXTENSIONS) if x or name.endswith(EXTENSIONS)]:
                if t := self._changed(path):
                    return path, t
        return None

    def _place(self, iri: str) -> str:
        return f"{self.folder}/{hashlib.blake2b(iri.encode(), digest_size=8).hexdigest()}"

    def loaded(self) -> DataFrame:
        """(iri, path, changed): what has been read, the last time of each."""
        shape = "iri string, path string, changed timestamp, seq long"
        try:
            rows = self.spark.read.schema(shape).parquet(f"{self.folder}/loaded")
        except AnalysisException:
            rows = self.spark.createDataFrame([], shape)
        return rows.groupBy("iri").agg(F.max_by("path", "seq").alias("path"), F.max_by("changed", "seq").alias("changed"))

    def load(self, iri: str, reload: bool = False, reload_if_newer: bool = False, imports: bool = True) -> QuadStore:
        """The ontology and, over any number of steps, those that it imports; each is read once, cycles or not."""
        todo, seen, stores = [iri], set(), []
        while todo:
            now = todo.pop(0)
            if now in seen:
                continue
            seen.add(now)
            store = self._one(now, reload, reload_if_newer)
            stores.append(store)
            if imports:
                todo += [r[0] for r in store.scan("objs", p=v.IMPORTS).select("o").distinct().collect()]  # metadata
        union = lambda kind: reduce(DataFrame.unionByName, [getattr(s, kind) for s in stores])
        out = QuadStore(union("objs"), union("datas"))
        return QuadStore(out.objs, out.datas, out.declared_inverses())

    def _one(self, iri: str, reload: bool, reload_if_newer: bool) -> QuadStore:
        known = self.loaded().where(F.col("iri") == iri).first()
        if known and not reload:
            if not reload_if_newer or (now := self.find(iri)) is None or now[1] <= known["changed"]:
                return QuadStore.load(self.spark, self._place(iri))
        found = self.find(iri)
        if found is None:
            raise FileNotFoundError(f"no file for {iri} on the search path")
        path, changed = found
        head = self.spark.read.text(path).where("value <> ''").limit(5).collect()
        text = "\n".join(r[0] for r in head)
        store = ntriples.read(self.spark, path, iri) if rdfxml.sniff(text) == "ntriples" else rdfxml.read(self.spark, path, iri, iri)
        store.save(self._place(iri))
        row = self.spark.createDataFrame([(iri, path, changed)], "iri string, path string, changed timestamp")
        seq = F.unix_micros(F.current_timestamp())
        row.withColumn("seq", seq).write.mode("append").parquet(f"{self.folder}/loaded")
        return QuadStore.load(self.spark, self._place(iri))


def base_iri(store: QuadStore, iri: str) -> str:
    """The ontology's IRI with the mark, ``#`` or ``/``, that more of its resources go on with; ``#`` where none does."""
    bare = iri.rstrip("#/")
    n = store.resources().agg(*(F.count_if(F.startswith("iri", F.lit(bare + m))).alias(name) for m, name in (("#", "h"), ("/", "s")))).first()
    return bare + ("/" if n["s"] > n["h"] else "#")
