"""Named collections of documents (id, vector, metadata) in a folder, and all that is done with them.

Every change is validated as a whole, then logged, then applied: its rows are written as
a Parquet delta beside the collection's base version, and a small metadata file, which is
replaced in one step, names the base and the deltas that count. Reading merges them: of every
id the last change counts. After `MAX_DELTAS` deltas, or when they have a fifth of
the base's rows, they are folded into a new base; the files of the last fold but one are
removed then. A change that was logged but not applied when the process ended is
applied when the database is opened again.

An index covers the base. A search asks it for the base's documents, compares the rows of
the deltas one by one, and merges both, so that an upsert or a removal rebuilds nothing; a
fold assigns the deltas' rows to the lists of an IVF index with the centroids as they are, and
has a graph built again when it is next asked for.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import Metric
from ..operators import hnsw, hybrid, ivf, search
from ..operators.filters import Dynamic, Filter, parse_filter
from ..sources import changelog, files, ndjson
from .schema import Schema

DOCS = "id string, vector array<double>, metadata string"
INDEX_TYPES = ("hnsw", "ivf")
MAX_DELTAS, MANY_ROWS, SMALL_K = 8, 100_000, 100_000


@dataclass
class Meta:
    """What is known of a collection beside its documents. dimension 0: not set yet."""

    name: str
    metric: str = "cosine"
    dimension: int = 0
    schema: str | None = None
    index_type: str = "none"
    version: str = ""
    rows: int = 0  # of the base
    deltas: list[str] = field(default_factory=list)
    delta_rows: int = 0
    old: list[str] = field(default_factory=list)  # versions that the last fold replaced
    index_version: str = ""
    centroids: list[list[float]] = field(default_factory=list)
    n_probe: int = 0  # of an IVF index, as measured when it was built; 0: all lists

    @property
    def typed(self) -> Schema | None:
        return Schema.parse(self.schema) if self.schema else None


@dataclass
class Explained:
    """What a search did, its plan, and its result."""

    query: Sequence[float]
    top_k: int
    index_type: str
    filter: Any
    scanned: int
    nanoseconds: int
    plan: str
    results: DataFrame


class Database:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.meta: dict[str, Meta] = {}
        self.seq = 0
        if files.exists(spark, self._file("meta.json")):
            raw = json.loads(files.read_text(spark, self._file("meta.json")))
            self.meta = {m["name"]: Meta(**m) for m in raw["collections"]}
            self.seq = raw["seq"]
        self._recover()

    def _file(self, *parts: str) -> str:
        return "/".join((self.path, *parts))

    def _save(self) -> None:
        files.write_text(self.spark, self._file("meta.json"), json.dumps({"seq": self.seq, "collections": [asdict(m) for m in self.meta.values()]}))

    def _get(self, name: str) -> Meta:
        if name not in self.meta:
            raise KeyError(f"no collection {name!r}")
        return self.meta[name]

    # Log and recovery

    def log(self) -> DataFrame:
        """(seq, line) of the changelog."""
        path = self._file("log")
        return self.spark.read.parquet(path) if files.exists(self.spark, path) else self.spark.createDataFrame([], "seq long, line string")

    def _write_log(self, event: Mapping[str, Any]) -> None:
        self.seq += 1
        changelog.append(self.spark, self._file("log"), [event], self.seq)

    def _recover(self) -> None:
        left = changelog.valid_prefix(self.log()).where(F.col("seq") > self.seq).orderBy("seq").collect()
        for r in left:  # at most what one interrupted call logged
            self._apply(json.loads(r["line"]))
            self.seq = r["seq"]
        if left:
            self._save()

    def _apply(self, e: Mapping[str, Any]) -> None:
        name = e["collection"]
        match e["action"]:
            case "create_collection":
                self.meta.setdefault(name, Meta(name, e.get("metric", "cosine"), schema=json.dumps(e["schema"]) if e.get("schema") else None))
            case "delete_collection":
                self.meta.pop(name, None)
            case "truncate_collection":
                if name in self.meta:
                    m = self.meta[name]
                    self._replace(m, "", 0)
                    self._forget_index(m)
            case "upsert" | "batch_upsert":
                if name in self.meta:
                    docs = e.get("documents") or [e["document"]]
                    self._put(self.meta[name], self._frame(docs))
            case "delete" | "batch_delete":
                if name in self.meta:
                    self._drop(self.meta[name], e.get("ids") or [e["id"]])

    # Collections

    def create_collection(self, name: str, metric: str = "cosine", schema: Schema | None = None, index_type: str | None = None) -> None:
        if not name:
            raise ValueError("a collection needs a name")
        if name in self.meta:
            raise ValueError(f"collection {name!r} is there already")
        if index_type is not None and index_type not in INDEX_TYPES:
            raise ValueError(f"unknown index type {index_type!r}")
        kind = str(Metric.parse(metric))
        event = {"action": "create_collection", "collection": name, "metric": kind}
        if schema:
            event["schema"] = json.loads(schema.to_json())
        self._write_log(event)
        self._apply(event)
        self.meta[name].index_type = index_type or "none"  # built when first searched
        self._save()

    def delete_collection(self, name: str) -> None:
        self._get(name)
        self._change({"action": "delete_collection", "collection": name})
        for kind in ("data", "index"):
            files.remove(self.spark, self._file(kind, name))

    def truncate(self, name: str) -> None:
        """Remove all documents and the index; the dimension stays."""
        self._get(name)
        self._change({"action": "truncate_collection", "collection": name})

    def _change(self, event: Mapping[str, Any]) -> None:
        self._write_log(event)
        self._apply(event)
        self._save()

    def list_collections(self) -> list[str]:
        return sorted(self.meta)

    def stats(self, name: str) -> dict[str, Any]:
        m = self._get(name)
        return {"doc_count": self.documents(name).count(), "dimension": m.dimension, "metric": m.metric, "index_type": m.index_type}

    def ping(self) -> dict[str, Any]:
        return {"status": "ok", "collections": len(self.meta)}

    # Documents

    def _base(self, m: Meta) -> DataFrame:
        return self.spark.read.parquet(self._file("data", m.name, m.version)) if m.version else self.spark.createDataFrame([], DOCS)

    def _changes(self, m: Meta) -> DataFrame:
        """(id, vector, metadata, gone): the last change of every id that the deltas have."""
        each = [self.spark.read.parquet(self._file("data", m.name, d)).withColumn("_nth", F.lit(i)) for i, d in enumerate(m.deltas)]
        return changelog.last_wins(reduce(DataFrame.unionByName, each), ["id"], ["_nth"]).drop("_nth")

    def documents(self, name: str) -> DataFrame:
        """(id, vector, metadata)."""
        m = self._get(name)
        if not m.deltas:
            return self._base(m)
        changes = self._changes(m)
        return self._base(m).join(changes.select("id"), "id", "left_anti").unionByName(changes.where("not gone").select("id", "vector", "metadata"))

    def _frame(self, docs: Sequence[Mapping[str, Any]]) -> DataFrame:
        rows = [(d.get("id"), [float(x) for x in d.get("vector") or []], json.dumps(d.get("metadata") or {}, ensure_ascii=False, separators=(",", ":")), i) for i, d in enumerate(docs)]
        return self.spark.createDataFrame(rows, DOCS + ", nth int")

    def upsert(self, name: str, document: Mapping[str, Any]) -> None:
        self._upsert(name, [document], {"action": "upsert", "collection": name, "document": document})

    def batch_upsert(self, name: str, documents: Sequence[Mapping[str, Any]]) -> int:
        """All or none; of equal ids in a batch the last wins. Returns the batch's size."""
        if not documents:
            raise ValueError("empty batch")
        self._upsert(name, documents, {"action": "batch_upsert", "collection": name, "documents": list(documents)})
        return len(documents)

    def _upsert(self, name: str, documents: Sequence[Mapping[str, Any]], event: Mapping[str, Any]) -> None:
        m = self._get(name)
        frame = self._frame(documents)
        self.validate(name, frame)
        self._write_log(event)
        self._put(m, frame)
        self._save()

    def load(self, name: str, docs: DataFrame) -> int:
        """Bulk upsert of (id, vector, metadata); validated in one job, and not logged: the new version is what endures."""
        m = self._get(name)
        frame = docs.select(F.col("id").cast("string"), F.col("vector").cast("array<double>"), F.coalesce(F.col("metadata"), F.lit("{}")).alias("metadata"), F.monotonically_increasing_id().alias("nth"))
        n = self.validate(name, frame)
        self._put(m, frame)
        self._save()
        return n

    def validate(self, name: str, frame: DataFrame) -> int:
        """Check a whole batch in one job; ValueError names the first fault by id. Returns the number of rows."""
        m = self._get(name)
        v = F.try_parse_json("metadata")
        wrong = m.typed.violation(v) if m.typed else F.lit(None).cast("string")
        size = F.size("vector")
        seen = frame.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("id").isNull() | (F.col("id") == ""), 1)).alias("no_id"), F.min(size).alias("low"), F.max(size).alias("high"), F.min(F.struct(F.when(wrong.isNull(), 1).otherwise(0).alias("ok"), F.col("id"), wrong.alias("field"))).alias("bad")).first()
        if seen["no_id"]:
            raise ValueError("a document needs an id")
        if seen["n"] and (seen["low"] != seen["high"] or (m.dimension and seen["low"] != m.dimension)):
            raise ValueError(f"vectors of {seen['low']} to {seen['high']} dimensions; the collection has {m.dimension or 'one number'}")
        if seen["n"] and seen["bad"]["ok"] == 0:
            raise ValueError(f"document {seen['bad']['id']!r}: field {seen['bad']['field']!r} has a wrong type")
        return seen["n"]

    def _put(self, m: Meta, frame: DataFrame) -> None:
        self._append(m, changelog.last_wins(frame, ["id"], ["nth"]).select("id", "vector", "metadata", F.lit(False).alias("gone")))
        if not m.dimension:
            first = self.documents(m.name).select(F.size("vector").alias("n")).first()
            m.dimension = max(0, first["n"]) if first else 0

    def _drop(self, m: Meta, ids: Sequence[str]) -> None:
        rows = self.spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string")
        self._append(m, rows.select("id", F.lit(None).cast("array<double>").alias("vector"), F.lit(None).cast("string").alias("metadata"), F.lit(True).alias("gone")))

    def _append(self, m: Meta, rows: DataFrame) -> None:
        if not m.version and not m.deltas:
            self._write(m, rows.where("not gone"))
            return
        delta = "delta-" + uuid.uuid4().hex
        path = self._file("data", m.name, delta)
        rows.write.parquet(path)
        m.deltas.append(delta)
        m.delta_rows += self.spark.read.parquet(path).count()
        if len(m.deltas) > MAX_DELTAS or m.delta_rows > MANY_ROWS and 5 * m.delta_rows > m.rows:
            self.compact(m)

    def compact(self, m: Meta) -> None:
        """Fold the deltas into a new base, and into an IVF index of the old one."""
        if not m.deltas:
            return
        before, path = m.version, self._index_path(m)
        lists, changes = None, self._changes(m)
        if m.index_type == "ivf" and m.index_version == before and files.exists(self.spark, path + "/_SUCCESS"):
            gone = changes.select(F.xxhash64("id").alias("id"))
            lists = self.spark.read.parquet(path).join(gone, "id", "left_anti").unionByName(self._listed(m, changes.where("not gone")))
        self._write(m, self.documents(m.name))
        if lists is not None:
            lists.write.mode("overwrite").partitionBy("cid").parquet(self._index_path(m))
            m.index_version = m.version
            files.remove(self.spark, path)

    def _write(self, m: Meta, docs: DataFrame) -> None:
        version = uuid.uuid4().hex
        path = self._file("data", m.name, version)
        docs.select("id", "vector", "metadata").write.parquet(path)
        self._replace(m, version, self.spark.read.parquet(path).count())

    def _replace(self, m: Meta, version: str, rows: int) -> None:
        for old in m.old:
            files.remove(self.spark, self._file("data", m.name, old))
        m.old = [x for x in (m.version, *m.deltas) if x]
        m.version, m.rows, m.deltas, m.delta_rows, m.index_version = version, rows, [], 0, ""

    def remove(self, name: str, id: str) -> None:
        self._get(name)
        self._change({"action": "delete", "collection": name, "id": id})

    def batch_remove(self, name: str, ids: Sequence[str]) -> int:
        """Unknown ids are ignored. Returns the number of ids given."""
        self._get(name)
        if not ids:
            raise ValueError("empty batch")
        self._change({"action": "batch_delete", "collection": name, "ids": list(ids)})
        return len(ids)

    # Indexes

    def _forget_index(self, m: Meta) -> None:
        m.index_type, m.index_version, m.centroids = "none", "", []

    def build_index(self, name: str, kind: str = "hnsw") -> None:
        m = self._get(name)
        if kind not in INDEX_TYPES:
            raise ValueError(f"unknown index type {kind!r}")
        m.index_type = kind
        m.index_version = ""
        self._index(m)
        self._save()

    def drop_index(self, name: str) -> None:
        self._forget_index(self._get(name))
        self._save()

    def index_info(self, name: str) -> str:
        return self.meta[name].index_type if name in self.meta else "none"

    def _numbered(self, docs: DataFrame) -> DataFrame:
        """Documents with a number for their string id, as the indexes store them."""
        return docs.withColumn("n", F.xxhash64("id"))

    def _listed(self, m: Meta, docs: DataFrame) -> DataFrame:
        """(id, v, cid, name, metadata): documents in the lists of m's centroids."""
        rows = self._numbered(docs)
        return ivf.assign(rows, np.array(m.centroids), "n").join(rows.select(F.col("n").alias("id"), F.col("id").alias("name"), "metadata"), "id")

    def _index_path(self, m: Meta) -> str:
        return self._file("index", m.name, m.version + "-" + m.index_type)

    def _index(self, m: Meta) -> DataFrame | None:
        """The stored index of the base, built if it is wanted and not there."""
        if m.index_type == "none" or not m.version:
            return None
        path = self._index_path(m)
        if m.index_version != m.version or not files.exists(self.spark, path + "/_SUCCESS"):
            docs = self._numbered(self._base(m))
            if docs.isEmpty():
                return None
            if m.index_type == "ivf":
                centroids = ivf.train(docs)
                m.centroids = centroids.tolist()
                m.n_probe = ivf.measured_probes(docs, centroids, m.metric, id_col="n")
                self._listed(m, self._base(m)).write.mode("overwrite").partitionBy("cid").parquet(path)
            else:
                hnsw.build(docs, metric=m.metric, id_col="n").write.mode("overwrite").parquet(path)
            m.index_version = m.version
            self._save()
        return self.spark.read.parquet(path)

    # Search

    def _where(self, given: Filter | Mapping | str | Column | None) -> Column | None:
        if isinstance(given, Column) or given is None:
            return given
        tree = given if isinstance(given, Filter) else parse_filter(given)
        return None if tree is None else tree.where(Dynamic(F.try_parse_json("metadata")))

    def search(self, name: str, query: Sequence[float], k: int = 10, where: Filter | Mapping | str | Column | None = None, exact: bool = False) -> DataFrame:
        """(rank, id, score, vector, metadata) of the k best documents that satisfy the filter.

        An empty query or one of another dimension finds nothing. With an index the
        search is approximate; a filter acts within it.
        """
        if k <= 0:
            raise ValueError("k must be positive")
        m = self._get(name)
        docs, wanted = self.documents(name), self._where(where)
        if not len(query) or (m.dimension and len(query) != m.dimension):
            return search.search(docs.where("false"), [0.0] * max(1, len(query)), k, m.metric).select("rank", "id", "score", F.lit(None).cast("array<double>").alias("vector"), F.lit(None).cast("string").alias("metadata"))
        index = None if exact else self._index(m)
        if index is None:
            found = search.search(docs, query, k, m.metric, wanted)
        else:
            found = self._indexed(m, index, query, k, wanted)
        return docs.join(F.broadcast(found) if k <= SMALL_K else found, "id").select("rank", "id", "score", "vector", "metadata").orderBy("rank")

    def _indexed(self, m: Meta, index: DataFrame, query: Sequence[float], k: int, wanted: Column | None) -> DataFrame:
        """(rank, id, score) of the base by its index and of the deltas by comparison."""
        changes = self._changes(m) if m.deltas else None
        if m.index_type == "ivf":
            lists = index.select(F.col("name").alias("id"), "v", "cid", "metadata")
            if changes is not None:
                lists = lists.join(changes.select("id"), "id", "left_anti")
            found = ivf.search(lists, np.array(m.centroids), query, k, m.n_probe or len(m.centroids), m.metric, wanted)
        else:
            one = self.spark.createDataFrame([(0, [float(x) for x in query])], "id long, vector array<double>")
            rows = self._numbered(self._base(m))
            allowed = None if wanted is None else rows.where(wanted).select(F.col("n").alias("id"))
            gone = None if changes is None else changes.select(F.xxhash64("id").alias("id"))
            hits = hnsw.search_batch(one, index, k, m.metric, deleted=gone, allowed=allowed).select("rank", F.col("id").alias("n"), "score")
            found = rows.select("id", "n").join(F.broadcast(hits) if k <= SMALL_K else hits, "n").select("rank", "id", "score")
        if changes is None:
            return found
        own = search.search(changes.where("not gone"), query, k, m.metric, wanted)
        return search.ranked(found.unionByName(own).select("id", "score"), k, F.col("score"), "id").select("rank", "id", "score")

    def hybrid_search(self, name: str, query: Sequence[float], text_query: str = "", k: int = 10, alpha: float = 0.5, where: Filter | Mapping | str | Column | None = None) -> DataFrame:
        """(rank, id, vector_score, text_score, combined_score), always by exact scores."""
        m = self._get(name)
        if len(query) and m.dimension and len(query) != m.dimension:
            raise ValueError(f"the collection has {m.dimension} dimensions")
        text = m.typed.text_field if m.typed else None
        docs = self.documents(name)
        if text:
            docs = docs.withColumn("text", Dynamic(F.try_parse_json("metadata")).text(text))
        return hybrid.search(docs, query, text_query, k, alpha, m.metric, self._where(where), text_col="text" if text else None)

    def recall(self, name: str, query: Sequence[float], k: int = 10) -> dict[str, Any]:
        """Of one query: the share of the exact result that the index finds; 1.0 without an index."""
        m = self._get(name)
        truth = {r["id"] for r in self.search(name, query, k, exact=True).select("id").collect()}
        if m.index_type == "none":
            return {"recall": 1.0, "ann_searched": False}
        found = {r["id"] for r in self.search(name, query, k).select("id").collect()}
        return {"recall": len(found & truth) / len(truth) if truth else 1.0, "ann_searched": True}

    def explain(self, name: str, query: Sequence[float], k: int = 10, where: Mapping | str | None = None) -> Explained:
        began = time.perf_counter_ns()
        plan = self.search(name, query, k, where)
        results = self.spark.createDataFrame(plan.collect(), plan.schema)  # k rows at most
        took = time.perf_counter_ns() - began
        m = self._get(name)
        probed = ivf.probes(np.array(m.centroids), query, m.n_probe or len(m.centroids)) if m.index_type == "ivf" and m.centroids else None
        index = self._index(m) if probed else None
        scanned = self.documents(name).count() if index is None else index.where(F.col("cid").isin(probed)).count() + m.delta_rows
        return Explained(query, k, m.index_type, where, scanned, took, plan._jdf.queryExecution().toString(), results)

    # Import, export, snapshots

    def export_ndjson(self, name: str, path: str) -> None:
        ndjson.export(self.documents(name), path)

    def import_ndjson(self, name: str, path: str) -> int:
        return self.load(name, ndjson.read(self.spark, path))

    def snapshot(self, path: str) -> None:
        """A full copy: documents of every collection and all metadata; the changelog begins anew."""
        for m in self.meta.values():
            self.documents(m.name).write.mode("overwrite").parquet(f"{path}/data/{m.name}")
        files.write_text(self.spark, f"{path}/meta.json", json.dumps({"version": 1, "collections": [asdict(m) for m in self.meta.values()]}))
        files.remove(self.spark, self._file("log"))
        self._save()

    def restore(self, path: str) -> None:
        """Replace everything by a snapshot, which is read before anything is given up. Indexes are built again when needed."""
        raw = json.loads(files.read_text(self.spark, f"{path}/meta.json"))
        if raw.get("version") != 1:
            raise ValueError("unknown snapshot version")
        fresh = {}
        for saved in raw["collections"]:
            m = Meta(**(saved | {"version": "", "rows": 0, "deltas": [], "delta_rows": 0, "old": [], "index_version": "", "centroids": []}))
            docs = self.spark.read.schema(DOCS).parquet(f"{path}/data/{m.name}")
            self._write(m, docs)
            fresh[m.name] = m
        self.meta = fresh
        files.remove(self.spark, self._file("log"))
        self._save()
