"""A thin JSON service over a Database, on the standard library's HTTP server.

`Service.handle` maps a request to a status and a body and needs no socket. All
errors of the caller are 400 with {"error"}; unknown paths are 404.
"""

from __future__ import annotations

import json
import re
import signal
import sys
import threading
import time
from collections import Counter
from collections.abc import Callable, Sequence
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .plans.database import Database
from .plans.schema import Schema
from .sources import ndjson

Body = dict[str, Any]


def _number(body: Body, name: str, default: int) -> int:
    k = int(body.get(name, default))
    return k if k > 0 else default


class Service:
    def __init__(self, db: Database, config: Config | None = None):
        self.db, self.config = db, config or Config()
        self.count: Counter[str] = Counter()
        self.began = time.time()
        one = r"/collections/([^/]+)"
        self.routes: list[tuple[str, str, Callable[..., Any]]] = [
            ("GET", "/collections", self.list), ("POST", "/collections", self.create), ("GET", f"{one}/stats", self.stats), ("POST", f"{one}/upsert", self.upsert), ("POST", f"{one}/batch-upsert", self.batch_upsert),
            ("POST", f"{one}/batch-delete", self.batch_delete), ("POST", f"{one}/truncate", self.truncate), ("DELETE", f"{one}/delete", self.delete), ("POST", f"{one}/search", self.search), ("POST", f"{one}/explain", self.explain),
            ("POST", f"{one}/hybrid-search", self.hybrid), ("POST", f"{one}/recall", self.recall), ("GET", f"{one}/index", self.index), ("POST", f"{one}/index", self.index_action), ("GET", f"{one}/export", self.export),
            ("POST", f"{one}/import", self.import_lines), ("POST", "/snapshot", self.snapshot), ("POST", "/restore", self.restore), ("GET", "/health", lambda _: {"status": "ok"}), ("GET", "/ready", lambda _: db.ping()), ("GET", "/metrics", self.metrics),
        ]

    def handle(self, method: str, path: str, raw: str = "") -> tuple[int, Any]:
        """Status and body: a str is text as it is, anything else JSON."""
        for verb, pattern, run in self.routes:
            m = re.fullmatch(pattern, path)
            if verb != method or not m:
                continue
            try:
                body = raw if run == self.import_lines else json.loads(raw) if raw else {}
                if not isinstance(body, (dict, str)):
                    raise ValueError("the body must be an object")
                out = run(*m.groups(), body)
                return (201 if run == self.create else 200), out
            except (ValueError, KeyError, TypeError) as e:
                return 400, {"error": str(e.args[0]) if e.args else str(e)}
        return 404, {"error": "no such path"}

    # Collections

    def list(self, _: Body) -> list[Body]:
        return [{"name": n, **self.stats(n, {})} for n in self.db.list_collections()]

    def create(self, body: Body) -> Body:
        schema = Schema.parse(body["schema"]) if isinstance(body.get("schema"), dict) else None
        wanted = body.get("index_type", "hnsw") if body.get("enable_index") else None
        self.db.create_collection(body.get("name", ""), body.get("metric", "cosine"), schema, wanted)
        return {"status": "created", "index": wanted is not None} | ({"index_type": wanted} if wanted else {})

    def stats(self, name: str, _: Body) -> Body:
        s = self.db.stats(name)
        return {"count": s["doc_count"], **{k: s[k] for k in ("dimension", "metric", "index_type")}}

    def delete(self, name: str, _: Body) -> Body:
        self.db.delete_collection(name)
        return {"status": "deleted"}

    def truncate(self, name: str, _: Body) -> Body:
        self.db.truncate(name)
        return {"status": "truncated"}

    # Documents

    def upsert(self, name: str, body: Body) -> Body:
        self.db.upsert(name, body)
        self.count["upsert"] += 1
        return {"status": "upserted"}

    def batch_upsert(self, name: str, body: Body) -> Body:
        n = self.db.batch_upsert(name, body.get("documents") or [])
        self.count["upsert"] += n
        return {"status": "upserted", "count": n}

    def batch_delete(self, name: str, body: Body) -> Body:
        n = self.db.batch_remove(name, body.get("ids") or [])
        self.count["delete"] += n
        return {"status": "deleted", "count": n}

    def export(self, name: str, _: Body) -> str:
        return "".join(r["line"] + "\n" for r in ndjson.to_lines(self.db.documents(name)).toLocalIterator())

    def import_lines(self, name: str, body: str) -> Body:
        spark = self.db.spark
        lines = spark.createDataFrame([(i + 1, x) for i, x in enumerate(body.splitlines())] or [(1, "")], "n int, line string")
        docs = ndjson.parse(lines)
        bad = docs.where("error is not null").orderBy("n").first()
        if bad:
            raise ValueError(f"line {bad['n']}: {bad['error']}")
        return {"status": "imported", "count": self.db.load(name, docs.select("id", "vector", "metadata"))}

    # Search

    def _query(self, body: Body) -> list[float]:
        q = body.get("query", [])
        if not isinstance(q, list) or not all(isinstance(x, (int, float)) for x in q):
            raise ValueError("query must be an array of numbers")
        return [float(x) for x in q]

    def _rows(self, found: DataFrame, *scores: str) -> list[Body]:
        return [{"id": r["id"], **{s: r[s] for s in scores}, "document": {"id": r["id"], "vector": r["vector"], "metadata": json.loads(r["metadata"])}} for r in found.orderBy("rank").collect()]

    def _timed(self, run: Callable[[], Any]) -> tuple[Any, int]:
        began = time.perf_counter_ns()
        self.count["search"] += 1
        out = run()
        took = time.perf_counter_ns() - began
        self.count["search_ns"] += took
        return out, took

    def search(self, name: str, body: Body) -> Body:
        rows, took = self._timed(lambda: self._rows(self.db.search(name, self._query(body), _number(body, "k", 10), body.get("filter")), "score"))
        return {"results": rows, "total_time_ns": took, "docs_scanned": self.db.documents(name).count(), "index_used": self.db.index_info(name)}

    def hybrid(self, name: str, body: Body) -> Body:
        def run() -> list[Body]:
            found = self.db.hybrid_search(name, self._query(body), body.get("text_query", ""), _number(body, "k", 10), float(body.get("alpha", 0.5)), body.get("filter"))
            return self._rows(self.db.documents(name).join(F.broadcast(found), "id"), "vector_score", "text_score", "combined_score")

        rows, took = self._timed(run)
        return {"results": rows, "total_time_ns": took}

    def explain(self, name: str, body: Body) -> Body:
        said = self.db.explain(name, self._query(body), _number(body, "k", 10), body.get("filter"))
        rows = self._rows(said.results, "score")
        return {"query": said.query, "top_k": said.top_k, "index_type": said.index_type, "candidates": said.scanned, "results_returned": len(rows), "filter_applied": body.get("filter"), "search_time_ns": said.nanoseconds, "plan": said.plan, "results": rows}

    def recall(self, name: str, body: Body) -> Body:
        q, k = self._query(body), _number(body, "k", 10)
        exact, exact_ns = self._timed(lambda: self._rows(self.db.search(name, q, k, exact=True), "score"))
        near, near_ns = self._timed(lambda: self._rows(self.db.search(name, q, k), "score"))
        truth = {r["id"] for r in exact}
        kind = self.db.index_info(name)
        share = len(truth & {r["id"] for r in near}) / len(truth) if truth else 1.0
        return {"query": q, "top_k": k, "ann_results": near, "bf_results": exact, "recall": share, "ann_time_ns": near_ns, "bf_time_ns": exact_ns, "index_type": kind, "ann_searched": kind != "none"}

    def index(self, name: str, _: Body) -> Body:
        kind = self.db.index_info(name)
        return {"collection": name, "index_type": kind, "status": "active" if kind != "none" else "none"}

    def index_action(self, name: str, body: Body) -> Body:
        match body.get("action"):
            case "build":
                kind = body.get("index_type", "hnsw")
                self.db.build_index(name, kind)
                return {"status": "index_built", "index_type": kind}
            case "drop":
                self.db.drop_index(name)
                return {"status": "index_dropped"}
        raise ValueError("action must be build or drop")

    # Operation

    def snapshot(self, body: Body) -> Body:
        self.db.snapshot(body.get("path", self.config.snapshot_path))
        return {"status": "saved"}

    def restore(self, body: Body) -> Body:
        self.db.restore(body.get("path", self.config.snapshot_path))
        return {"status": "restored"}

    def metrics(self, _: Body) -> str:
        rows = {"uptime_seconds": round(time.time() - self.began, 3), "collections": len(self.db.list_collections()), "vectors": sum(self.db.documents(n).count() for n in self.db.list_collections()), "search_total": self.count["search"], "search_milliseconds_total": self.count["search_ns"] / 1e6, "upsert_total": self.count["upsert"], "delete_total": self.count["delete"]}
        return "".join(f"loomsearch_{k} {v}\n" for k, v in rows.items())

    def server(self) -> ThreadingHTTPServer:
        """A server that is bound and not yet running."""
        service = self

        class Handler(BaseHTTPRequestHandler):
            def _answer(self) -> None:
                raw = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
                status, out = service.handle(self.command, self.path.partition("?")[0], raw)
                data = (out if isinstance(out, str) else json.dumps(out)).encode()
                self.send_response(status)
                self.send_header("Content-Type", "text/plain; charset=utf-8" if isinstance(out, str) else "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            do_GET = do_POST = do_DELETE = _answer  # noqa: N815

            def log_message(self, *_: object) -> None:
                pass

        return ThreadingHTTPServer((self.config.host, self.config.port), Handler)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    """Serve until SIGTERM or SIGINT; `python -m loomsearch.service --port 9000`. restore_from names a snapshot to begin with."""
    config = Config.from_arguments(sys.argv[1:] if argv is None else argv)
    db = Database(spark or SparkSession.builder.appName("loomsearch").getOrCreate(), config.path)
    if config.restore_from:
        db.restore(config.restore_from)
    server = Service(db, config).server()
    for number in (signal.SIGTERM, signal.SIGINT):
        signal.signal(number, lambda *_: threading.Thread(target=server.shutdown).start())
    try:
        server.serve_forever()
    finally:
        server.server_close()


if __name__ == "__main__":
    main()
