import json
import os
import signal
import socket
import threading
import time
import urllib.request

import pytest

from loomsearch.config import Config
from loomsearch.plans.database import Database
from loomsearch.service import Service, main


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"port": 1234, "path": "x"}')
    got = Config.load(str(tmp_path / "c.json"), {"LOOMSEARCH_PORT": "99"})
    assert (got.port, got.path, got.host) == (99, "x", "127.0.0.1") and Config.load(env={}) == Config()
    (tmp_path / "c.json").write_text('{"color": 1}')
    with pytest.raises(ValueError):
        Config.load(str(tmp_path / "c.json"), {})


def test_command_line(tmp_path):
    (tmp_path / "c.json").write_text('{"port": 1234, "path": "x", "host": "h"}')
    got = Config.from_arguments(["--config", str(tmp_path / "c.json"), "--port", "7", "--snapshot-path", "s"], {"LOOMSEARCH_PORT": "99", "LOOMSEARCH_HOST": "0.0.0.0"})
    assert (got.port, got.path, got.host, got.snapshot_path) == (7, "x", "0.0.0.0", "s")


def test_main_serves_until_a_signal(spark, tmp_path):
    port = socket.socket()
    port.bind(("127.0.0.1", 0))
    number = port.getsockname()[1]
    port.close()

    def stop() -> None:
        for _ in range(100):
            try:
                with urllib.request.urlopen(f"http://127.0.0.1:{number}/health") as r:
                    seen.append(json.loads(r.read()))
                break
            except OSError:
                time.sleep(0.1)
        os.kill(os.getpid(), signal.SIGTERM)

    seen: list = []
    before = signal.getsignal(signal.SIGTERM), signal.getsignal(signal.SIGINT)
    threading.Thread(target=stop, daemon=True).start()
    main(["--port", str(number), "--path", str(tmp_path / "db")], spark)
    signal.signal(signal.SIGTERM, before[0])
    signal.signal(signal.SIGINT, before[1])
    assert seen == [{"status": "ok"}]


def test_requests(spark, tmp_path):
    s = Service(Database(spark, str(tmp_path / "db")), Config(port=0, snapshot_path=str(tmp_path / "snap")))
    ask = lambda method, path, body=None: s.handle(method, path, "" if body is None else body if isinstance(body, str) else json.dumps(body))
    schema = {"fields": [{"name": "title", "type": "text"}, {"name": "n", "type": "int"}]}
    assert ask("POST", "/collections", {"name": "c", "schema": schema}) == (201, {"status": "created", "index": False})
    assert ask("POST", "/collections", {"name": "c"})[0] == 400 and ask("POST", "/collections", "{oops")[0] == 400 and ask("POST", "/collections", {"name": "d", "metric": "x"})[0] == 400
    docs = [{"id": f"d{i}", "vector": [i / 10, 1 - i / 10], "metadata": {"title": "red fox" if i % 2 else "blue whale", "n": i}} for i in range(8)]
    assert ask("POST", "/collections/c/batch-upsert", {"documents": docs}) == (200, {"status": "upserted", "count": 8})
    assert ask("POST", "/collections/c/upsert", {"id": "x", "vector": [1]})[0] == 400
    found = ask("POST", "/collections/c/search", {"query": [1, 0], "k": 2, "filter": {"n": {"$lt": 5}}})[1]
    assert [r["id"] for r in found["results"]] == ["d5", "d4"] and found["docs_scanned"] == 8 and found["results"][0]["document"]["metadata"]["n"] == 5
    assert ask("POST", "/collections/c/search", {"query": "x"})[0] == 400 and ask("POST", "/collections/absent/search", {"query": [1, 0]})[0] == 400
    assert len(ask("POST", "/collections/c/search", {"query": [1, 0], "k": -1})[1]["results"]) == 8
    best = ask("POST", "/collections/c/hybrid-search", {"query": [1, 0], "text_query": "fox", "k": 1})[1]["results"][0]
    assert best["id"] == "d7" and best["combined_score"] == 1.0
    assert ask("POST", "/collections/c/index", {"action": "build", "index_type": "ivf"})[1]["status"] == "index_built"
    assert ask("GET", "/collections/c/index")[1]["status"] == "active" and ask("POST", "/collections/c/index", {"action": "?"})[0] == 400
    assert ask("POST", "/collections/c/recall", {"query": [1, 0], "k": 3})[1]["recall"] == 1.0
    assert ask("POST", "/collections/c/explain", {"query": [1, 0], "k": 3})[1]["results_returned"] == 3
    assert ask("POST", "/collections/c/index", {"action": "drop"})[1]["status"] == "index_dropped"
    assert ask("POST", "/collections/c/batch-delete", {"ids": ["d0"]})[1]["count"] == 1
    lines = ask("GET", "/collections/c/export")[1]
    assert len(lines.splitlines()) == 7
    ask("POST", "/collections", {"name": "copy"})
    assert ask("POST", "/collections/copy/import", "# c\n" + lines)[1]["count"] == 7 and ask("POST", "/collections/copy/import", "\n{bad")[1]["error"].startswith("line 2")
    assert ask("POST", "/snapshot", {})[1]["status"] == "saved" and ask("DELETE", "/collections/copy/delete")[0] == 200 and ask("POST", "/collections/c/truncate")[0] == 200
    assert ask("POST", "/restore", {})[0] == 200 and {x["name"]: x["count"] for x in ask("GET", "/collections")[1]} == {"c": 7, "copy": 7}
    assert ask("GET", "/health")[1] == {"status": "ok"} and ask("GET", "/ready")[1]["collections"] == 2 and "loomsearch_vectors 14" in ask("GET", "/metrics")[1]
    assert ask("GET", "/nothing")[0] == 404
    server = s.server()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}/collections/c/stats") as r:
        assert json.loads(r.read())["count"] == 7
    server.shutdown()
