import http.server
import json
import os
import threading

import pytest
from conftest import rows
from lemmary.sources import files


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    assert rows(files.optional_table(spark, path, "a int, b string")) == []
    with pytest.raises(FileNotFoundError):
        files.required_table(spark, path)
    spark.createDataFrame([(1, 2.0)], "a int, z double").write.parquet(path)
    assert rows(files.optional_table(spark, path, "a long, b string")) == [(1, None)]
    assert files.required_table(spark, path).count() == 1


def test_json(spark, tmp_path):
    p = str(tmp_path / "x/y.json")
    assert files.read_json(p, {"d": 1}) == {"d": 1}
    files.write_json({"b": float("nan"), "a": [1.5, {"c": float("inf")}]}, p)
    assert open(p).read().index('"a"') < open(p).read().index('"b"') and files.read_json(p) == {"a": [1.5, {"c": None}], "b": None}
    files.write_json_lines(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "l"))
    assert rows(spark.read.json(str(tmp_path / "l"))) == [(1, "x")]
    assert files.nested({"a": {"b": 1}}, "a.b") == 1 and files.nested({"a": 1}, "a.b", None) is None


def test_env(tmp_path, monkeypatch):
    f = tmp_path / ".env"
    f.write_text("A_KEY_X='one'\n# B=2\n\nA_SET_X=new\n")
    monkeypatch.setenv("A_SET_X", "old")
    monkeypatch.delenv("A_KEY_X", raising=False)
    assert files.load_env(str(f)) == {"A_KEY_X": "one", "A_SET_X": "new"} and os.environ["A_SET_X"] == "old" and os.environ.pop("A_KEY_X") == "one"
    assert files.load_env(str(tmp_path / "none")) == {}


def test_http_client_retries():
    seen, waits = [], []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(500 if len(seen) < 3 else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"text": "ok"}).encode())

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    call = files.http_client(url, {}, lambda t: {"p": t}, lambda a: a["text"], wait=waits.append)
    assert call("q") == "ok" and seen == [{"p": "q"}] * 3 and waits == [1, 2]
    seen[:] = []
    with pytest.raises(OSError):
        files.http_client(url, {}, lambda t: {"p": t}, lambda a: a["text"], retries=1, wait=waits.append)("q")
    server.shutdown()
