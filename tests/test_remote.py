import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from docpool import __version__, app
from docpool.config import Config
from docpool.operators.rerank import Candidate
from docpool.sources import content as ct
from docpool.sources import remote as rm

asked = []


class Answers(BaseHTTPRequestHandler):
    def _send(self, status, body, kind="application/json", **headers):
        raw = body if isinstance(body, bytes) else body.encode()
        self.send_response(status)
        for name, value in {"Content-Type": kind, "Content-Length": str(len(raw)), **headers}.items():
            self.send_header(name, value)
        self.end_headers()
        self.wfile.write(raw)

    def do_POST(self):
        given = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        asked.append((self.path, self.headers["Authorization"], given))
        if self.path == "/embed":
            self._send(200, json.dumps({"data": [{"index": i, "embedding": [len(t), 1.0]} for i, t in reversed(list(enumerate(given["input"])))]}))
        elif self.path == "/chat":
            self._send(200, json.dumps({"choices": [{"message": {"content": json.dumps({"ranking": [{"id": "1", "score": 0.9}, {"id": 7, "score": 1}]})}}]}))
        elif self.path == "/odd":
            self._send(200, json.dumps({"choices": [{"message": {"content": "no json"}}]}))
        else:
            self._send(429, json.dumps({"error": {"message": "too many"}}))

    def do_GET(self):
        name = self.path.strip("/").split("?")[0]
        if name.startswith("hop"):
            n = int(name[3:])
            self._send(302, "", **{"Location": f"/hop{n - 1}" if n else "/text"})
        elif name == "text":
            self._send(200, "caf\u00e9".encode(), "text/plain; charset=utf-8")
        elif name == "long":
            self._send(200, b"x" * 5000, "text/plain")
        elif name == "image":
            self._send(200, b"x", "image/png")
        else:
            self._send(404, "")

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def server():
    http = HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}"
    http.shutdown()


def test_vectors_come_in_the_order_of_the_texts(server):
    embedder = rm.RemoteEmbedder("secret", "m", 2, 5, f"{server}/embed")
    assert embedder.embed(["a", "bbb"]) == [[1, 1.0], [3, 1.0]] and embedder.embed([]) == []
    assert asked[-1] == ("/embed", "Bearer secret", {"model": "m", "input": ["a", "bbb"], "encoding_format": "float"})
    with pytest.raises(rm.ProviderError, match="2 elements, not 3"):
        rm.RemoteEmbedder("k", "m", 3, 5, f"{server}/embed").embed(["a"])
    with pytest.raises(rm.ProviderError, match="429: too many"):
        rm.RemoteEmbedder("k", "m", 2, 5, f"{server}/busy").embed(["a"])
    with pytest.raises(rm.ProviderError):
        rm.RemoteEmbedder("k", "m", 2, 5, "http://127.0.0.1:1/x").embed(["a"])


def test_judge(server):
    judge = rm.RemoteReranker("k", "m", 5, f"{server}/chat")
    assert judge.scores("q", [Candidate(10, "p"), Candidate(11, "r")]) == [-1.0, 0.9] and judge.scores("q", []) == []
    given = asked[-1][2]
    assert given["temperature"] == 0 and given["response_format"] == {"type": "json_object"}
    assert json.loads(given["messages"][1]["content"]) == {"query": "q", "candidates": [{"id": "0", "preview": "p"}, {"id": "1", "preview": "r"}]}
    for path in ("odd", "embed-none"):
        with pytest.raises(rm.ProviderError):
            rm.RemoteReranker("k", "m", 5, f"{server}/{path}").scores("q", [Candidate(1, "p")])


def test_key_is_looked_up_in_order():
    assert rm.api_key(environment={"DOCPOOL_API_KEY": "a", "OPENAI_API_KEY": "b"}) == "a"
    assert rm.api_key(environment={"DOCPOOL_API_KEY": "", "OPENAI_API_KEY": "b"}) == "b"
    with pytest.raises(rm.ProviderError):
        rm.api_key(environment={})


def test_fetching(server):
    fetcher = ct.HttpFetcher(5, allow_private=True, max_bytes=4000)
    assert fetcher.fetch(f"{server}/text?a=1#x") == fetcher.fetch(f"{server}/hop4") == "caf\u00e9"
    for path, message in (("none", "404"), ("image", "not a text"), ("hop9", "redirects"), ("long", "4000")):
        with pytest.raises(ct.ContentError, match=message):
            fetcher.fetch(f"{server}/{path}")
    with pytest.raises(ct.ContentError, match="private"):
        ct.HttpFetcher().fetch(f"{server}/text")


def test_a_host_is_resolved_once(server, monkeypatch):
    port, calls = int(server.rsplit(":", 1)[1]), []

    def resolving(host, *_, **__):
        calls.append(host)
        return [(2, 1, 6, "", ("127.0.0.1" if len(calls) == 1 else "10.0.0.1", port))]

    monkeypatch.setattr(ct.socket, "getaddrinfo", resolving)
    monkeypatch.setattr(ct, "is_private", lambda a: a != "127.0.0.1")
    monkeypatch.setattr(ct.socket, "create_connection", lambda address, timeout, f=ct.socket.socket: _connect(address, f))
    assert ct.HttpFetcher(5).fetch(f"http://rebound.example:{port}/text") == "caf\u00e9"
    assert calls == ["rebound.example"]


def _connect(address, make):
    sock = make()
    sock.connect(address)
    return sock


VALUES = {
    "server": {"port": 8080, "db_path": ""}, "embedding": {"model": "m", "dim": 4, "timeout_seconds": 9}, "rerank": {"model": "r", "factor": 3, "timeout_seconds": 8}, "chunker": {"max_chunk_size": 700},
    "bm25": {"k1": 1.2, "b": 0.5}, "fetcher": {"timeout_seconds": 7, "allow_private": True}, "trash": {"retention_days": 2, "interval_seconds": 60}, "log": {"path": "stderr", "level": "warn"},
}


def test_service_from_settings(spark, tmp_path):
    config = Config.of({**VALUES, "server": {"port": 8080, "db_path": f"file://{tmp_path}/s"}, "log": {"path": f"{tmp_path}/logs/x.log", "level": "info"}})
    service, sweeper = app.open_service(spark, config, {"OPENAI_API_KEY": "k"})
    assert (service.k1, service.b, service.max_chunk_size, service.fetcher.timeout, service.fetcher.allow_private) == (1.2, 0.5, 700, 7, True)
    assert (service.embedder.key, service.embedder.dim, service.embedder.timeout_seconds, service.reranker.model, service.reranker.timeout_seconds) == ("k", 4, 9, "r", 8)
    assert (sweeper.interval, sweeper.retention.days, service.retention.days) == (60, 2, 2)
    handler = app.set_up_log(config)
    app.logging.getLogger("docpool").info("hello")
    handler.close()
    app.logging.getLogger("docpool").removeHandler(handler)
    assert "msg=hello" in (tmp_path / "logs" / "x.log").read_text()


def test_command_line(capsys, tmp_path):
    assert app.main(["--version"]) == 0 and capsys.readouterr().out.strip() == __version__
    assert app.main(["--show-config", str(tmp_path / "none.yaml")]) == 1
    assert app.main([]) == 2
    config = Config.of({**VALUES, "server": {"port": 8080, "db_path": "/x"}})
    assert "server.port: 8080" in app.shown(config, "p")
