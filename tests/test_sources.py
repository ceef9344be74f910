import sys
import threading

import pytest
from pyspark import cloudpickle

from docpool.config import Config, expand_home
from docpool.errors import KeyNotFound, KeyTrashed
from docpool.sources import content as ct
from docpool.sources import embedding as em
from docpool.sources.store import Cancelled, KeyLocks

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VALUES = {
    "server": {"port": 8080, "db_path": "~/x"}, "embedding": {"model": "m", "dim": 64, "timeout_seconds": 60}, "rerank": {"model": "m", "factor": 3, "timeout_seconds": 30},
    "chunker": {"max_chunk_size": 1500}, "bm25": {"k1": 1.5, "b": 0.75}, "fetcher": {"timeout_seconds": 30, "allow_private": False}, "trash": {"retention_days": 3, "interval_seconds": 3600},
}


@pytest.mark.parametrize(("address", "private"), [("127.0.0.1", True), ("10.1.2.3", True), ("172.16.0.1", True), ("172.32.0.1", False), ("192.168.1.1", True), ("169.254.169.254", True), ("::1", True), ("fc00::1", True), ("fd12::1", True), ("fe80::1", True), ("ff02::1", True), ("224.0.0.1", True), ("8.8.8.8", False), ("2001:4860::1", False), ("::ffff:127.0.0.1", True), ("no address", False)])
def test_private_addresses(address, private):
    assert ct.is_private(address) is private


def test_fetcher_refuses():
    for url in ("ftp://example.com/x", "nonsense", "http://127.0.0.1:9/"):
        with pytest.raises(ct.ContentError):
            ct.HttpFetcher().fetch(url)


def test_local_files(tmp_path):
    file = tmp_path / "a.md"
    file.write_text("content")
    assert ct.read_local(str(file)) == "content"
    (tmp_path / "big").write_bytes(b"x" * (ct.MAX_FILE + 1))
    for path in ("", "a.md", f"{tmp_path}/../x", str(tmp_path), f"{tmp_path}/none", f"{tmp_path}/big"):
        with pytest.raises(ct.ContentError):
            ct.read_local(path)


class Pages:
    def fetch(self, url):
        if url.endswith("/bad"):
            raise RuntimeError("not there")
        return f"# H\n{url}"


def test_resolve(spark):
    rows = [(0, "a", "text", "", ""), (1, "b", "", "http://x/ok", ""), (2, "c", "", "http://x/bad", ""), (3, "d", "", "", ""), (4, "e", "t", "http://x/ok", ""), (5, "", "t", "", ""), (6, "g", None, None, "relative")]
    found = {r.pos: r for r in ct.resolve(spark.createDataFrame(rows, "pos long, path string, content string, url string, local_path string"), Pages()).collect()}
    assert found[0].content == "text" and found[1].content == "# H\nhttp://x/ok"
    assert found[2].error == "not there"
    assert all(found[i].error and found[i].content is None for i in (3, 4, 5, 6))


def test_embed_in_batches():
    calls, waits = [], []

    class Flaky:
        def embed(self, texts):
            calls.append(len(texts))
            if texts[0] == "t100":
                raise RuntimeError("down")
            return [[1.0]] * len(texts)

    got = em.embed_all(Flaky(), [f"t{i}" for i in range(250)], wait=waits.append)
    assert calls == [100, 100, 100, 100, 50]
    assert waits == [1.0, 2.0]
    assert got.skipped == list(range(100, 200)) and got.error == "down"
    assert got.vectors[99] == [1.0] and got.vectors[100] is None
    assert em.embed_all(Flaky(), []).vectors == []
    assert em.by_index([{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}], 2) == [[1], [2]]
    with pytest.raises(ValueError):
        em.by_index([{"index": 1, "embedding": [2]}], 2)


def test_config():
    config = Config.of(VALUES)
    assert config.server.db_path == expand_home("~/x") != "~/x"
    assert config.log.level == "info"
    assert expand_home("~user/x") == "~user/x"
    bad = [("server", "port", 0), ("server", "port", 65536), ("server", "db_path", ""), ("embedding", "dim", 0), ("embedding", "model", ""), ("rerank", "factor", 0), ("chunker", "max_chunk_size", 0), ("bm25", "k1", 0), ("bm25", "b", 1.5), ("fetcher", "timeout_seconds", 0), ("trash", "retention_days", 0), ("trash", "interval_seconds", -1), ("log", "level", "loud"), ("bm25", "zz", 1), ("server", "port", "80")]
    for section, name, value in bad:
        with pytest.raises(ValueError):
            Config.of({**VALUES, section: {**VALUES.get(section, {}), name: value}})
    with pytest.raises(ValueError):
        Config.of({**VALUES, "extra": {}})
    with pytest.raises(ValueError):
        Config.of({k: v for k, v in VALUES.items() if k != "trash"})


def test_errors():
    assert (KeyNotFound.code, KeyNotFound.numeric, KeyTrashed.code, KeyTrashed.numeric) == ("KEY_NOT_FOUND", -31001, "KEY_TRASHED", -31002)
    assert str(KeyTrashed("K")).startswith("KEY_TRASHED: ")
    assert KeyNotFound("K").data == {"code": "KEY_NOT_FOUND", "key": "K"}


def test_locks():
    locks, order, inside = KeyLocks(), [], threading.Event()

    def second():
        with locks.hold("K"):
            order.append("second")

    with locks.hold("K"), locks.hold("other"):
        thread = threading.Thread(target=second)
        thread.start()
        inside.wait(0.1)
        order.append("first")
        with pytest.raises(Cancelled), locks.hold("K", lambda: True):
            pass
    thread.join()
    assert order == ["first", "second"]
    assert len(locks) == 0
