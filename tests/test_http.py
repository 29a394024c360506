"""The encoder and the transport against a server of this machine."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tidemark.sources.encoders import EncoderError, HttpEncoder
from tidemark.sources.fetch import FetchError, Landing, Pace, Settings, http_transport
from tidemark.sources.tables import VectorCache, embed_missing


class Handler(BaseHTTPRequestHandler):
    busy = 0
    seen: list = []

    def log_message(self, *args):
        pass

    def answer(self, status, body, **headers):
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.send_header("content-length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        Handler.seen.append((self.path, self.headers["user-agent"]))
        if Handler.busy:
            Handler.busy -= 1
            return self.answer(429, b"", retry_after="0")
        self.answer(404 if "none" in self.path else 200, b"x" * 100_000, etag="e")

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["content-length"])))
        if Handler.busy:
            Handler.busy -= 1
            return self.answer(503, b"")
        if asked["model"] == "bad":
            return self.answer(400, b"no such model")
        vector = [3.0, 4.0, float(len(asked["prompt"]))]
        self.answer(200, json.dumps({} if asked["prompt"] == "odd" else {"embedding": vector}).encode())


@pytest.fixture
def server():
    Handler.busy, Handler.seen = 0, []
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()
    s.server_close()


def test_encoder(server):
    encode = HttpEncoder(server, "m", 2, longest_wait=0.01)
    assert encode(["a", "bb"]) == [[0.6, 0.8]] * 2
    Handler.busy = 2
    assert encode(["a"]) == [[0.6, 0.8]]
    Handler.busy = 5
    with pytest.raises(EncoderError, match="status 503"):
        encode(["a"])
    for broken, why in ((HttpEncoder(server, "bad", 2), "no such model"), (HttpEncoder(server, "m", 4), "gives 3 numbers"), (HttpEncoder("http://127.0.0.1:9", "m", 2, tries=2, longest_wait=0.01), "no answer")):
        with pytest.raises(EncoderError, match=why):
            broken(["a"])
    with pytest.raises(EncoderError, match="no vector"):
        encode(["odd"])


def test_embedding_over_http(spark, server, tmp_path):
    rows = spark.createDataFrame([(f"d{n}", f"text {n}") for n in range(20)] + [("d1", "text 1")], "digest string, text string")
    cache = VectorCache(spark, str(tmp_path), "m", 2)
    assert embed_missing(rows, cache, HttpEncoder(server, "m", 2), rounds=3) == 20
    assert {tuple(round(x, 6) for x in r["vector"]) for r in cache.load(rows).collect()} == {(0.6, 0.8)}


def test_transport(server, tmp_path):
    landing = Landing(tmp_path, http_transport(Settings("me@x.example")), Pace(1000), sleep=lambda s: None)
    Handler.busy = 2
    path, there = landing.get(f"{server}/files/company_tickers.json")
    assert path.read_bytes() == b"x" * 100_000 and not there and len(Handler.seen) == 3 and Handler.seen[0][1] == "me@x.example"
    assert landing.get(f"{server}/files/company_tickers.json")[1] and len(Handler.seen) == 3
    with pytest.raises(FetchError) as e:
        landing.get(f"{server}/none")
    assert e.value.status == 404
    done, failed = Landing(tmp_path, http_transport(Settings("me@x.example"), timeout=1), Pace(1000), sleep=lambda s: None).get_all(["http://127.0.0.1:9/a"])
    assert not done and list(failed) == ["http://127.0.0.1:9/a"]
