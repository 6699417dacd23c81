"""Model calls: retries, failures as rows, counters, a shared cache, keys that stay out of plans."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from sawmill.operators import model
from sawmill.operators.extract import extract


class Server(ThreadingHTTPServer):
    """Answers with the number of letters; the first two calls of prompts with "flaky" fail, all of those with "broken"."""

    def __init__(self):
        self.calls, self.open, self.most, self.keys, self.lock = Counter(), 0, 0, set(), threading.Lock()
        super().__init__(("127.0.0.1", 0), Handler)


class Handler(BaseHTTPRequestHandler):
    def do_POST(self):
        s, body = self.server, json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        prompt = body["messages"][0]["content"]
        with s.lock:
            s.calls[prompt] += 1
            s.keys.add(self.headers["Authorization"])
            s.open += 1
            s.most = max(s.most, s.open)
        bad = "broken" in prompt or ("flaky" in prompt and s.calls[prompt] <= 2)
        threading.Event().wait(0.02)
        with s.lock:
            s.open -= 1
        self.send_response(503 if bad else 200)
        self.end_headers()
        if not bad:
            self.wfile.write(json.dumps({"choices": [{"message": {"content": f"`{len(prompt)}`"}}]}).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    s = Server()
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def test_calls(spark, server, monkeypatch):
    monkeypatch.setitem(spark.sparkContext.environment, "MODEL_KEY_FOR_TESTS", "a-key-that-nobody-may-see")  # as spark.executorEnv does on a cluster
    provider = model.chat_provider(f"http://127.0.0.1:{server.server_address[1]}", "m", "MODEL_KEY_FOR_TESTS")
    from pyspark import cloudpickle

    assert b"a-key-that" not in cloudpickle.dumps(provider)
    prompts = [f"plain {k}" for k in range(40)] + ["flaky 1", "flaky 2", "broken"]
    df = spark.createDataFrame([(p,) for p in prompts + prompts + [None]], "prompt string")
    found, counters = model.asked(df, provider, first_wait=0.001, longest_wait=0.01, concurrency=4, per_task=20)
    rows = {r.prompt: r for r in found.collect()}
    found.collect()
    assert set(rows) == set(prompts) and all(rows[p].answer == f"`{len(p)}`" for p in prompts if p != "broken")
    assert rows["broken"].answer is None and "503" in rows["broken"].error and rows["broken"].attempts == 6 and rows["flaky 1"].attempts == 3
    # each prompt was called as often as it says, and reading the answers again called nothing
    assert server.calls == {p: rows[p].attempts for p in prompts} and server.keys == {"Bearer a-key-that-nobody-may-see"}
    assert server.most <= 4 * 4
    assert (counters["prompts"], counters["answered"], counters["failed"], counters["attempts"]) == (43, 42, 1, 40 + 6 + 6) and counters["seconds"] > 0
    assert "a-key-that" not in found._jdf.queryExecution().toString()


def test_settings(spark):
    assert model.configured_provider(spark) is None
    spark.conf.set(model.URL, "http://127.0.0.1:1")
    try:
        assert callable(model.configured_provider(spark))
    finally:
        spark.conf.unset(model.URL)
    found, counters = model.asked(spark.createDataFrame([], "prompt string"), lambda p: p)
    assert found.count() == 0 and counters["prompts"] == 0


def test_failed_texts_are_their_own_templates(spark):
    def provider(prompt):
        if "seven" in prompt:
            raise RuntimeError("busy")
        return "`job <<name>> ended`"

    texts, report = spark.createDataFrame([("job a ended",), ("job seven ended",)], "content string"), {}
    got, cache = extract(texts, provider, report=report, attempts=2, first_wait=0.0)
    assert {(r.content, r.template) for r in got.collect()} == {("job a ended", "job <*> ended"), ("job seven ended", "job seven ended")}
    assert cache.count() == 1 and report["failed"] == 1 and report["attempts"] == 3
    (failure,) = report["failures"].collect()
    assert failure.error == "RuntimeError: busy"


def test_runs_share_a_cache(spark, tmp_path):
    """Two runs that append at the same time lose nothing; of two answers one is taken, the same for all readers."""
    path = f"file://{tmp_path}/cache"
    assert model.read_cache(spark, path).count() == 0
    parts = [spark.createDataFrame([(f"p{j}", f"answer {k}") for j in range(k, k + 3)] + [("none", None)], "prompt string, answer string") for k in range(4)]
    threads = [threading.Thread(target=model.append_cache, args=(p, path)) for p in parts]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    first = sorted(map(tuple, model.read_cache(spark, path).collect()))
    assert [p for p, _ in first] == [f"p{j}" for j in range(6)] and first == sorted(map(tuple, model.read_cache(spark, path).collect()))
    assert all(a in {f"answer {k}" for k in range(4)} for _, a in first)
