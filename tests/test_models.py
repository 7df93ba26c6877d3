"""The seam to models, on stubs and on a local server."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from metrilark import models
from metrilark.operators import chat


def shout():
    """The class is made here, so that it travels to the workers, which don't have this file."""

    class Shout:
        """Answers in capitals; fails at first, and always on "bad"."""

        def __init__(self):
            self.calls = 0

        def complete(self, prompts, seed):
            self.calls += 1
            if self.calls == 1 or "bad" in prompts:
                raise OSError("busy")
            return [(p.upper() + str(seed or ""), "stop") for p in prompts]

        def chat(self, conversations, tools, seed):
            return [(f"{len(m)}:{m[-1]['content']}:{t or ''}" if m else "none", "stop") for m, t in zip(conversations, tools)]

        def log_probs(self, texts, prefixes):
            return [-1.0 * len(t) - len(p) for t, p in zip(texts, prefixes)]

    return Shout


def test_batches_retries_and_columns(spark):
    rows = spark.createDataFrame([(0, "a", "old"), (1, None, "old"), (2, "bad", "old"), (3, "a", "old")], "row_id int, prompt string, lm_output string").coalesce(1)
    model = models.BatchAdapter(shout(), batch=1, retries=1, wait=0.01, seed=7)
    before = rows.schema.simpleString()
    out = {r["row_id"]: (r["lm_output"], r["finish_reason"]) for r in model.complete(rows, "prompt").collect()}
    assert out == {0: ("A7", "stop"), 1: ("7", "stop"), 2: ("", "empty"), 3: ("A7", "stop")} and rows.schema.simpleString() == before
    again = {r["row_id"]: (r["lm_output"], r["finish_reason"]) for r in model.complete_distinct(rows, "prompt").collect()}
    assert again == out
    scored = models.BatchAdapter(shout()).log_probs(rows.selectExpr("row_id", "prompt", "'xy' AS prefix"), "prompt", "prefix")
    assert {r["row_id"]: r["log_prob"] for r in scored.collect()} == {0: -3.0, 1: -2.0, 2: -5.0, 3: -3.0}


def test_rounds_of_chat(spark):
    talks = [(0, [("user", "u1"), ("user", "u2")]), (1, [("system", "s")]), (2, [("user", f"q{k}") for k in range(70)])]
    rows = spark.createDataFrame(talks, "row_id int, messages array<struct<role:string,content:string>>")
    model = models.BatchAdapter(shout())
    out = {r["row_id"]: r["messages"] for r in chat.rounds(rows, lambda df: model.chat(df).withColumnRenamed("lm_output", "answer").drop("finish_reason"), lambda df: spark.createDataFrame(df.collect(), df.schema)).collect()}
    assert [m["content"] for m in out[0]] == ["u1", "1:u1:", "u2", "3:u2:"] and len(out[1]) == 1 and len(out[2]) == 140


def test_code_runs(spark):
    rows = spark.createDataFrame([(0, "def f(x): return x + 1", "assert f(1) == 2"), (1, "def f(x): return x", "assert f(1) == 2"), (2, "while True: pass", ""), (3, None, None)], "k int, code string, tests string")
    out = {r["k"]: (r["passed"], r["result"]) for r in models.run_code(rows, "code", "tests", 5.0).collect()}
    assert out == {0: (True, "passed"), 1: (False, "failed: AssertionError"), 2: (False, "timed out"), 3: (True, "passed")}


def test_http_client():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if self.path == "/chat/completions":
                choice = {"message": {"content": body["messages"][-1]["content"] + body["model"] + str(len(body.get("tools", [])))}, "finish_reason": "stop"}
            elif body.get("echo"):
                offsets = [0, 2, 4]
                choice = {"text": body["prompt"], "logprobs": {"token_logprobs": [None, -1.0, -2.0], "text_offset": offsets}}
            else:
                choice = {"text": body["prompt"][::-1], "finish_reason": "length"}
            data = json.dumps({"choices": [choice]}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        client = models.HttpClient(f"http://127.0.0.1:{server.server_port}/", "m", "k", temperature=0)
        assert client.complete(["abc", "de"], 1) == [("cba", "length"), ("ed", "length")]
        assert client.chat([[{"role": "user", "content": "hi"}]], ['[{"type": "function"}]'], None) == [("him1", "stop")]
        assert client.log_probs(["cdef", "bcdef"], ["ab", "a"]) == [-3.0, -3.0]
    finally:
        server.shutdown()
    with pytest.raises(OSError):
        models.HttpClient("http://127.0.0.1:9", "m", timeout=1).complete(["x"], None)


def test_batches_are_bounded(spark):
    """all rows of a partition up to 10000 went to the model's worker at once."""
    from metrilark.models import mapped

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = mapped(spark.range(5000).coalesce(1), {"n": "int"}, lambda: lambda b: {"n": [len(b)] * len(b)})
    assert sizes.count() == 5000 and sizes.agg({"n": "max"}).first()[0] <= 1000
