"""The seam to models: adapters that add answers or log-probabilities to a DataFrame, a client of HTTP servers, and deterministic stubs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .functions.tokenizers import NotAvailable
from .session import bounded


class Adapter(Protocol):
    def complete(self, rows: DataFrame, prompt: str) -> DataFrame:
        """``rows`` with ``lm_output`` and ``finish_reason`` for the text column ``prompt``."""

    def chat(self, rows: DataFrame, messages: str = "messages", tools: str | None = None) -> DataFrame:
        """``rows`` with ``lm_output`` and ``finish_reason`` for conversations, array<struct<role, content, ...>>."""

    def log_probs(self, rows: DataFrame, text: str, prefix: str) -> DataFrame:
        """``rows`` with ``log_prob`` of ``text`` after ``prefix``."""


class Client(Protocol):
    """What a worker opens; each method answers a batch, in its order."""

    def complete(self, prompts: list[str], seed: int | None) -> list[tuple[str, str]]: ...

    def chat(self, conversations: list[list[dict]], tools: list[str | None], seed: int | None) -> list[tuple[str, str]]: ...

    def log_probs(self, texts: list[str], prefixes: list[str]) -> list[float]: ...


def mapped(rows: DataFrame, added: dict[str, str], make: Callable[[], Callable[[pd.DataFrame], dict[str, Sequence]]]) -> DataFrame:
    """``rows`` with the columns ``added`` (name -> type) that the function opened by ``make()`` in each worker gives for a batch; columns of these names are replaced. Batches are bounded."""
    bounded(rows.sparkSession)
    kept = rows.drop(*added)
    schema = StructType([*kept.schema.fields, *StructType.fromDDL(", ".join(f"`{k}` {t}" for k, t in added.items())).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        answer = make()
        for b in batches:
            yield b.assign(**answer(b))

    return kept.mapInPandas(run, schema)


class BatchAdapter:
    """An adapter around ``make()``, which opens a ``Client`` in each worker.

    At most ``batch`` rows go into a request, the shorter texts of an Arrow batch first, so that a request has texts of about one length. A
    request that raises is repeated ``retries`` times after ``wait`` seconds, doubled each time up to ``longest``; then its rows get an empty
    output and the reason "empty". Log-probabilities are never made up: there the last error is raised.
    """

    def __init__(self, make: Callable[[], Client], batch: int = 32, retries: int = 5, wait: float = 1.0, longest: float = 80.0, seed: int | None = None):
        self.make, self.batch, self.retries, self.wait, self.longest, self.seed = make, batch, retries, wait, longest, seed

    def _answers(self, call: Callable[..., list], sizes: list[int], *columns: list, empty: object = None) -> list:
        import time

        out: list = [empty] * len(sizes)
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        for k in range(0, len(order), self.batch):
            at = order[k : k + self.batch]
            for attempt in range(self.retries + 1):
                try:
                    got = call(*[[c[i] for i in at] for c in columns])
                    if len(got) != len(at):
                        raise ValueError(f"{len(got)} answers to {len(at)} requests")
                    for i, g in zip(at, got):
                        out[i] = g
                    break
                except Exception:
                    if attempt == self.retries:
                        if empty is None:
                            raise
                    else:
                        time.sleep(min(self.wait * 2**attempt, self.longest))
        return out

    def complete(self, rows: DataFrame, prompt: str) -> DataFrame:
        def make():
            client = self.make()

            def answer(b: pd.DataFrame) -> dict:
                prompts = [p or "" for p in b[prompt]]
                got = self._answers(lambda p: client.complete(p, self.seed), [len(p) for p in prompts], prompts, empty=("", "empty"))
                return {"lm_output": [t for t, _ in got], "finish_reason": [r for _, r in got]}

            return answer

        return mapped(rows, {"lm_output": "string", "finish_reason": "string"}, make)

    def complete_distinct(self, rows: DataFrame, prompt: str) -> DataFrame:
        """The same with one request for each distinct prompt; null is a prompt too."""
        asked = self.complete(rows.select(F.col(prompt).alias("_asked")).distinct(), "_asked")
        return rows.drop("lm_output", "finish_reason").join(asked, rows[prompt].eqNullSafe(asked["_asked"])).drop("_asked")

    def chat(self, rows: DataFrame, messages: str = "messages", tools: str | None = None) -> DataFrame:
        tagged = rows.withColumns({"_messages": F.to_json(messages), "_tools": F.col(tools).cast("string") if tools else F.lit(None).cast("string")})

        def make():
            client = self.make()

            def answer(b: pd.DataFrame) -> dict:
                import json

                talks = [json.loads(m) if m else [] for m in b["_messages"]]
                got = self._answers(lambda m, t: client.chat(m, t, self.seed), [len(m or "") for m in b["_messages"]], talks, [t if isinstance(t, str) else None for t in b["_tools"]], empty=("", "empty"))
                return {"lm_output": [t for t, _ in got], "finish_reason": [r for _, r in got]}

            return answer

        return mapped(tagged, {"lm_output": "string", "finish_reason": "string"}, make).drop("_messages", "_tools")

    def log_probs(self, rows: DataFrame, text: str, prefix: str) -> DataFrame:
        def make():
            client = self.make()

            def answer(b: pd.DataFrame) -> dict:
                texts, prefixes = [t or "" for t in b[text]], [p or "" for p in b[prefix]]
                return {"log_prob": self._answers(client.log_probs, [len(t) + len(p) for t, p in zip(texts, prefixes)], texts, prefixes)}

            return answer

        return mapped(rows, {"log_prob": "double"}, make)


class HttpClient:
    """A client of a server with the widespread ``/chat/completions`` and ``/completions`` routes under ``base``. ``options`` go into every request."""

    def __init__(self, base: str, model: str, key: str | None = None, timeout: float = 120.0, threads: int = 8, **options: object):
        self.base, self.model, self.key, self.timeout, self.threads, self.options = base.rstrip("/"), model, key, timeout, threads, options

    def _post(self, route: str, body: dict) -> dict:
        import json
        from urllib.request import Request, urlopen

        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        with urlopen(Request(self.base + route, json.dumps(body).encode(), headers), timeout=self.timeout) as answer:
            return json.load(answer)

    def _all(self, route: str, bodies: list[dict]) -> list[dict]:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(self.threads) as pool:
            return list(pool.map(lambda b: self._post(route, {"model": self.model} | self.options | {k: v for k, v in b.items() if v is not None})["choices"][0], bodies))

    def complete(self, prompts: list[str], seed: int | None) -> list[tuple[str, str]]:
        return [(c["text"], c.get("finish_reason") or "") for c in self._all("/completions", [{"prompt": p, "seed": seed} for p in prompts])]

    def chat(self, conversations: list[list[dict]], tools: list[str | None], seed: int | None) -> list[tuple[str, str]]:
        import json

        bodies = [{"messages": m, "tools": json.loads(t) if t else None, "seed": seed} for m, t in zip(conversations, tools)]
        return [(c["message"].get("content") or "", c.get("finish_reason") or "") for c in self._all("/chat/completions", bodies)]

    def log_probs(self, texts: list[str], prefixes: list[str]) -> list[float]:
        """The server echoes the prompt with its tokens' log-probabilities; those that begin within ``prefix`` don't count."""
        out = []
        for text, prefix, c in zip(texts, prefixes, self._all("/completions", [{"prompt": p + t, "max_tokens": 0, "echo": True, "logprobs": 0} for t, p in zip(texts, prefixes)])):
            found = c["logprobs"]
            out.append(sum(p for p, at in zip(found["token_logprobs"], found["text_offset"]) if p is not None and len(prefix) <= at < len(prefix) + len(text)))
        return out


class Echo:
    """Answers with the prompt; every log-probability is -1."""

    def complete(self, rows: DataFrame, prompt: str) -> DataFrame:
        return rows.withColumns({"lm_output": F.coalesce(F.col(prompt), F.lit("")), "finish_reason": F.lit("length")})

    def log_probs(self, rows: DataFrame, text: str, prefix: str) -> DataFrame:
        return rows.withColumn("log_prob", F.lit(-1.0))


    def chat(self, rows: DataFrame, messages: str = "messages", tools: str | None = None) -> DataFrame:
        return rows.withColumns({"lm_output": F.coalesce(F.try_element_at(messages, F.lit(-1))["content"], F.lit("")), "finish_reason": F.lit("length")})


class Constant:
    """Always answers ``text``."""

    def __init__(self, text: str):
        self.text = text

    def complete(self, rows: DataFrame, prompt: str) -> DataFrame:
        return rows.withColumns({"lm_output": F.lit(self.text), "finish_reason": F.lit("stop")})

    def chat(self, rows: DataFrame, messages: str = "messages", tools: str | None = None) -> DataFrame:
        return self.complete(rows, messages)


def stop_sequences(*stops: str | Iterable[str] | None, bos: str | None = None, eos: str | None = None) -> list[str]:
    """All stop sequences, each once."""
    out: set[str] = set()
    for s in (*stops, bos, eos):
        out |= {s} if isinstance(s, str) else set(s or ())
    return sorted(out - {""})


def remote(*_: object, **__: object) -> Adapter:
    raise NotAvailable("model servers and weights need a network")


def run_code(rows: DataFrame, code: str, tests: str, timeout: float = 3.0) -> DataFrame:
    """``rows`` with ``passed, result`` of running the columns ``code`` and ``tests`` in a fresh interpreter. It runs what the model wrote: only for machines that may."""

    def make():
        import subprocess
        import sys

        def one(program: str) -> str:
            try:
                done = subprocess.run([sys.executable, "-I", "-c", program], capture_output=True, text=True, timeout=timeout)
            except subprocess.TimeoutExpired:
                return "timed out"
            return "passed" if done.returncode == 0 else "failed: " + (done.stderr.strip().splitlines() or ["?"])[-1]

        def answer(b: pd.DataFrame) -> dict:
            results = [one(f"{c}\n{t}\n") for c, t in zip(b[code].fillna(""), b[tests].fillna(""))]
            return {"passed": [r == "passed" for r in results], "result": results}

        return answer

    return mapped(rows, {"passed": "boolean", "result": "string"}, make)
