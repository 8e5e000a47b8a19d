"""Model calls as a map over rows: each partition has one predictor and a pool of threads, and results keep their rows."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from .files import data_uri

# What the models were trained to be asked with.
SYSTEM = "You are a helpful assistant."
SAMPLING = {"temperature": 0.0, "top_p": 0.01, "top_k": 1, "presence_penalty": 0.0, "frequency_penalty": 0.0, "repetition_penalty": 1.0, "max_tokens": 4096}
NO_REPEAT = 100
NETWORK = re.compile(r"timed? ?out|connection (?:reset|refused|aborted)|socket hang up|network", re.I)
EMPTY = "Empty response from the server"


class PredictError(Exception):
    def __init__(self, message: str, code: str = "REQUEST", status: int | None = None) -> None:
        super().__init__(message)
        self.code, self.status = code, status


class Predictor(Protocol):
    def __call__(self, image: bytes | None, prompt: str) -> str: ...


def retryable(error: Exception) -> bool:
    """Empty answers, requests without a status, too many of them, the server's own faults, and faults of the network."""
    if isinstance(error, PredictError):
        return error.status is None or error.status == 429 or error.status >= 500
    return str(error) == EMPTY or bool(NETWORK.search(str(error)))


def with_retries(call: Callable[[], str], retries: int, wait: Callable[[int], float] = lambda k: 2.0**k, sleep: Callable[[float], None] = time.sleep) -> str:
    for attempt in range(retries + 1):
        try:
            return call()
        except Exception as error:
            if attempt == retries or not retryable(error):
                raise
            sleep(wait(attempt))
    raise AssertionError


def without_end(answer: str, token: str) -> str:
    return answer.removesuffix(token) if token else answer


class Chat:
    """A predictor over an HTTP server of chat completions."""

    def __init__(self, url: str, model: str | None = None, key: str | None = None, timeout: float = 600, end_token: str = "<|im_end|>", media: str = "image/png", system: str | None = None, by_prompt: dict[str, dict[str, float]] | None = None, **sampling: float) -> None:
        """system: what single calls are told first, predict.SYSTEM as a rule; batches are told nothing. by_prompt: sampling of
        requests with that prompt."""
        self.url, self.timeout, self.end_token, self.media, self.sampling = url.rstrip("/"), timeout, end_token, media, SAMPLING | sampling
        self.system, self.by_prompt = system, by_prompt or {}
        self.headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        self.model = model or self.models()[0]

    def _open(self, path: str, body: dict | None = None) -> dict:
        request = urllib.request.Request(f"{self.url}{path}", json.dumps(body).encode() if body else None, self.headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as error:
            raise PredictError(str(error), status=error.code) from error
        except OSError as error:
            raise PredictError(str(error)) from error

    def models(self) -> list[str]:
        found = [m["id"] for m in self._open("/v1/models").get("data", [])]
        if not found:
            raise PredictError("the server has no model")
        return found

    def body(self, image: bytes | None, prompt: str) -> dict:
        content: list[dict] = [{"type": "text", "text": prompt}]
        if image is not None:
            content.insert(0, {"type": "image_url", "image_url": {"url": data_uri(image, self.media), "detail": "high"}})
        told = [{"role": "system", "content": self.system}] if self.system else []
        return {"model": self.model, "messages": [*told, {"role": "user", "content": content}], "skip_special_tokens": False, "vllm_xargs": {"no_repeat_ngram_size": NO_REPEAT}, **self.sampling, **self.by_prompt.get(prompt, {})}

    def __call__(self, image: bytes | None, prompt: str) -> str:
        choices = self._open("/v1/chat/completions", self.body(image, prompt)).get("choices") or []
        if not choices:
            raise PredictError(EMPTY, status=None)
        return without_end(choices[0]["message"].get("content") or "", self.end_token)


def predicted(rows: DataFrame, predictor: Callable[[], Predictor], key: list[str], threads: int = 10, retries: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """The key, content and error of each row of key, image (null: none), prompt. A call that fails for good gives the
    empty text and its error, and the others go on."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = predictor()

        def ask(request: tuple[bytes | None, str]) -> tuple[str, str | None]:
            try:
                return with_retries(lambda: own(*request), retries, sleep=sleep), None
            except Exception as error:
                return "", f"{getattr(error, 'code', type(error).__name__)}: {error}"

        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                found = list(pool.map(ask, zip(batch.column("image").to_pylist(), batch.column("prompt").to_pylist(), strict=True)))
                yield pa.record_batch([*[batch.column(k) for k in key], pa.array([x for x, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], names=[*key, "content", "error"])

    return rows.select(*key, "image", "prompt").mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in key) + ", content string, error string")
