"""External services as table functions: a client in each partition, a row's failure is the row's.

A service is an object with identity (a dict) and call(request: dict) -> str;
factory() makes one in a Python worker. Results are kept by a key of the service's
identity and the request, so that a retried task finds what an earlier one stored;
speculative execution should be off where calls cost money.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

RESULT = "key string, payload string, status string, error string, seconds double"


class StandIn:
    """A deterministic service: the request's text in capitals, or an error for a text that asks for it."""

    identity = {"name": "stand-in", "version": 1}

    def call(self, request: dict) -> str:
        if "[[fail]]" in request["text"]:
            raise RuntimeError("asked to fail")
        return request["text"].upper()


class SilentVoice:
    """A deterministic voice: a hundred zero frames for each sign."""

    identity = {"name": "silence", "sample_rate": 24_000}
    max_chars, max_bytes = 2000, 4500

    def call(self, request: dict) -> str:
        return str(100 * len(request["text"]))


def request_key(identity: dict, request: dict) -> str:
    return hashlib.sha256(json.dumps([identity, request], sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def with_halving(service: object, text: str, depth: int = 4, attempts: int = 2) -> str:
    """The service's answer to text; after failed attempts the answers to its halves, cut at a space, down to some depth."""
    error: Exception | None = None
    for _ in range(attempts):
        try:
            return service.call({"text": text})
        except RuntimeError as e:
            error = e
    words = text.split(" ")
    if depth == 0 or len(words) < 2:
        raise error
    middle = len(words) // 2
    return " ".join(with_halving(service, " ".join(half), depth - 1, attempts) for half in (words[:middle], words[middle:]))


def called(items: DataFrame, factory: Callable[[], object], attempts: int = 2, per_second: float | None = None) -> DataFrame:
    """key, payload, status, error, seconds for items (key, text): each row is called for, and its failure noted.

    per_second bounds the calls of one partition; the number of partitions bounds
    how many run at once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service, next_call = factory(), 0.0
        for batch in batches:
            rows = []
            for key, text in zip(batch["key"], batch["text"]):
                payload, error, begun = None, None, time.monotonic()
                for _ in range(attempts):
                    if per_second:
                        time.sleep(max(0.0, next_call - time.monotonic()))
                        next_call = time.monotonic() + 1 / per_second
                    try:
                        payload, error = service.call({"text": text}), None
                        break
                    except RuntimeError as e:
                        error = f"{type(e).__name__}: {e}"
                        if getattr(e, "code", None):  # a client that knows has tried enough
                            break
                rows.append((key, payload, "failed" if error else "success", error, time.monotonic() - begun))
            yield pd.DataFrame(rows, columns=["key", "payload", "status", "error", "seconds"])

    return items.select("key", "text").mapInPandas(run, RESULT)
