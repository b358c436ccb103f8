"""Rate-limited lookups of keys at a remote service, as an operator: each partition has its share of the rate.

The transport is a parameter: ``fetch(key) -> (status, body, retry_after)``.  Nothing here opens a connection by itself.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Fetch = Callable[[str], tuple[int, str | None, float | None]]


def one(key: str, fetch: Fetch, retries: int = 4, sleep: Callable[[float], None] = time.sleep) -> tuple[int, str | None, int]:
    """``(status, body, attempts)``: 429 and 5xx are asked again after a growing wait, 404 is an answer."""
    for attempt in range(retries + 1):
        status, body, after = fetch(key)
        if not (status == 429 or status >= 500) or attempt == retries:
            return status, body, attempt + 1
        sleep(max(1.0, after or 1.0) * (attempt + 1))
    raise AssertionError


def lookup(keys: DataFrame, fetch: Fetch, *, per_second: float = 20, partitions: int = 4, retries: int = 4) -> DataFrame:
    """``key, status, body, attempts, outcome`` for ``keys(key string)``; outcome is ``ok``, ``gone`` or ``error``.

    A token bucket in each of ``partitions`` tasks keeps the sum at ``per_second``.  A task that is run again asks again,
    so lookups must be idempotent.
    """
    rate = per_second / partitions

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, last = rate, time.monotonic()
        for f in frames:
            rows = []
            for key in f["key"]:
                while True:
                    now = time.monotonic()
                    tokens, last = min(max(rate, 1.0), tokens + (now - last) * rate), now
                    if tokens >= 1:
                        tokens -= 1
                        break
                    time.sleep(0.025)
                status, body, attempts = one(key, fetch, retries)
                rows.append((key, status, body, attempts, "ok" if status == 200 else "gone" if status == 404 else "error"))
            yield pd.DataFrame(rows, columns=["key", "status", "body", "attempts", "outcome"])

    return keys.select("key").repartition(partitions).mapInPandas(run, "key string, status int, body string, attempts int, outcome string")


def chunked(keys: list[str], size: int) -> list[list[str]]:
    """Keys in requests of ``size``, for services that take many at once."""
    return [keys[i : i + size] for i in range(0, len(keys), size)]


def values_request(keys: list[str], variable: str = "page") -> str:
    """The keys of a chunk as a VALUES clause, which pushes the semi-join to the service."""
    quoted = " ".join("<" + k.replace("<", "%3C").replace(">", "%3E").replace(" ", "%20") + ">" for k in keys)
    return f"VALUES ?{variable} {{ {quoted} }}"


def lookup_chunks(keys: DataFrame, fetch: Callable[[str], tuple[int, list[dict] | None]], columns: str, *, size: int = 400, attempts: int = 5, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep, partitions: int = 2) -> DataFrame:
    """Answers to ``keys(key string)``, asked ``size`` at a time: rows of ``columns`` (a schema).

    ``fetch(request) -> (status, rows)`` gets a :func:`values_request`.  A chunk that fails is asked again, ``attempts``
    times in all, with a wait that doubles; if it fails for good the task raises, as an answer of some would be taken for all.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in columns.split(",")]
        held: list[str] = []

        def ask(chunk: list[str]) -> pd.DataFrame:
            for n in range(attempts):
                status, rows = fetch(values_request(chunk))
                if status == 200:
                    return pd.DataFrame([[r.get(c) for c in names] for r in rows or []], columns=names)
                if n + 1 < attempts:
                    sleep(wait * 2**n)
            raise RuntimeError(f"no answer to a chunk: status {status}")

        for f in frames:
            held += list(f["key"])
            while len(held) >= size:
                yield ask(held[:size])
                held = held[size:]
        if held:
            yield ask(held)

    return keys.select("key").repartition(partitions).mapInPandas(run, columns)
