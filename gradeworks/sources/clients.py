"""Calls to models as a plan: any client, with retries, spending bounds and resumption."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "sample_id string, config_id string, raw_answer string, input_tokens long, output_tokens long, latency_ms long, error string"

#: A client takes a query, a configuration and an image's bytes or None; it returns (answer, input tokens, output tokens).
Client = Callable[[str, str, bytes | None], tuple[str, int, int]]


def call(work: DataFrame, client: Client, attempts: int = 3, pause: float = 2.0) -> DataFrame:
    """The answer to every row of ``work`` (sample_id, config_id, query, image): one row each.

    A failing call is tried again after a pause that doubles; after the last attempt the row has its
    error and no answer.  Executors that are lost repeat the calls of their unfinished partitions.
    """
    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                began, error, got, wait = time.monotonic(), None, (None, None, None), pause
                for attempt in range(attempts):
                    try:
                        got, error = client(row.query, row.config_id, row.image), None
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"[:500]
                        if attempt + 1 < attempts:
                            time.sleep(wait)
                            wait *= 2
                out.append((row.sample_id, row.config_id, *got, int(1000 * (time.monotonic() - began)), error))
            yield pd.DataFrame(out, columns=["sample_id", "config_id", "raw_answer", "input_tokens", "output_tokens", "latency_ms", "error"]).astype({"input_tokens": "Int64", "output_tokens": "Int64"})

    return work.select("sample_id", "config_id", "query", "image").mapInPandas(ask, RESULT)


def images(spark, path: str) -> DataFrame:
    """Files of a folder: path, size, MD5 of the bytes, and the bytes in base 64."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.md5("content").alias("md5"), F.base64("content").alias("base64"))


#: Clients by the name of their provider, as registered by the application.
PROVIDERS: dict[str, Callable[..., Client]] = {}


def register(provider: str, make: Callable[..., Client]) -> None:
    """Make a provider known: ``make`` takes its options and gives a client."""
    PROVIDERS[provider] = make


def client_of(provider: str, **options: object) -> Client:
    """The client of a provider; an unknown one raises."""
    if provider not in PROVIDERS:
        raise ValueError(f"no client for {provider}")
    return PROVIDERS[provider](**options)


class Progress:
    """How far a job of known size has come, and when it may end."""

    def __init__(self, total: int, clock: Callable[[], float] = time.monotonic) -> None:
        self.total, self.done, self.clock, self.began = total, 0, clock, clock()

    def tick(self, n: int = 1) -> tuple[int, str]:
        """Count ``n`` more; how many are done and the time left, in minutes or hours."""
        self.done += n
        elapsed = self.clock() - self.began
        if not self.done or elapsed <= 0:
            return self.done, "unknown"
        left = max(0, self.total - self.done) * elapsed / self.done
        return self.done, f"{left / 60:.1f}min" if left < 3600 else f"{left / 3600:.1f}h"
