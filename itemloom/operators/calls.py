"""Calls of outside models at a bounded rate, with retries (inventory E2-E7).

``Paced`` wraps any provider; every operator that takes a provider takes it.
Prompts are dealt to ``callers`` tasks, and each has its share of the rate as
a token bucket of its own, a bounded number of calls in flight, and retries
with growing pauses.  So however many executors there are, the provider gets
no more calls in a second than ``rate`` and the ``callers`` that begin.
"""

from __future__ import annotations

import json
import os
import random
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

Clock = Callable[[], float]


class Throttled(Exception):
    """The provider asks to come back later."""

    def __init__(self, message: str = "too many calls", after: float | None = None):
        super().__init__(message)
        self.after = after


class Refused(Exception):
    """An answer that no retry will change."""


@dataclass
class Limits:
    """Bounds of all calls of one job together."""

    rate: float = 2.0
    """Calls in a second."""
    callers: int = 2
    """Tasks that call at the same time."""
    in_flight: int = 4
    """Calls that wait for an answer at the same time."""
    attempts: int = 4
    pause: float = 0.5
    """Seconds before the first retry; doubled with each one."""
    longest: float = 30.0


@dataclass
class Bucket:
    """One call every ``1 / rate`` seconds: each caller is told when its turn is."""

    rate: float
    clock: Clock = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    _next: float = 0.0
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def take(self) -> None:
        with self._lock:
            turn = max(self._next, self.clock())
            self._next = turn + 1 / self.rate
        wait = turn - self.clock()
        if wait > 0:
            self.sleep(wait)

    def back_off(self, seconds: float) -> None:
        """No call of this task for some seconds."""
        with self._lock:
            self._next = max(self._next, self.clock() + seconds)


def called(provider, prompt: str, limits: Limits, bucket: Bucket) -> tuple[str | None, int, str | None]:
    """(response, tries, error): null with the last error after ``attempts`` tries, or at once where the provider refuses."""
    error = None
    for n in range(1, limits.attempts + 1):
        bucket.take()
        try:
            return provider.complete(prompt), n, None
        except Refused as e:
            return None, n, str(e) or "refused"
        except Exception as e:  # noqa: BLE001  an outside service fails in ways of its own
            error = f"{type(e).__name__}: {e}"
            if isinstance(e, Throttled) and e.after is not None:
                bucket.back_off(e.after)
            elif n < limits.attempts:
                # spread, so that calls that failed together don't come back together
                bucket.sleep(min(limits.longest, limits.pause * 2 ** (n - 1)) * (0.5 + random.Random(f"{n}{prompt}").random()))
    return None, limits.attempts, error


@dataclass
class Paced:
    """A provider with limits."""

    provider: object
    limits: Limits = field(default_factory=Limits)

    def complete(self, prompt: str) -> str:
        """One call of its own, unpaced (for a single prompt on the driver)."""
        return self.provider.complete(prompt)

    def completed(self, rows: DataFrame, prompt: str = "prompt") -> DataFrame:
        """Adds ``response``, ``tries`` and ``call_error``."""
        provider, limits = self.provider, self.limits
        each, share = max(1, limits.in_flight // limits.callers), limits.rate / limits.callers

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            bucket = Bucket(share)
            with ThreadPoolExecutor(each) as pool:
                for pdf in batches:
                    got = list(pool.map(lambda p: called(provider, p, limits, bucket), pdf[prompt]))
                    response, tries, error = zip(*got, strict=True) if got else ((), (), ())
                    yield pdf.assign(response=pd.Series(response, index=pdf.index, dtype=object), tries=pd.Series(tries, index=pdf.index, dtype="int32"), call_error=pd.Series(error, index=pdf.index, dtype=object))

        from ..shipping import ship

        ship(rows.sparkSession)
        out = StructType([*rows.schema.fields, StructField("response", StringType()), StructField("tries", IntegerType()), StructField("call_error", StringType())])
        return rows.repartition(limits.callers).mapInPandas(run, out)


@dataclass
class ChatProvider:
    """A model behind an HTTP endpoint of the chat-completions form.

    The key comes from the environment of the process that calls, by name; it
    is never part of a plan or a log.
    """

    url: str
    model: str
    key_name: str = "MODEL_API_KEY"
    timeout: float = 60.0
    temperature: float = 0.0

    def complete(self, prompt: str) -> str:
        body = {"model": self.model, "temperature": self.temperature, "messages": [{"role": "user", "content": prompt}]}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get(self.key_name, '')}"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.load(answer)["choices"][0]["message"]["content"]
        except urllib.error.HTTPError as e:
            if e.code == 429 or e.code >= 500:
                after = e.headers.get("Retry-After")
                raise Throttled(f"HTTP {e.code}", float(after) if after and after.replace(".", "").isdigit() else None) from None
            raise Refused(f"HTTP {e.code}") from None
