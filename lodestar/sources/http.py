"""Fetching files on the driver, under one rate limit for the whole job; executors never fetch."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable
from pathlib import Path


class Fetcher:
    """At most rate requests a second. A file that is there is not fetched again."""

    def __init__(self, user_agent: str, rate: float = 8.0, timeout: float = 30.0, open_url: Callable | None = None, clock=time.monotonic, sleep=time.sleep):
        self.user_agent, self.gap, self.timeout = user_agent, 1 / rate, timeout
        self.open_url, self.clock, self.sleep, self.last = open_url or urllib.request.urlopen, clock, sleep, None

    def get(self, url: str) -> bytes:
        if self.last is not None and (wait := self.last + self.gap - self.clock()) > 0:
            self.sleep(wait)
        self.last = self.clock()
        with self.open_url(urllib.request.Request(url, headers={"User-Agent": self.user_agent}), timeout=self.timeout) as reply:
            return reply.read()

    def save(self, url: str, path: str | Path) -> Path:
        path = Path(path)
        if not path.exists():
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(self.get(url))
        return path
