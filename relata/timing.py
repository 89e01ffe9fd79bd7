"""Time spent in named phases of a driver program."""

from __future__ import annotations

import logging
import time
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

log = logging.getLogger("relata.timing")


class Phases:
    """Seconds and calls of each phase; phases may be nested. Every ``every`` calls of one its mean is logged."""

    def __init__(self, every: int = 10_000):
        self.every = every
        self.seconds: dict[str, float] = defaultdict(float)
        self.calls: dict[str, int] = defaultdict(int)

    @contextmanager
    def __call__(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] += time.perf_counter() - began
            self.calls[name] += 1
            if self.calls[name] % self.every == 0:
                log.info("%s: %.6f s on average", name, self.mean(name))

    def mean(self, name: str) -> float:
        return self.seconds[name] / self.calls[name] if self.calls[name] else 0.0

    def report(self) -> list[tuple[str, int, float]]:
        """(phase, calls, seconds), the longest first."""
        return sorted(((n, self.calls[n], s) for n, s in self.seconds.items()), key=lambda r: -r[2])


phase = Phases()
