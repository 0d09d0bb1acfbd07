"""Injectable time source, so that ``processed_at`` and ``indexed_at`` can be fixed in tests."""

from __future__ import annotations

import time
from dataclasses import dataclass


class SystemClock:
    """Wall-clock seconds since the epoch, UTC."""

    def time(self) -> float:
        return time.time()


@dataclass
class FixedClock:
    """A clock that only moves when told to."""

    now: float = 0.0

    def time(self) -> float:
        return self.now

    def advance(self, seconds: float) -> None:
        self.now += seconds
