"""Wall time in nanoseconds. There is no cycle counter to read here, so cycles are nanoseconds."""

from __future__ import annotations

import time


class Clock:
    """Laps since the last call, or since it was made."""

    def __init__(self):
        self.at = time.perf_counter_ns()

    def lap(self) -> int:
        now = time.perf_counter_ns()
        spent, self.at = now - self.at, now
        return spent


def replay_multiplier(span_ns: int, decode_ns: int) -> float:
    """Market time replayed in one unit of decode time; 0 where nothing was timed."""
    return span_ns / decode_ns if decode_ns else 0.0
