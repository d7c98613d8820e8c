"""The time grid of an analysis."""

from __future__ import annotations

from dataclasses import dataclass

#: Columns that name a row of a landmark table.
KEYS = ["entity_key", "landmark_h"]


@dataclass(frozen=True)
class WindowSpec:
    """Landmarks from start to stop every step hours; look-back windows (t - lookback, t] cut into bins."""

    start: int = 24
    stop: int = 72
    step: int = 4
    lookback: int = 12
    bin: int = 2

    def __post_init__(self):
        if min(self.step, self.lookback, self.bin) <= 0 or self.lookback % self.bin:
            raise ValueError("step, lookback and bin must be positive, and lookback a multiple of bin")

    @property
    def bins(self) -> int:
        return self.lookback // self.bin
