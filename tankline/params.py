"""Every width and limit of the cleaning and detection steps, with the standard values."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from math import lcm


@dataclass(frozen=True)
class Params:
    # reading filter, litres, inclusive at both ends
    fuel_min: float = 0.0
    fuel_max: float = 4096.0
    # bin widths in whole seconds
    sensor_s: int = 10
    pre_s: int = 180
    period_s: int = 1800
    gap_s: int = 3600
    diff_s: int = 7200
    # a reading this far (volts) below the best of its gap bin is dropped
    voltage_drop: float = 4.0
    # a parked gain strictly between 0 and this is sensor noise
    parked_noise: float = 8.0
    # drain detection
    leak_limit: float = 9.0
    sigma: float = 3.0
    speed_ref: float = 60.0
    summer_months: tuple[int, int] = (3, 10)
    idle_threshold: float = 1.17 / 6
    idle_rate: dict = field(default_factory=lambda: {0: 1.17 / 6, 1: 1 / 6}, hash=False)
    # extra key columns: readings never meet across different values of these
    scope: tuple[str, ...] = ()
    # "slot" or "slice"; see operators/layout.py
    layout: str = "slot"

    def __post_init__(self):
        widths = (self.sensor_s, self.pre_s, self.period_s, self.gap_s, self.diff_s)
        if any(w <= 0 or w != int(w) for w in widths):
            raise ValueError("bin widths must be positive whole seconds")
        if self.layout not in ("slot", "slice"):
            raise ValueError(f"unknown layout {self.layout!r}")

    @classmethod
    def short(cls, **kw) -> Params:
        """The 2 / 10 minute variant."""
        return cls(**{"pre_s": 120, "period_s": 600, **kw})

    @property
    def slot_s(self) -> int:
        """Smallest width in which every bin nests."""
        return lcm(self.sensor_s, self.pre_s, self.period_s, self.gap_s, self.diff_s)

    @property
    def keys(self) -> list[str]:
        return [*self.scope, "auto"]

    def but(self, **kw) -> Params:
        return replace(self, **kw)
