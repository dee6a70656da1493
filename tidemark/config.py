"""Settings of the boundary job: one declared table of names, defaults and bounds, from which the checks follow."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any


def setting(default: Any, *, over: float | None = None, least: float | None = None, most: float | None = None, among: tuple[str, ...] | None = None) -> Any:
    """A field with its bounds; those of a tuple hold for each of its elements."""
    return field(default=default, metadata={"over": over, "least": least, "most": most, "among": among})


def _faults(name: str, value: Any, rule: dict[str, Any]) -> list[str]:
    tests = {
        "over": ("must be over", lambda x, bound: x > bound),
        "least": ("must be at least", lambda x, bound: x >= bound),
        "most": ("must be at most", lambda x, bound: x <= bound),
        "among": ("must be one of", lambda x, bound: x in bound),
    }
    parts = value if isinstance(value, tuple) else (value,)
    return [f"{name} {said} {rule[k]}, not {x!r}" for k, (said, holds) in tests.items() if rule.get(k) is not None for x in parts if x is not None and not holds(x, rule[k])]


@dataclass(frozen=True)
class BoundaryConfig:
    """Names and defaults are parameters of the studies. Values out of bounds are all named in one error."""

    frame_interval: float = setting(2.0, over=0)
    subtitle_window: float = setting(15.0, over=0)
    normalization: str = setting("zscore", among=("robust_percentile", "zscore"))
    robust_percentiles: tuple[float, float] = setting((5.0, 95.0), least=0, most=100)
    smoothing: str = setting("gaussian", among=("gaussian", "moving_average", "none"))
    smoothing_seconds: float = setting(6.0, least=0)
    peak_prominence: float = setting(0.8, least=0)
    peak_min_spacing: float = setting(20.0, least=0)
    tolerances: tuple[float, ...] = setting((5.0, 10.0, 20.0), least=0)
    event_tolerance: float = setting(10.0, least=0)
    context_seconds: float = setting(10.0, least=0)
    max_videos: int | None = setting(None, least=1)

    def __post_init__(self):
        faults = [x for f in fields(self) for x in _faults(f.name, getattr(self, f.name), f.metadata)]
        low, high = self.robust_percentiles
        if low >= high:
            faults.append(f"robust_percentiles must rise, not {self.robust_percentiles!r}")
        if faults:
            raise ValueError("; ".join(faults))
