"""Validated settings of the pipelines."""

from __future__ import annotations

from dataclasses import dataclass, replace

ALGORITHMS = ("GREEDY", "RANDOM", "GRASP")


def _check(settings: object, bounds: dict[str, tuple[float, float]], *more: str) -> None:
    """One error that names every setting out of its bounds, after ``more`` (messages, or empty)."""
    wrong = [m for m in more if m]
    for name, (low, high) in bounds.items():
        value = getattr(settings, name)
        if not low <= value <= high:
            wrong.append(f"{name} must be from {low} to {high}, not {value}")
    if wrong:
        raise ValueError("; ".join(wrong))


@dataclass(frozen=True)
class PipelineConfig:
    max_speed_kmh: float = 200.0
    cell_resolution: int = 12
    k: int = 2
    max_radius_m: float = 1000.0
    iterations: int = 10
    grasp_alpha: float = 0.3
    grasp_eval_budget: int = 500
    country: str | None = None
    retain_percent: float = 2.0
    buffer_m: float = 100.0
    algorithm: str = "RANDOM"

    def __post_init__(self) -> None:
        _check(
            self,
            {
                "max_speed_kmh": (1, 1000), "cell_resolution": (0, 15), "k": (1, 1_000_000), "max_radius_m": (1, 10_000_000), "iterations": (1, 100_000),
                "grasp_alpha": (0, 1), "grasp_eval_budget": (1, 100_000_000), "retain_percent": (0, 100), "buffer_m": (0, 1_000_000),
            },
            "" if self.country in (None, "sk", "cz", "at") else "country must be sk, cz, at or None",
            "" if self.algorithm in ALGORITHMS else f"algorithm must be one of {ALGORITHMS}",
        )

    def updated(self, **changes: object) -> PipelineConfig:
        return replace(self, **changes)


DEFAULTS = PipelineConfig()


class ConfigBook:
    """Settings by user; a user without own settings gets a copy of the defaults on first use."""

    def __init__(self, default: PipelineConfig = DEFAULTS) -> None:
        self._default, self._by_user = default, {}

    def active(self, user: object) -> PipelineConfig:
        return self._by_user.setdefault(user, self._default)

    def update(self, user: object, **changes: object) -> PipelineConfig:
        self._by_user[user] = self.active(user).updated(**changes)
        return self._by_user[user]

    def reset(self, user: object) -> PipelineConfig:
        self._by_user[user] = self._default
        return self._default


@dataclass(frozen=True)
class PlacementRequest:
    algorithm: str = "RANDOM"
    k: int = 2
    max_radius_m: float = 1000.0
    iterations: int = 1
    grasp_alpha: float = 0.3
    grasp_eval_budget: int = 500
    seed: int = 0

    def __post_init__(self) -> None:
        _check(
            self,
            {"k": (1, 1_000_000), "max_radius_m": (0, 10_000_000), "iterations": (1, 100_000), "grasp_alpha": (0, 1), "grasp_eval_budget": (1, 100_000_000)},
            "" if self.algorithm in ALGORITHMS else f"algorithm must be one of {ALGORITHMS}",
        )
