"""Settings of a project, checked when they are made, and kept as JSON beside its data."""

from __future__ import annotations

import dataclasses
import datetime as dt
import json
from dataclasses import dataclass
from pathlib import Path


class ConfigError(ValueError):
    """A setting is outside its range."""


def _date(text: str) -> dt.date:
    try:
        return dt.date.fromisoformat(text)
    except (TypeError, ValueError) as e:
        raise ConfigError(f"not a date in the form YYYY-MM-DD: {text!r}") from e


@dataclass(frozen=True)
class ProjectConfig:
    name: str
    calibration_start: str = "2015-01-01"
    monitor_start: str = "2020-01-01"
    monitor_end: str = "2023-01-01"
    band: str = "ndfi"
    bands: tuple[str, ...] = ("green", "red", "nir", "swir1", "swir2", "ndfi")
    satellite: str = "Landsat"
    scale: float = 70.0
    grid_shape: str = "squared"
    grid_spacing: float = 0.05
    grid_strategy: str = "centroid"
    tree_cover: float = 10.0
    tree_height: float = 5.0
    mmu_hectares: float = 0.5
    max_error: float = 0.05
    confidence: float = 0.95
    smooth_days: int = 60
    outlier_z: float = 3.0
    percentile: float = 0.95
    clusters: int = 100
    points_per_cluster: int = 25
    seed: int = 42

    def __post_init__(self) -> None:
        if not self.name or any(c.isspace() for c in self.name):
            raise ConfigError("the name must not be empty or hold white space")
        a, b, c = _date(self.calibration_start), _date(self.monitor_start), _date(self.monitor_end)
        if not a < b < c:
            raise ConfigError("calibration must start before monitoring, and monitoring before its end")
        for field, low, high in (("scale", 0, 10_000), ("grid_spacing", 0, 1e7), ("tree_cover", -1, 101), ("tree_height", -1, 101), ("mmu_hectares", 0, 1e6), ("max_error", 0, 1), ("confidence", 0, 1), ("percentile", 0, 1), ("outlier_z", 0, 100)):
            if not low < getattr(self, field) < high:
                raise ConfigError(f"{field} must lie between {low} and {high}, it is {getattr(self, field)}")
        for field in ("smooth_days", "clusters", "points_per_cluster"):
            if getattr(self, field) < 1:
                raise ConfigError(f"{field} must be at least 1")
        if self.band not in self.bands:
            raise ConfigError(f"band {self.band!r} is none of {self.bands}")
        for field, choices in (("grid_shape", ("squared", "hexagonal")), ("grid_strategy", ("centroid", "random")), ("satellite", ("Landsat", "Planet"))):
            if getattr(self, field) not in choices:
                raise ConfigError(f"{field} must be one of {choices}")

    def save(self, path: str | Path, overwrite: bool = False) -> None:
        """Writes the settings; other settings that stand there already are only replaced with ``overwrite``."""
        p = Path(path)
        if p.exists() and not overwrite and self.load(p) != self:
            raise ConfigError(f"{p} holds other settings; pass overwrite=True to replace them")
        p.write_text(json.dumps(dataclasses.asdict(self), indent=2))

    @classmethod
    def load(cls, path: str | Path, name: str | None = None) -> ProjectConfig:
        """The settings in a file; defaults under ``name`` if there is no file."""
        p = Path(path)
        if not p.exists():
            return cls(name or p.stem)
        known = {f.name for f in dataclasses.fields(cls)}
        raw = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(p.read_text()).items()}
        if unknown := set(raw) - known:
            raise ConfigError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**raw)

    def changed(self, other: ProjectConfig) -> dict[str, tuple]:
        """Settings that differ: name -> (own, other)."""
        return {f.name: (getattr(self, f.name), getattr(other, f.name)) for f in dataclasses.fields(self) if getattr(self, f.name) != getattr(other, f.name)}
