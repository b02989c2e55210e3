"""Thresholds of all operators, validated; read from YAML or taken as they stand here."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field, fields
from datetime import date
from typing import Any

AGP_DAYS, TREND_DAYS, REPORT_DAYS = ((14, 30, 90), 30), ((7, 14, 30), 14), ((14, 30, 90), 14)


@dataclass(frozen=True)
class BgTargets:
    low: int = 70
    high: int = 180
    target: int = 110


@dataclass(frozen=True)
class MealRise:
    window_minutes: int = 30
    fetch_buffer_minutes: int = 15
    expected_interval_minutes: int = 5
    fetch_readings_padding: int = 3
    min_samples: int = 4
    min_coverage: float = 0.7
    base_slope_mgdl_per_min: float = 1.8
    start_level_min: int = 70
    start_level_max: int = 250
    meal_windows: tuple[tuple[int, int, float], ...] = ((6, 10, 0.7), (11, 14, 0.7), (17, 21, 0.7))
    off_hours_multiplier: float = 1.3
    refractory_minutes: int = 60
    max_reading_age_minutes: int = 15


@dataclass(frozen=True)
class Calibration:
    pre_bolus_lookback_minutes: int = 30
    late_bolus_lookahead_minutes: int = 45
    correction_lookahead_minutes: int = 180


@dataclass(frozen=True)
class SiteChange:
    forced_window_minutes: int = 120
    cartridge_real_fill_threshold: float = 220.0
    occlusion_cluster_window_minutes: int = 180
    min_occlusions_for_cluster: int = 2


@dataclass(frozen=True)
class Anomaly:
    spike_threshold: float = 180.0
    drop_threshold: float = 70.0
    flatline_tolerance: float = 2.0
    flatline_consecutive_intervals: int = 12


@dataclass(frozen=True)
class MealRun:
    rise_threshold_per_5min: float = 8.0
    sustained_intervals: int = 3
    no_bolus_window_minutes: int = 30
    meal_windows: tuple[tuple[int, int], ...] = ((6, 10), (11, 14), (17, 23))


@dataclass(frozen=True)
class Clustering:
    method: str = "kmeans"
    n_clusters: int = 5
    feature_mode: str = "daily"
    random_seed: int = 42
    model_dir: str = "models"


@dataclass(frozen=True)
class Config:
    timezone: str = "America/Los_Angeles"
    bg_targets: BgTargets = field(default_factory=BgTargets)
    meal_rise: MealRise = field(default_factory=MealRise)
    calibration: Calibration = field(default_factory=Calibration)
    site_change: SiteChange = field(default_factory=SiteChange)
    anomaly: Anomaly = field(default_factory=Anomaly)
    meal_run: MealRun = field(default_factory=MealRun)
    clustering: Clustering = field(default_factory=Clustering)


_BLOCKS = {"bg_targets": BgTargets, "meal_rise": MealRise, "meal_rise_calibration": Calibration, "site_change_detection": SiteChange, "anomaly_detection": Anomaly, "meal_detection": MealRun, "clustering": Clustering}
#: Blocks that older configurations lack.
_OPTIONAL = {"meal_rise_calibration"}
_NAMES = {"meal_rise_calibration": "calibration", "site_change_detection": "site_change", "anomaly_detection": "anomaly", "meal_detection": "meal_run"}


def _require(holds: bool, what: str) -> None:
    if not holds:
        raise ValueError(what)


def _windows(block: str, raw: list[Any]) -> tuple[tuple, ...]:
    """Windows as [start, end], or as start_hour, end_hour and multiplier for fast rises."""
    rise, out = block == "meal_rise", []
    for w in raw:
        _require(isinstance(w, dict) if rise else isinstance(w, (list, tuple)) and len(w) == 2, f"{block}.meal_windows: {w!r} has another form than expected")
        got = (int(w["start_hour"]), int(w["end_hour"]), float(w["multiplier"])) if rise else (int(w[0]), int(w[1]))
        _require(0 <= got[0] < got[1] <= 24, f"{block}.meal_windows: hours from 0 to 24, start before end, not {got[:2]}")
        _require(not rise or got[2] > 0, f"{block}.meal_windows: a multiplier is positive")
        out.append(got)
    return tuple(out)


def parse(raw: dict[str, Any]) -> Config:
    """KeyError for a missing block, ValueError for values that can't be."""
    zone = raw["ingestion"].get("timezone")
    if not zone:
        raise KeyError("ingestion.timezone")
    got: dict[str, Any] = {"timezone": str(zone)}
    for block, kind in _BLOCKS.items():
        given = raw.get(block, {}) if block in _OPTIONAL else raw[block]
        values = {k: v for k, v in given.items() if k in {f.name for f in fields(kind)}}
        if "meal_windows" in values:
            values["meal_windows"] = _windows(block, values["meal_windows"])
        got[_NAMES.get(block, block)] = kind(**values)
    config = Config(**got)
    t, m, a, c = config.bg_targets, config.meal_rise, config.anomaly, config.calibration
    _require(0 < t.low < t.target < t.high, "bg_targets: 0 < low < target < high")
    _require(m.window_minutes > 0 and m.min_samples >= 2, "meal_rise: a window and two samples at least")
    _require(0 < m.min_coverage <= 1, "meal_rise.min_coverage: over 0, at most 1")
    _require(m.start_level_min < m.start_level_max, "meal_rise: start_level_min below start_level_max")
    _require(min(m.refractory_minutes, m.expected_interval_minutes, m.max_reading_age_minutes) > 0, "meal_rise: refractory time, interval and reading age are positive")
    _require(min(m.fetch_buffer_minutes, m.fetch_readings_padding) >= 0, "meal_rise: buffer and padding aren't negative")
    _require(min(c.pre_bolus_lookback_minutes, c.late_bolus_lookahead_minutes, c.correction_lookahead_minutes) > 0, "meal_rise_calibration: minutes are positive")
    _require(a.drop_threshold < a.spike_threshold, "anomaly_detection: drop_threshold below spike_threshold")
    _require(a.flatline_consecutive_intervals >= 2, "anomaly_detection.flatline_consecutive_intervals: 2 at least")
    _require(config.clustering.n_clusters >= 2, "clustering.n_clusters: 2 at least")
    return config


@functools.lru_cache(maxsize=8)
def load(path: str) -> Config:
    import yaml

    with open(path) as f:
        return parse(yaml.safe_load(f))


def one_of(value: Any, allowed: tuple[tuple[int, ...], int]) -> int:
    """A whitelisted number, or the default."""
    try:
        return int(value) if int(value) in allowed[0] else allowed[1]
    except (TypeError, ValueError):
        return allowed[1]


def clamp(value: Any, low: int, high: int, default: int) -> int:
    try:
        return min(high, max(low, int(value)))
    except (TypeError, ValueError):
        return default


def parse_date(value: Any) -> date | None:
    try:
        return date.fromisoformat(str(value))
    except ValueError:
        return None


def poll_depth(m: MealRise) -> int:
    """How many of the newest readings a live poll asks for."""
    return (m.window_minutes + m.fetch_buffer_minutes) // m.expected_interval_minutes + m.fetch_readings_padding
