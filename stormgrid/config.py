"""Threshold sets for object detection and classification.

All values are fixed defaults of the method; lifetimes are hours, areas km2, rain
mm per hour, temperatures K, pressures hPa.
"""

from __future__ import annotations

from dataclasses import dataclass, field


def steps_in(hours: float, dt: float) -> int:
    """Whole time steps in a duration, truncated, at least one."""
    return max(1, int(hours / dt))


@dataclass(frozen=True)
class RainConfig:
    threshold: float = 5.0
    min_time_h: float = 3.0
    min_area_km2: float = 500.0
    smooth_sigma: float = 0.0


@dataclass(frozen=True)
class CloudConfig:
    threshold: float = 241.0
    min_time_h: float = 5.0
    min_area_km2: float = 1000.0
    smooth_sigma: float = 0.0
    breakup: bool = False


@dataclass(frozen=True)
class StormConfig:
    min_rain_area_km2: float = 500.0
    step_peak: float = 5.0
    lifetime_peak: float | None = 15.0
    max_bt: float = 225.0
    min_cloud_area_km2: float = 1000.0
    min_time_h: float = 5.0
    # compat drops the lowest cloud id of rain objects which lie wholly under clouds
    compat_overlap: bool = False
    bt_scope: str = "bbox"


@dataclass(frozen=True)
class TrackConfig:
    """Everything ``track_storms`` needs."""

    dt_hours: float = 1.0
    rain: RainConfig = field(default_factory=RainConfig)
    cloud: CloudConfig = field(default_factory=CloudConfig)
    storm: StormConfig = field(default_factory=StormConfig)
    # both fields must be known at the same cells; otherwise an error
    aligned: bool = False


def observed_profile() -> TrackConfig:
    """Thresholds for satellite rain and infrared data on a continental grid."""
    return TrackConfig(
        rain=RainConfig(2.0, 3.0, 5000.0),
        cloud=CloudConfig(241.0, 9.0, 40000.0, breakup=True),
        storm=StormConfig(5000.0, 10.0, 10.0, 225.0, 40000.0, 4.0),
    )


@dataclass(frozen=True)
class MoistureConfig:
    stream_threshold: float = 0.13
    stream_min_time_h: float = 9.0
    stream_min_area_km2: float = 100000.0
    ivt_threshold: float = 500.0
    ivt_min_time_h: float = 9.0
    river_min_length_km: float = 2000.0
    river_min_abs_lat: float = 20.0
    river_min_ratio: float = 2.0
    # field on which transport objects are measured in ``identify_all``
    ivt_statistic: str = "vap"


@dataclass(frozen=True)
class PressureConfig:
    low_anomaly: float = -8.0
    low_min_time_h: float = 12.0
    high_anomaly: float = 6.0
    high_min_time_h: float = 12.0
    fine_km: float = 100.0
    coarse_km: float = 3000.0
    coarse_h: float = 78.0


@dataclass(frozen=True)
class FrontConfig:
    threshold: float = 1.0
    min_area_km2: float = 50000.0
    min_abs_lat: float = 10.0
    gradient_unit: float = 0.45


@dataclass(frozen=True)
class CycloneConfig:
    """Tropical-cyclone gates; the step counts do not depend on the time step."""

    min_steps: int = 16
    min_warm_steps: int = 8
    min_deep_steps: int = 8
    max_pressure: float = 995.0
    max_genesis_lat: float = 35.0
    max_lat: float = 60.0
    core_excess: float = 0.0
    min_core_t: float = 285.0


@dataclass(frozen=True)
class AllObjectsConfig:
    """Everything ``identify_all`` needs."""

    dt_hours: float = 1.0
    rain: RainConfig = field(default_factory=lambda: RainConfig(2.0, 6.0, 5000.0))
    cloud: CloudConfig = field(default_factory=lambda: CloudConfig(241.0, 9.0, 40000.0, breakup=True))
    storm: StormConfig = field(
        default_factory=lambda: StormConfig(2500.0, 10.0, None, 225.0, 40000.0, 4.0)
    )
    moisture: MoistureConfig = field(default_factory=MoistureConfig)
    pressure: PressureConfig = field(default_factory=PressureConfig)
    front: FrontConfig = field(default_factory=FrontConfig)
    cyclone: CycloneConfig = field(default_factory=CycloneConfig)
    river_exclusion_lat: float = 25.0
    # rivers exclude storm steps north of that latitude only, as the method does
    river_exclusion_north: bool = True
