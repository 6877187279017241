from .fields import (
    brightness_temperature,
    coriolis,
    ivt,
    null_if_negative,
    vapor_transport,
)
from .geodesy import (
    cell_id,
    cell_key,
    cosine_distance_m,
    great_circle_km,
    haversine_km,
    haversine_m,
    key_step,
    normalize_lon,
    roll_x,
)

__all__ = [
    "brightness_temperature",
    "coriolis",
    "ivt",
    "null_if_negative",
    "vapor_transport",
    "cell_id",
    "cell_key",
    "cosine_distance_m",
    "great_circle_km",
    "haversine_km",
    "haversine_m",
    "key_step",
    "normalize_lon",
    "roll_x",
]
