"""Longitudes, boxes and area weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def signed_longitude(lon: Column) -> Column:
    """0..360 to -180..180."""
    return F.when(lon > 180, lon - 360).otherwise(lon)


def area_weight(lat: Column) -> Column:
    return F.cos(F.radians(lat))


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float], grid_max_lon: float) -> Column:
    """Inside (south, north, west, east), ends included. Longitudes of a grid that ends at
    180 or before are compared with the box a turn to the west if it begins east of 180. Plain ranges of
    both columns, so that they reach the scan."""
    turn = 360 * int(box[2] > 180 >= grid_max_lon)
    return lat.between(*box[:2]) & lon.between(*(edge - turn for edge in box[2:]))
