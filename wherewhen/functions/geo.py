"""Distances, map projection and boxes as plain column arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radii, degree lengths near 32.7 N and the map scale.
EARTH_METERS = 6_371_000
EARTH_MILES = 3959
MILES_PER_DEGREE_LNG = 58.0
MILES_PER_DEGREE_LAT = 69.0
FEET_PER_MILE = 5280
TILE_PIXELS = 256
MERCATOR_LIMIT = 85.0511287798


@dataclass(frozen=True)
class Box:
    """A latitude/longitude rectangle, inclusive on all edges."""

    south: float
    west: float
    north: float
    east: float
    id: str | None = None
    label: str | None = None

    def contains(self, lat: Column, lng: Column) -> Column:
        return lat.between(self.south, self.north) & lng.between(self.west, self.east)

    @property
    def width_miles(self) -> float:
        return (self.east - self.west) * MILES_PER_DEGREE_LNG

    @property
    def height_miles(self) -> float:
        return (self.north - self.south) * MILES_PER_DEGREE_LAT


def great_circle(lat1, lng1, lat2, lng2, radius: float) -> Column:
    """Haversine distance in the unit of ``radius``."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lng = F.radians(lng2 - lng1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.sin(half_lng) * F.sin(half_lng)
    return F.lit(2.0 * radius) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def distance_label(miles: Column) -> Column:
    """Feet below a tenth of a mile, one decimal below ten miles, else whole miles."""
    tenths = F.floor(miles * 10 + 0.5)
    return (
        F.when(miles < 0.1, F.concat(F.floor(miles * FEET_PER_MILE + 0.5).cast("string"), F.lit(" ft")))
        .when(
            miles < 10,
            F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" mi")),
        )
        .otherwise(F.concat(F.floor(miles + 0.5).cast("string"), F.lit(" mi")))
    )


def pixel_x(lng: Column, zoom: int) -> Column:
    return (lng + 180) / 360 * float(TILE_PIXELS * 2**zoom)


def pixel_y(lat: Column, zoom: int) -> Column:
    clamped = F.greatest(F.least(lat, F.lit(MERCATOR_LIMIT)), F.lit(-MERCATOR_LIMIT))
    return (
        F.lit(0.5) - F.ln(F.tan(F.pi() / 4 + F.radians(clamped) / 2)) / (F.pi() * 2)
    ) * float(TILE_PIXELS * 2**zoom)


def has_position(lat: Column, lng: Column) -> Column:
    return lat.isNotNull() & lng.isNotNull() & ~F.isnan(lat) & ~F.isnan(lng)


def box_center(box: Column) -> Column:
    return F.struct(
        ((box["south"] + box["north"]) / 2).alias("lat"), ((box["west"] + box["east"]) / 2).alias("lng")
    )


def box_size(box: Column) -> Column:
    return F.struct(
        ((box["east"] - box["west"]) * MILES_PER_DEGREE_LNG).alias("width_miles"),
        ((box["north"] - box["south"]) * MILES_PER_DEGREE_LAT).alias("height_miles"),
    )


def box_rectangle(box: Column) -> Column:
    """Nested low/high corner form of a box."""
    return F.struct(
        F.struct(
            F.struct(box["south"].alias("latitude"), box["west"].alias("longitude")).alias("low"),
            F.struct(box["north"].alias("latitude"), box["east"].alias("longitude")).alias("high"),
        ).alias("rectangle")
    )


def quadrants(box: Column, overlap: float) -> Column:
    """Four children, south-west first; each reaches past the midline by ``overlap``."""
    mid_lat = (box["south"] + box["north"]) / 2
    mid_lng = (box["west"] + box["east"]) / 2
    over_lat = (box["north"] - box["south"]) * overlap
    over_lng = (box["east"] - box["west"]) * overlap

    def child(digit, south, west, north, east):
        return F.struct(
            F.lit(digit).alias("digit"), south.alias("south"), west.alias("west"),
            north.alias("north"), east.alias("east"),
        )

    return F.array(
        child("0", box["south"], box["west"], mid_lat + over_lat, mid_lng + over_lng),
        child("1", box["south"], mid_lng - over_lng, mid_lat + over_lat, box["east"]),
        child("2", mid_lat - over_lat, box["west"], box["north"], mid_lng + over_lng),
        child("3", mid_lat - over_lat, mid_lng - over_lng, box["north"], box["east"]),
    )
