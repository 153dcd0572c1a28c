"""Positions: great-circle distance and geohash cells as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
#: Fixed value: the published geohash alphabet.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def cell_numbers(lat: Column, lon: Column, precision: int) -> tuple[Column, Column]:
    """Row and column of the geohash cell of a position."""
    bits = 5 * precision
    lon_bits, lat_bits = (bits + 1) // 2, bits // 2
    number = lambda v, low, span, n: F.least(F.floor((v - low) / span * (1 << n)), F.lit((1 << n) - 1)).cast("bigint")
    return number(lat, -90.0, 180.0, lat_bits), number(lon, -180.0, 360.0, lon_bits)


def geohash(lat: Column, lon: Column, precision: int = 6) -> Column:
    """Letters of five interleaved bits, longitude first."""
    bits = 5 * precision
    lat_n, lon_n = cell_numbers(lat, lon, precision)
    letters = []
    for k in range(precision):
        value = F.lit(0).cast("bigint")
        for b in range(5):
            i = 5 * k + b
            source, place = (lon_n, (bits + 1) // 2 - 1 - i // 2) if i % 2 == 0 else (lat_n, bits // 2 - 1 - i // 2)
            value = value * 2 + F.shiftright(source, place).bitwiseAND(F.lit(1).cast("bigint"))
        letters.append(F.substring(F.lit(ALPHABET), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*letters)


def box(lat: float, lon: float, radius: float, at_lat: Column, at_lon: Column) -> Column:
    """Whether a place lies in the box around a circle; a circle that reaches a pole or the date line isn't bounded in longitude."""
    high = math.degrees(radius / EARTH_RADIUS_M) * (1 + 1e-9)
    inside = at_lat.between(lat - high, lat + high)
    reach = math.cos(math.radians(min(90.0, abs(lat) + high)))
    wide = math.degrees(math.asin(min(1.0, math.sin(min(math.pi / 2, radius / EARTH_RADIUS_M)) / reach))) * (1 + 1e-9) if reach > 1e-9 else 360.0
    if abs(lat) + high >= 90 or lon - wide < -180 or lon + wide > 180:
        return inside
    return inside & at_lon.between(lon - wide, lon + wide)


def decoded(cell: Column, precision: int) -> tuple[Column, Column, Column, Column]:
    """(south, north, west, east) of the box of a geohash of `precision` letters."""
    bits = 5 * precision
    row = column = F.lit(0).cast("bigint")
    for k in range(precision):
        value = (F.instr(F.lit(ALPHABET), F.substring(cell, k + 1, 1)) - 1).cast("bigint")
        for b in range(5):
            bit = F.shiftright(value, 4 - b).bitwiseAND(F.lit(1).cast("bigint"))
            if (5 * k + b) % 2 == 0:
                column = column * 2 + bit
            else:
                row = row * 2 + bit
    high, wide = 180.0 / (1 << (bits // 2)), 360.0 / (1 << ((bits + 1) // 2))
    south, west = row * high - 90.0, column * wide - 180.0
    return south, south + high, west, west + wide


# Widths of cells of one to nine letters, in metres.
WIDTHS = (5_009_400.0, 1_252_300.0, 156_500.0, 39_100.0, 4_900.0, 1_200.0, 152.9, 38.2, 4.8)


def letters_for(radius: Column) -> Column:
    """The letters of the first cells not wider than a circle; null for a radius that isn't above 0."""
    out = F.lit(10)
    for k, width in reversed(list(enumerate(WIDTHS))):
        out = F.when(F.lit(width) <= 2 * radius, k + 1).otherwise(out)
    return F.when(radius > 0, out)


def cells_around(lat: Column, lon: Column, precision: int) -> Column:
    """The cell of a place and its eight neighbours: around the date line, not over a pole."""
    bits = 5 * precision
    high, wide = 180.0 / (1 << (bits // 2)), 360.0 / (1 << ((bits + 1) // 2))
    cells = []
    for i in (-1, 0, 1):
        for j in (-1, 0, 1):
            y = F.least(F.greatest(lat + i * high, F.lit(-90.0)), F.lit(90.0))
            x = (lon + j * wide + 540.0) % 360.0 - 180.0
            cells.append(geohash(y, x, precision))
    return F.array(*cells)
