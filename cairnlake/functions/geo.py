"""Points as longitude and latitude columns, and grid cells."""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius in metres, and in kilometres as some callers have it.
EARTH_M, EARTH_KM, EARTH_KM_ROUND = 6_371_008.8, 6371.0088, 6371.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * radius) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


#: Half the longer axis and the flattening of the WGS 84 ellipsoid.
AXIS_M, FLATTENING = 6_378_137.0, 1 / 298.257223563
#: A sphere's distance is off by less than this share of the ellipsoid's.
SPHERE_ERROR = 0.006


def geodesic(lat1: Column, lon1: Column, lat2: Column, lon2: Column, steps: int = 12) -> Column:
    """Distance on the ellipsoid in metres, by the inverse formula with so many steps; to a tenth of a millimetre.

    Null for points that are almost opposite on the globe, for which the steps don't settle.  The steps run over the columns
    of an Arrow batch: as nested expressions they cost many times as much for each pair.
    """

    @F.pandas_udf("double")
    def measured(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
        return pd.Series(_inverse(*(np.asarray(x, float) for x in (lat1, lon1, lat2, lon2)), steps)).astype("Float64")

    return measured(*(x.cast("double") for x in (lat1, lon1, lat2, lon2)))


def _inverse(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray, steps: int) -> np.ndarray:
    f, minor = FLATTENING, AXIS_M * (1 - FLATTENING)
    turn = np.radians(np.mod(lon2 - lon1 + 180, 360.0) - 180)
    u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(lat))) for lat in (lat1, lat2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)

    def arc(lam: np.ndarray) -> tuple[np.ndarray, ...]:
        """Angles of the great circle on the auxiliary sphere: sine, cosine and size of the arc, sine of the azimuth, what its square leaves of 1, cosine of twice the middle."""
        turned = np.cos(lam)
        sine = np.sqrt((c2 * np.sin(lam)) ** 2 + (c1 * s2 - s1 * c2 * turned) ** 2)
        cosine = s1 * s2 + c1 * c2 * turned
        azimuth = np.where(sine == 0, 0.0, c1 * c2 * np.sin(lam) / np.where(sine == 0, 1.0, sine))
        rest = 1 - azimuth * azimuth
        level = azimuth * azimuth >= 1
        return sine, cosine, np.arctan2(sine, cosine), azimuth, rest, np.where(level, 0.0, cosine - 2 * s1 * s2 / np.where(level, 1.0, rest))

    now = before = turn
    for _ in range(steps):
        sine, cosine, size, azimuth, rest, middle = arc(now)
        c = f / 16 * rest * (4 + f * (4 - 3 * rest))
        now, before = turn + (1 - c) * f * azimuth * (size + c * sine * (middle + c * cosine * (2 * middle * middle - 1))), now
        if np.array_equal(now, before):
            break
    sine, cosine, size, _, rest, m = arc(now)
    squared = rest * ((AXIS_M * AXIS_M - minor * minor) / (minor * minor))
    a = 1 + squared / 16384 * (4096 + squared * (squared * (320 - 175 * squared) - 768))
    b = squared / 1024 * (256 + squared * (squared * (74 - 47 * squared) - 128))
    less = b * sine * (m + b / 4 * (cosine * (2 * m * m - 1) - b / 6 * m * (4 * sine * sine - 3) * (4 * m * m - 3)))
    same = (lat1 == lat2) & (np.mod(lon2 - lon1, 360.0) == 0)
    return np.where(same, 0.0, np.where(np.abs(now - before) < 1e-11, minor * a * (size - less), np.nan))


def planar_square(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Squared degrees with longitudes shrunk by the latitude; good for sorting by distance."""
    return F.pow(lat1 - lat2, 2) + F.pow((lon1 - lon2) * F.cos(F.radians(lat2)), 2)


def valid_point(lon: Column, lat: Column) -> Column:
    fits = lon.between(-180, 180) & lat.between(-90, 90) & ~((lon == 0) & (lat == 0))
    return F.coalesce(fits & ~F.isnan(lon) & ~F.isnan(lat), F.lit(False))


def in_box(lon: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    if not (west < east and south < north):
        raise ValueError("a box needs west < east and south < north")
    return lon.between(max(-180, west), min(180, east)) & lat.between(max(-90, south), min(90, north))


def cluster_degrees(zoom: float) -> float:
    """Cell size for a zoom level, within 0.04 and 45 degrees."""
    return max(0.04, min(45.0, 360 / 2 ** (math.floor(zoom) + 3)))


def cell(x: Column, size: float, origin: float = 0.0) -> Column:
    return F.floor((x - origin) / size).cast("long")
