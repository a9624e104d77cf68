"""Geographic transforms as SQL expressions: UTM zones and bands, transverse Mercator, web-Mercator tiles.

The expressions are ANSI SQL over named columns, so the same text serves spark.sql, selectExpr
and F.expr. Transverse Mercator is the Krueger series to the fourth order on WGS84.
"""

from __future__ import annotations

import math

# WGS84 and UTM.
AXIS, FLATTENING, SCALE, FALSE_EASTING, FALSE_NORTHING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
#: Half the circumference of the web-Mercator world, side of a tile, highest zoom of the look-up.
ORIGIN_SHIFT, TILE, MAX_ZOOM = math.pi * AXIS, 256, 34
#: Metres a pixel at zoom 0 away from the equator (fixed value).
ZOOM0 = 156543.03

_N = FLATTENING / (2 - FLATTENING)
_RADIUS = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_E = 2 * math.sqrt(_N) / (1 + _N)
# Series coefficients (fixed values, by powers of the third flattening).
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def _num(x: float) -> str:
    return f"({x!r}e0)" if "e" not in repr(x) else f"({x!r})"


def utm_zone(lat: str, lon: str) -> str:
    """UTM zone with the exceptions of Norway and Svalbard."""
    return (
        f"case when {lat} >= 56 and {lat} < 64 and {lon} >= 3 and {lon} < 12 then 32 "
        f"when {lat} >= 72 and {lat} < 84 and {lon} >= 0 and {lon} < 9 then 31 "
        f"when {lat} >= 72 and {lat} < 84 and {lon} >= 9 and {lon} < 21 then 33 "
        f"when {lat} >= 72 and {lat} < 84 and {lon} >= 21 and {lon} < 33 then 35 "
        f"when {lat} >= 72 and {lat} < 84 and {lon} >= 33 and {lon} < 42 then 37 "
        f"else cast(floor(1 + ({lon} + 180) / 6e0) as int) end"
    )


def utm_band(lat: str) -> str:
    """Latitude band letter C to X, or a blank outside."""
    return f"case when {lat} >= 84 or {lat} < -80 then ' ' when {lat} >= 72 then 'X' else substring('CDEFGHJKLMNPQRSTUVWX', cast(floor(({lat} + 80) / 8e0) as int) + 1, 1) end"


def utm_forward(lat: str, lon: str, zone: str) -> dict[str, str]:
    """easting and northing of a position, by steps: each value is an expression over the names before it."""
    series_x = " + ".join(f"{_num(a)} * cos({2 * k}e0 * tm_xi) * sinh({2 * k}e0 * tm_eta)" for k, a in enumerate(_ALPHA, 1))
    series_y = " + ".join(f"{_num(a)} * sin({2 * k}e0 * tm_xi) * cosh({2 * k}e0 * tm_eta)" for k, a in enumerate(_ALPHA, 1))
    return {
        "tm_lam": f"radians({lon} - (6e0 * {zone} - 183e0))",
        "tm_t": f"sinh(atanh(sin(radians({lat}))) - {_num(_E)} * atanh({_num(_E)} * sin(radians({lat}))))",
        "tm_xi": "atan2(tm_t, cos(tm_lam))",
        "tm_eta": "atanh(sin(tm_lam) / sqrt(1e0 + tm_t * tm_t))",
        "easting": f"{_num(FALSE_EASTING)} + {_num(SCALE * _RADIUS)} * (tm_eta + {series_x})",
        "northing": f"{_num(SCALE * _RADIUS)} * (tm_xi + {series_y}) + case when {lat} < 0 then {_num(FALSE_NORTHING)} else 0e0 end",
    }


def utm_inverse(easting: str, northing: str, zone: str, south: str = "false") -> dict[str, str]:
    """latitude and longitude of a UTM position, by steps."""
    xi = " - ".join(["iv_xi"] + [f"{_num(b)} * sin({2 * k}e0 * iv_xi) * cosh({2 * k}e0 * iv_eta)" for k, b in enumerate(_BETA, 1)])
    eta = " - ".join(["iv_eta"] + [f"{_num(b)} * cos({2 * k}e0 * iv_xi) * sinh({2 * k}e0 * iv_eta)" for k, b in enumerate(_BETA, 1)])
    lat = " + ".join(["iv_chi"] + [f"{_num(d)} * sin({2 * k}e0 * iv_chi)" for k, d in enumerate(_DELTA, 1)])
    return {
        "iv_xi": f"({northing} - case when {south} then {_num(FALSE_NORTHING)} else 0e0 end) / {_num(SCALE * _RADIUS)}",
        "iv_eta": f"({easting} - {_num(FALSE_EASTING)}) / {_num(SCALE * _RADIUS)}",
        "iv_xi1": xi,
        "iv_eta1": eta,
        "iv_chi": "asin(sin(iv_xi1) / cosh(iv_eta1))",
        "latitude": f"degrees({lat})",
        "longitude": f"(6e0 * {zone} - 183e0) + degrees(atan2(sinh(iv_eta1), cos(iv_xi1)))",
    }


def with_steps(df, steps: dict[str, str], drop: bool = True):
    """df with the columns of an expression dictionary, in order; helper columns (prefix_name) go."""
    from pyspark.sql import functions as F

    for name, text in steps.items():
        df = df.withColumn(name, F.expr(text))
    return df.drop(*[n for n in steps if n[:3] in ("tm_", "iv_")]) if drop else df


def sql_steps(source: str, steps: dict[str, str]) -> str:
    """The same as nested SQL over a query."""
    for name, text in steps.items():
        source = f"select *, {text} as {name} from ({source}) s_{name}"
    return source


def dms(d: str, m: str, s: str) -> str:
    """Decimal degrees."""
    return f"{d} + {m} / 60e0 + {s} / 3600e0"


def meters_to_pixels(m: str, zoom: str) -> str:
    """Whole pixels from the world's south-west corner."""
    return f"cast(floor(({m} + {_num(ORIGIN_SHIFT)}) / ({_num(2 * ORIGIN_SHIFT / TILE)} / power(2e0, {zoom}))) as bigint)"


def pixels_to_meters(p: str, zoom: str) -> str:
    return f"{p} * ({_num(2 * ORIGIN_SHIFT / TILE)} / power(2e0, {zoom})) - {_num(ORIGIN_SHIFT)}"


def pixel_tile(p: str) -> str:
    """Tile of a pixel, counted from the south-west."""
    return f"cast(ceil({p} / {TILE}e0) as bigint) - 1"


def zoom_resolution(zoom: str, lat: str) -> str:
    """Metres a pixel."""
    return f"case when abs({lat}) < 0.01e0 then {_num(2 * ORIGIN_SHIFT / TILE)} / power(2e0, {zoom}) else {_num(ZOOM0)} * cos(radians({lat})) / power(2e0, {zoom}) end"


def tile_x(lon: str, zoom: str) -> str:
    return f"cast(floor(({lon} + 180e0) / 360e0 * power(2e0, {zoom})) as bigint)"


def tile_y(lat: str, zoom: str) -> str:
    """Row of a slippy-map tile, counted from the north."""
    return f"cast(floor((1e0 - ln(tan(radians({lat})) + 1e0 / cos(radians({lat}))) / pi()) / 2e0 * power(2e0, {zoom})) as bigint)"


def tile_lon(x: str, zoom: str) -> str:
    return f"{x} / power(2e0, {zoom}) * 360e0 - 180e0"


def tile_lat(y: str, zoom: str) -> str:
    return f"degrees(atan(sinh(pi() - 2e0 * pi() * {y} / power(2e0, {zoom}))))"


def utm_places(lat, lon, zone: int, south: bool = False):
    """easting and northing of numpy arrays of positions, by the same series."""
    import numpy as np

    lam, s = np.radians(lon - (6 * zone - 183)), np.sin(np.radians(lat))
    t = np.sinh(np.arctanh(s) - _E * np.arctanh(_E * s))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    x = eta + sum(a * np.cos(2 * k * xi) * np.sinh(2 * k * eta) for k, a in enumerate(_ALPHA, 1))
    y = xi + sum(a * np.sin(2 * k * xi) * np.cosh(2 * k * eta) for k, a in enumerate(_ALPHA, 1))
    return FALSE_EASTING + SCALE * _RADIUS * x, SCALE * _RADIUS * y + (FALSE_NORTHING if south else 0)


def utm_positions(easting, northing, zone: int, south: bool = False):
    """latitude and longitude of numpy arrays of UTM places."""
    import numpy as np

    xi, eta = (northing - (FALSE_NORTHING if south else 0)) / (SCALE * _RADIUS), (easting - FALSE_EASTING) / (SCALE * _RADIUS)
    x = xi - sum(b * np.sin(2 * k * xi) * np.cosh(2 * k * eta) for k, b in enumerate(_BETA, 1))
    y = eta - sum(b * np.cos(2 * k * xi) * np.sinh(2 * k * eta) for k, b in enumerate(_BETA, 1))
    chi = np.arcsin(np.sin(x) / np.cosh(y))
    lat = chi + sum(d * np.sin(2 * k * chi) for k, d in enumerate(_DELTA, 1))
    return np.degrees(lat), 6 * zone - 183 + np.degrees(np.arctan2(np.sinh(y), np.cos(x)))
