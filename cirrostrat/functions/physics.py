"""Thermodynamics, wind and radiation as column expressions. Temperatures are in kelvin, pressures in pascal unless said."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

# The saturation curve, the gas constant ratio, the lapse rate.
ES_0, ES_A, ES_T, ES_ZERO = 610.94, 17.625, 30.11, 273.15
EPSILON = 0.622
LAPSE_RATE = 0.0065
SOLAR_CONSTANT = 1367.0
STEFAN_BOLTZMANN = 5.67e-8


def saturation_pressure(t: Column) -> Column:
    return ES_0 * F.exp(ES_A * (t - ES_ZERO) / (t - ES_T))


def vapour_pressure(w: Column, p: Column) -> Column:
    return w / (w + EPSILON) * p


def saturation_mixing_ratio(t: Column, p: Column) -> Column:
    es = saturation_pressure(t)
    return EPSILON * es / (p - es)


def mixing_ratio(rh: Column, t: Column, p: Column) -> Column:
    return rh * saturation_mixing_ratio(t, p) / 100


def relative_humidity(w: Column, t: Column, p: Column, clip: bool = False) -> Column:
    rh = 100 * w / saturation_mixing_ratio(t, p)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), rh)) if clip else rh


def temperature(theta: Column, p: Column) -> Column:
    return theta * F.pow(p / 100000, F.lit(0.286))


def wind_components(speed: Column, direction: Column) -> tuple[Column, Column]:
    """Eastward and northward components of a wind that comes from `direction` degrees."""
    return -speed * F.sin(F.radians(direction)), -speed * F.cos(F.radians(direction))


def sounding_mixing_ratios(p: Column, t10: Column, depression10: Column, rh10: Column) -> tuple[Column, Column]:
    """Mixing ratios by dew point depression and by relative humidity; temperatures and humidities are in tenths."""
    t = t10 / 10
    e = lambda x: ES_0 * F.exp(ES_A * x / (ES_ZERO - ES_T + x))
    by_dew, by_rh = e(t - depression10 / 10), e(t) * rh10 / 1000
    return EPSILON * by_dew / (p - by_dew), EPSILON * by_rh / (p - by_rh)


def elevation_corrected(t: Column, model_elev: Column, elev: Column, rate: float = LAPSE_RATE) -> Column:
    return t + rate * (model_elev - elev)


def pressure_at(elev: Column) -> Column:
    """Surface pressure in hPa."""
    return 1013 * F.pow(1 - LAPSE_RATE * elev / 293, F.lit(5.26))


def day_angle(doy: Column) -> Column:
    return 2 * pi * doy / 365


def declination(doy: Column) -> Column:
    return 0.409 * F.sin(day_angle(doy) - 1.39)


def inverse_distance(doy: Column) -> Column:
    """The inverse relative distance from earth to sun."""
    return 1 + 0.033 * F.cos(day_angle(doy))


def sunset_angle(lat: Column, dec: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.tan(lat) * F.tan(dec))))


def extraterrestrial_daily(lat: Column, doy: Column) -> Column:
    """Mean daily radiation at the top of the atmosphere (W/m2); lat in radians."""
    dec = declination(doy)
    ws = sunset_angle(lat, dec)
    return SOLAR_CONSTANT / pi * inverse_distance(doy) * (ws * F.sin(lat) * F.sin(dec) + F.cos(lat) * F.cos(dec) * F.sin(ws))


def extraterrestrial_hourly(lat: Column, doy: Column, hour_angle: Column) -> Column:
    """Mean over the hour that begins at `hour_angle`, clipped at sunrise and sunset."""
    dec = declination(doy)
    ws = sunset_angle(lat, dec)
    clip = lambda w: F.greatest(-ws, F.least(ws, w))
    a, b = clip(hour_angle), clip(hour_angle + pi / 12)
    mu = 12 / pi * ((b - a) * F.sin(lat) * F.sin(dec) + F.cos(lat) * F.cos(dec) * (F.sin(b) - F.sin(a)))
    return F.greatest(F.lit(0.0), SOLAR_CONSTANT * inverse_distance(doy) * mu)


def wrapped_angle(h: Column) -> Column:
    """An hour angle in [-pi, pi)."""
    return F.pmod(h + pi, F.lit(2 * pi)) - pi


def transmission_dry(p: Column, mu: Column) -> Column:
    return F.exp(-1.8e-4 * p / mu)


def transmission_scattering(p: Column, mu: Column) -> Column:
    m = 35 / F.sqrt(1224 * mu * mu + 1)
    return 1.021 - 0.084 * F.sqrt(m * (949e-6 * p + 0.051))


def clear_sky_daily(ra: Column, elev: Column) -> Column:
    return (0.75 + 2e-5 * elev) * ra


def clear_sky_hourly(ra: Column, mu: Column, p: Column) -> Column:
    return ra * transmission_dry(p, mu)


def cloud_fraction(measured: Column, clear: Column) -> Column:
    return 1 - measured / clear


def longwave_isothermal(t: Column, cloud: Column) -> Column:
    return -STEFAN_BOLTZMANN * F.pow(t, F.lit(4)) * (1 - 9.35e-6 * t * t) + 60 * cloud
