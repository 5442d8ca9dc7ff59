"""Column functions: geodesy, headings, time zones, texts.

Numbers are formatted by Spark's rules: whole numbers half-even (``bround``), decimals half-up.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from waytrace.functions import dimensions as dim

EARTH_RADIUS_MI = 3958.76
MILES_PER_DEGREE = 69.172
LEAST_COSINE = 0.2


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


# --- geodesy -------------------------------------------------------------


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_RADIUS_MI) * F.asin(F.sqrt(a))


def nmea_to_decimal(value: Column, hemisphere: Column) -> Column:
    degrees = F.when(value >= 0, F.floor(value / 100)).otherwise(F.ceil(value / 100))
    decimal = degrees + (value - degrees * 100) / 60
    return F.when(hemisphere.isin("S", "W"), -decimal).otherwise(decimal)


def miles_per_degree_lon(lat: Column) -> Column:
    return F.lit(MILES_PER_DEGREE) * F.cos(F.radians(lat))


def segment_miles(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment in projected miles; a segment of no length is its first end."""
    dx, dy = bx - ax, by - ay
    along = ((px - ax) * dx + (py - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(along, F.lit(0.0))))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def polyline_miles(lat: Column, lon: Column, line: Column) -> Column:
    """Distance of a point to an array of (lat, lon), projected at the point's latitude; raises on an empty line."""
    kx, ky = miles_per_degree_lon(lat), F.lit(MILES_PER_DEGREE)
    zero = F.lit(0.0)

    def to(a: Column, b: Column) -> Column:
        return segment_miles(zero, zero, (a["lon"] - lon) * kx, (a["lat"] - lat) * ky, (b["lon"] - lon) * kx, (b["lat"] - lat) * ky)

    ends = F.zip_with(F.slice(line, 1, F.greatest(F.lit(1), F.size(line) - 1)), F.slice(line, F.least(F.lit(2), F.size(line)), F.size(line)), to)
    return F.when(F.size(line) > 0, F.array_min(ends)).otherwise(F.raise_error(F.lit("the line has no points")).cast("double"))


def in_bbox(lat: Column, lon: Column, box: Column) -> Column:
    return lat.between(box["min_lat"], box["max_lat"]) & lon.between(box["min_lon"], box["max_lon"])


def quantized_point(lat: Column, lon: Column) -> Column:
    return F.format_string("%.5f,%.5f", lat, lon)


def canvas_height(width: int, lat_span: Column, lon_span: Column, mean_lat: Column) -> Column:
    """Height that fits the padded spans at their true aspect, from a third of the width to twice it."""
    aspect = F.lit(1.0) / F.greatest(F.cos(F.radians(mean_lat)), F.lit(LEAST_COSINE))
    height = F.floor(F.lit(width) * (lat_span * aspect) / lon_span).cast("int")
    return F.greatest(F.least(height, F.lit(2 * width)), F.lit(width // 3))


def letterbox_pad(width: int, height: int, lon_span: Column, lat_span: Column, mean_lat: Column) -> Column:
    """(lon_pad, lat_pad) per side that make the spans fit the panel."""
    aspect = F.lit(1.0) / F.greatest(F.cos(F.radians(mean_lat)), F.lit(LEAST_COSINE))
    target = F.lit(width / height)
    wide = lon_span / (lat_span * aspect) > target
    zero = F.lit(0.0)
    lat_pad = F.when(wide, F.greatest(zero, (lon_span / (target * aspect) - lat_span) / 2)).otherwise(zero)
    lon_pad = F.when(wide, zero).otherwise(F.greatest(zero, (lat_span * aspect * target - lon_span) / 2))
    return F.struct(lon_pad.alias("lon_pad"), lat_pad.alias("lat_pad"))


# --- headings ------------------------------------------------------------


def cardinal4(heading: Column) -> Column:
    h = F.pmod(heading, F.lit(360.0))
    return F.when((h >= 315) | (h < 45), "N").when(h < 135, "E").when(h < 225, "S").when(h.isNotNull(), "W")


def compass8(heading: Column) -> Column:
    octant = F.floor((F.pmod(heading, F.lit(360.0)) + 22.5) / 45) % 8
    return F.element_at(F.array(*[F.lit(x) for x in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")]), (octant + 1).cast("int"))


def compass_label(heading: Column) -> Column:
    return F.concat(compass8(heading), F.lit(" "), F.lpad(F.bround(heading, 0).cast("bigint").cast("string"), 3, "0"), F.lit("°"))


def circular_mean(sin_sum: Column, cos_sum: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(sin_sum, cos_sum)), F.lit(360.0))


# --- time ----------------------------------------------------------------


def zone_of(state: Column, lon: Column) -> Column:
    """The zone of a state; some states are split by a longitude. NULL where none is known."""
    zones = literal_map(dim.STATE_ZONES)
    zone = None
    for name, split, east, west in dim.ZONE_SPLITS:
        side = F.when(lon > split, east).otherwise(west)
        zone = F.when(state == name, side) if zone is None else zone.when(state == name, side)
    return zone.otherwise(F.try_element_at(zones, state))


def localized(ts: Column, zone: Column, adjust_hours: float = 0.0) -> Column:
    """UTC wall clock to the wall clock of ``zone`` (unknown: UTC)."""
    moved = ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(adjust_hours * 3600)) if adjust_hours else ts
    return F.convert_timezone(F.lit("UTC"), F.coalesce(zone, F.lit("UTC")), moved)


def local_date(ts: Column, zone: Column, adjust_hours: float = 0.0) -> Column:
    return F.date_format(localized(ts, zone, adjust_hours), "yyyy-MM-dd")


def zone_abbreviation(ts: Column, zone: Column, adjust_hours: float = 0.0) -> Column:
    zone = F.coalesce(zone, F.lit("UTC"))
    offset = F.timestamp_diff("MINUTE", localized(ts, F.lit("UTC"), adjust_hours), localized(ts, zone, adjust_hours))
    names = literal_map({f"{z}{m}": a for z, m, a in dim.ZONE_ABBREVIATIONS})
    return F.coalesce(F.try_element_at(names, F.concat(zone, offset.cast("string"))), F.lit(""))


def local_time(ts: Column, zone: Column, adjust_hours: float = 0.0) -> Column:
    return F.concat(F.date_format(localized(ts, zone, adjust_hours), "HH:mm"), F.lit(" "), zone_abbreviation(ts, zone, adjust_hours))


def minutes_between(earlier: Column, later: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(6e7)


# --- texts ---------------------------------------------------------------


def leading_zeros(text: Column) -> Column:
    """(dim, bright): sign and zeros before the first digit that counts; the last digit is always bright."""
    dim_part = F.regexp_extract(text, "^(-?0*)(?=.)", 1)
    return F.struct(dim_part.alias("dim"), F.substr(text, F.length(dim_part) + 1).alias("bright"))


def ass_time(sec: Column) -> Column:
    """h:mm:ss.cc, hundredths half-even; raises on negative seconds."""
    cs = F.bround(sec * 100, 0).cast("bigint")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.concat(F.floor(cs / 360000).cast("string"), F.lit(":"), two(F.floor(cs / 6000) % 60), F.lit(":"), two(F.floor(cs / 100) % 60), F.lit("."), two(cs % 100))
    return F.when(sec < 0, F.raise_error(F.lit("a time is negative")).cast("string")).otherwise(text)


def ass_colour(rgb: Column) -> Column:
    """rrggbb, with or without #, to &HBBGGRR; raises on another length."""
    bare = F.regexp_replace(rgb, "^#", "")
    pair = lambda i: F.substring(bare, i, 2)
    return F.when(F.length(bare) == 6, F.concat(F.lit("&H00"), F.upper(F.concat(pair(5), pair(3), pair(1))))).otherwise(F.raise_error(F.concat(F.lit("not a colour: "), rgb)).cast("string"))


def filter_path(path: Column) -> Column:
    return F.replace(F.replace(path, F.lit("\\"), F.lit("/")), F.lit(":"), F.lit("\\:"))


def route_label(route_id: Column, cardinal: Column, extras: Column) -> Column:
    """NULL unless route and direction are known."""
    ids = F.concat(F.array(route_id), F.coalesce(extras, F.array().cast("array<string>")))
    known = (F.coalesce(route_id, F.lit("")) != "") & (F.coalesce(cardinal, F.lit("")) != "")
    return F.when(known, F.concat(F.array_join(ids, " / "), F.lit(" "), cardinal, F.lit("B")))


def day_title(number: Column, first: Column, last: Column) -> Column:
    return F.concat(F.lit("Day "), number.cast("string"), F.lit(" - "), first, F.lit(" to "), last)


def highway_id(name: Column, kind: Column) -> Column:
    """``I-n`` or ``US n`` by the first number in a road's name; NULL without one."""
    number = F.nullif(F.regexp_extract(name, r"\d+", 0), F.lit(""))
    return F.concat(F.when(kind == "I", "I-").otherwise("US "), number)


def shield_number(route_id: Column) -> Column:
    return F.element_at(F.split(F.element_at(F.split(route_id, "-"), -1), " "), -1)


def overlay_xy(corner: str, margin: int) -> str:
    """Where an overlay goes; an unknown corner is the top right."""
    return dim.CORNERS.get(corner, dim.CORNERS["top_right"]).format(margin=margin)
