"""Settings with their defaults, read from an INI file."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    info_format: str = "{speed:.0f} mph   {dist:.0f} mi   {remain:.0f} mi to go   {time}"
    info_speed_source: str = "average"
    info_utc_offset_adjust: float = 0.0
    labels_format: str = "{name}, {state}"
    diagnostics_gap_warning_minutes: float = 10.0
    roads_match_tolerance_mi: float = 0.031
    roads_match_grace_secs: int = 3
    roads_freeze_below_mph: float = 3.0
    roads_concurrency_max_extra: int = 1
    local_roads_match_tolerance_mi: float = 0.02
    local_roads_match_grace_secs: int = 2
    compass_smoothing_secs: int = 5
    compass_freeze_below_mph: float = 3.0
    compass_hold_secs: int = 2
    day_title_display_secs: float = 2.0
    day_title_min_duration_secs: float = 2.0
    map_trip_city_radius_mi: float = 40.0
    map_trip_city_min_gap_mi: float = 80.0
    map_day_fade_secs: int = 2


def load(path: str) -> Settings:
    """Section and key give a field's name; what isn't there keeps its default. A missing file raises FileNotFoundError."""
    parser = configparser.ConfigParser(interpolation=None)
    with open(path, encoding="utf-8") as held:
        parser.read_file(held)
    given = {}
    for field in fields(Settings):
        for section in parser.sections():
            key = field.name.removeprefix(f"{section}_")
            if key != field.name and parser.has_option(section, key):
                read = {"int": parser.getint, "float": parser.getfloat, "str": parser.get}[str(field.type)]
                given[field.name] = read(section, key)
    return Settings(**given)
