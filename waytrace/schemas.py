"""Explicit schemas of the tables that the operators read and write."""

TRACK_CSV = "clip string, sec_in_clip int, global_sec double, timestamp_utc string, valid int, lat double, lon double, speed_mph double, heading double, town string, state string"
TRACK_COLUMNS = ["clip", "sec_in_clip", "global_sec", "timestamp_utc", "valid", "lat", "lon", "speed_mph", "heading", "town", "state"]
LABELS_CSV = "start_sec double, end_sec double, label string"
GAPS_CSV = "start_sec double, end_sec double, clip string"
CITIES_CSV = "rank int, name string, state string, lat double, lon double"
FIX = "clip string, sec_in_clip int, timestamp_utc string, valid boolean, lat double, lon double, speed_mph double, heading double"
GEOMETRY = "array<struct<lat:double,lon:double>>"
ROADS = f"route_id string, route_type string, geometry {GEOMETRY}"
GEOJSON = "type string, features array<struct<type:string,properties:struct<route_id:string,route_type:string>,geometry:struct<type:string,coordinates:string>>>"
