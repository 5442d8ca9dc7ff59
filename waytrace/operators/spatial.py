"""Roads near points: a grid-partitioned range join, and what is chosen from its candidates.

Segments go to every cell that their box, widened by the reach, touches; a point looks into its own cell
only. So the many points are never multiplied, and the join is an equi-join on the cell,
which Spark broadcasts or shuffles by the size it sees and splits where a cell is hot.

Two projections matter: a road is acquired by distances at the mean latitude of the road file
(``file_mean``), and held by distances at the point's own latitude (``query_point``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from waytrace.functions import scalar
from waytrace.operators import memo

CELL_MI = 1.0
LIST_ROWS = 256  # places in a list, at most
BLOCK = 1 << 14  # pairs of leg and place measured at once, about
TIERS = {"interstate": 0, "us_route": 1}


def tier_of(route_type: Column) -> Column:
    return F.coalesce(F.try_element_at(scalar.literal_map(TIERS), route_type), F.lit(99))


def road_segments(roads: DataFrame) -> DataFrame:
    """(road_seq, seg_no, route_id, tier, alat, alon, blat, blon) of roads (road_seq, route_id, route_type, geometry)."""
    pairs = F.zip_with(F.slice("geometry", 1, F.greatest(F.lit(0), F.size("geometry") - 1)), F.slice("geometry", F.lit(2), F.size("geometry")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = roads.where(F.size("geometry") >= 2).select("road_seq", "route_id", tier_of(F.col("route_type")).alias("tier"), F.posexplode(pairs).alias("seg_no", "s"))
    return rows.select("road_seq", "seg_no", "route_id", "tier", F.col("s.a.lat").alias("alat"), F.col("s.a.lon").alias("alon"), F.col("s.b.lat").alias("blat"), F.col("s.b.lon").alias("blon"))


def file_scale(segments: DataFrame) -> DataFrame:
    """One row: mean latitude of the segments' starts, and miles per degree of longitude there."""
    mean = F.avg("alat")
    return segments.agg(mean.alias("mean_lat"), (F.lit(scalar.MILES_PER_DEGREE) * F.greatest(F.cos(F.radians(mean)), F.lit(scalar.LEAST_COSINE))).alias("kx"))


def road_cells(segments: DataFrame, scale: DataFrame, reach_mi: float = 0.0, cell: float = CELL_MI) -> DataFrame:
    """A row for each cell (cx, cy) that a segment's box, widened by ``reach_mi``, touches; with kx of the file."""
    ky = scalar.MILES_PER_DEGREE
    rows = segments.join(F.broadcast(scale))  # one row
    along = lambda a, b, k: F.sequence(F.floor((F.least(a, b) * k - reach_mi) / cell), F.floor((F.greatest(a, b) * k + reach_mi) / cell))
    rows = rows.withColumn("cx", F.explode(along(F.col("alon"), F.col("blon"), F.col("kx"))))
    return rows.withColumn("cy", F.explode(along(F.col("alat"), F.col("blat"), F.lit(ky))))


def candidates(points: DataFrame, roads: DataFrame, tolerance_mi: float, key: list[str], cell: float = CELL_MI) -> DataFrame:
    """(key, route_id, tier, acquire_mi, road_seq, nearest_mi, hold_mi) per point and route where a segment is within the tolerance in either projection.

    Tier, distance and file order are those of one segment, the route's best by them: a route that occurs with two
    types has the distance of its better type. ``nearest_mi`` is that of its nearest segment of any type. What is beyond the tolerance is NULL."""
    segments = road_segments(roads)
    scale = file_scale(segments)
    # at a point's own latitude a degree may be longer than the file's: room for both
    reach = 2 * tolerance_mi + 0.25 * cell
    grid = road_cells(segments, scale, reach, cell).drop("mean_lat")
    ky = F.lit(scalar.MILES_PER_DEGREE)
    placed = points.select(*key, "lat", "lon").join(F.broadcast(scale.select("kx")))
    placed = placed.select(*key, "lat", "lon", F.floor(F.col("lon") * F.col("kx") / cell).alias("cx"), F.floor(F.col("lat") * ky / cell).alias("cy"))
    near = placed.join(grid, ["cx", "cy"])
    zero = F.lit(0.0)

    def miles(k: Column) -> Column:
        return scalar.segment_miles(zero, zero, (F.col("alon") - F.col("lon")) * k, (F.col("alat") - F.col("lat")) * ky, (F.col("blon") - F.col("lon")) * k, (F.col("blat") - F.col("lat")) * ky)

    measured = near.withColumn("_a", miles(F.col("kx"))).withColumn("_h", miles(scalar.miles_per_degree_lon(F.col("lat"))))
    inside = measured.where((F.col("_a") <= tolerance_mi) | (F.col("_h") <= tolerance_mi))
    within = lambda c, value: F.min(F.when(F.col(c) <= tolerance_mi, value))
    best = F.struct("tier", F.col("_a").alias("acquire_mi"), "road_seq")
    found = inside.groupBy(*key, "route_id").agg(within("_a", best).alias("_best"), within("_a", F.col("_a")).alias("nearest_mi"), within("_h", F.col("_h")).alias("hold_mi"))
    return found.select(*key, "route_id", "_best.*", "nearest_mi", "hold_mi")


def _rank() -> Column:
    return F.struct("tier", "acquire_mi", "road_seq")


def nearest(found: DataFrame, key: list[str]) -> DataFrame:
    """(key, route_id, nearest_any_mi): the best road by (tier, distance, file order); the distance is that of the nearest road of any tier."""
    return found.where("acquire_mi IS NOT NULL").groupBy(*key).agg(F.min_by("route_id", _rank()).alias("route_id"), F.min("nearest_mi").alias("nearest_any_mi"))


def nearest_road(points: DataFrame, roads: DataFrame, tolerance_mi: float, key: list[str], cell: float = CELL_MI) -> DataFrame:
    """Every point with its road, NULL where none is within the tolerance."""
    return points.select(*key).join(nearest(candidates(points, roads, tolerance_mi, key, cell), key), key, "left")


def nearest_road_theta(points: DataFrame, roads: DataFrame, tolerance_mi: float, key: list[str]) -> DataFrame:
    """The same by comparing every point with every segment, in the file's projection. For tests."""
    segments = road_segments(roads)
    ky, kx, zero = F.lit(scalar.MILES_PER_DEGREE), F.col("kx"), F.lit(0.0)
    pairs = points.select(*key, "lat", "lon").crossJoin(segments.crossJoin(file_scale(segments)))
    miles = scalar.segment_miles(zero, zero, (F.col("alon") - F.col("lon")) * kx, (F.col("alat") - F.col("lat")) * ky, (F.col("blon") - F.col("lon")) * kx, (F.col("blat") - F.col("lat")) * ky)
    found = pairs.withColumn("acquire_mi", miles).withColumn("nearest_mi", miles).where(F.col("acquire_mi") <= tolerance_mi)
    return points.select(*key).join(nearest(found, key), key, "left")


def concurrent_roads(found: DataFrame, current: DataFrame, key: list[str], most: int = 1) -> DataFrame:
    """(key, extras): up to ``most`` other routes within the tolerance, best first; ``current`` (key, route_id) is left out."""
    chosen = current.select(*key, F.col("route_id").alias("_own"))
    others = found.where("acquire_mi IS NOT NULL").join(chosen, key).where(~F.col("route_id").eqNullSafe(F.col("_own")))
    order = Window.partitionBy(*key).orderBy("tier", "acquire_mi", "road_seq")
    ranked = others.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    lists = ranked.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "route_id"))), lambda s: s["route_id"]).alias("extras"))
    return current.select(*key).join(lists, key, "left").withColumn("extras", F.coalesce("extras", F.array().cast("array<string>")))


def nearest_places(points: DataFrame, places: DataFrame, cell_deg: float = 0.5, reach: int = 5) -> DataFrame:
    """``points`` (lat, lon, ...) with ``place`` (name, admin1, cc): the place (lat, lon, name, admin1, cc) nearest by arc, ties by name.

    A place goes to the cells around its own; a point asks its own cell for the nearest within one cell of it. Points that find
    none ask cells of twice the size, ``reach`` times in all; then NULL. The date line isn't crossed. Distinct coordinates are
    asked; each size reads what the one before wrote, and the last open point ends the search."""
    open_ = memo.staged(points.select("lat", "lon").where("lat IS NOT NULL AND lon IS NOT NULL").distinct(), "points")
    found = None
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    for step in range(reach):
        size = cell_deg * 2**step
        row, column = F.floor(F.col("lat") / size), F.floor(F.col("lon") / size)
        held = places.select(F.struct("name", "admin1", "cc").alias("place"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), row.alias("_r"), column.alias("_c"), F.explode(around).alias("_d"))
        held = held.select("place", "_lat", "_lon", (F.col("_r") + F.col("_d.i")).alias("_r"), (F.col("_c") + F.col("_d.j")).alias("_c"))
        asked = open_.select("lat", "lon", row.alias("_r"), column.alias("_c"))
        miles = scalar.haversine_miles(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
        # whatever lies outside the nine cells is farther than one cell in one direction
        sure = F.lit(size) * F.least(F.lit(scalar.MILES_PER_DEGREE), scalar.miles_per_degree_lon(F.least(F.lit(89.0), F.abs("lat") + size))) * 0.99
        near = asked.join(held, ["_r", "_c"], "left").withColumn("_mi", miles)
        ranked = F.when(F.col("_mi") <= sure, F.struct("_mi", "place.name"))
        best = memo.staged(near.groupBy("lat", "lon").agg(F.min_by("place", ranked).alias("place")), "places")
        held_here = best.where("place IS NOT NULL")
        found = held_here if found is None else found.unionByName(held_here)
        open_ = best.where("place IS NULL").select("lat", "lon")
        if open_.isEmpty():
            break
    return points.join(found, ["lat", "lon"], "left")


def distance_to_route(points: DataFrame, roads: DataFrame, key: list[str]) -> DataFrame:
    """(key, hold_mi): how far each point (key, lat, lon, route_id) is from its own route; infinite for an unknown route."""
    segments = road_segments(roads)
    k, ky, zero = scalar.miles_per_degree_lon(F.col("lat")), F.lit(scalar.MILES_PER_DEGREE), F.lit(0.0)
    miles = scalar.segment_miles(zero, zero, (F.col("alon") - F.col("lon")) * k, (F.col("alat") - F.col("lat")) * ky, (F.col("blon") - F.col("lon")) * k, (F.col("blat") - F.col("lat")) * ky)
    near = points.join(segments.drop("tier"), "route_id").groupBy(*key).agg(F.min(miles).alias("hold_mi"))
    return points.select(*key).join(near, key, "left").withColumn("hold_mi", F.coalesce("hold_mi", F.lit(float("inf"))))


def map_bounds(seconds: DataFrame) -> DataFrame:
    """Per trip: box of the route, padded by 8 % of its span (0.01 degrees at least), and mean latitude."""
    box = seconds.groupBy("trip_id").agg(F.min("lat").alias("lat0"), F.max("lat").alias("lat1"), F.min("lon").alias("lon0"), F.max("lon").alias("lon1"), F.avg("lat").alias("mean_lat"))
    pad = lambda a, b: F.greatest((F.col(b) - F.col(a)) * 0.08, F.lit(0.01))
    padded = box.withColumn("_lat", pad("lat0", "lat1")).withColumn("_lon", pad("lon0", "lon1"))
    return padded.select("trip_id", (F.col("lat0") - F.col("_lat")).alias("min_lat"), (F.col("lat1") + F.col("_lat")).alias("max_lat"), (F.col("lon0") - F.col("_lon")).alias("min_lon"), (F.col("lon1") + F.col("_lon")).alias("max_lon"), "mean_lat")


def cities_on_route(cities: DataFrame, route: DataFrame, radius_mi: float) -> DataFrame:
    """(trip_id, city columns) of the cities within the radius of a trip's route (trip_id, ord, lat, lon).

    Route points become segments; the join is by one-degree cells, widened by the radius."""
    w = Window.partitionBy("trip_id").orderBy("ord")
    legs = route.select("trip_id", "ord", F.col("lat").alias("alat"), F.col("lon").alias("alon"), F.lead("lat", 1).over(w).alias("blat"), F.lead("lon", 1).over(w).alias("blon"))
    single = legs.withColumn("blat", F.coalesce("blat", "alat")).withColumn("blon", F.coalesce("blon", "alon"))
    dlat = radius_mi / scalar.MILES_PER_DEGREE + 0.01
    dlon = radius_mi / (scalar.MILES_PER_DEGREE * scalar.LEAST_COSINE) + 0.01
    spread = lambda a, b, d: F.explode(F.sequence(F.floor(F.least(a, b) - d), F.floor(F.greatest(a, b) + d)))
    cells = single.withColumn("cy", spread(F.col("alat"), F.col("blat"), dlat)).withColumn("cx", spread(F.col("alon"), F.col("blon"), dlon))
    placed = cities.withColumn("cy", F.floor("lat")).withColumn("cx", F.floor("lon"))
    k, ky, zero = scalar.miles_per_degree_lon(F.col("lat")), F.lit(scalar.MILES_PER_DEGREE), F.lit(0.0)
    miles = scalar.segment_miles(zero, zero, (F.col("alon") - F.col("lon")) * k, (F.col("alat") - F.col("lat")) * ky, (F.col("blon") - F.col("lon")) * k, (F.col("blat") - F.col("lat")) * ky)
    near = cells.join(placed, ["cx", "cy"]).withColumn("_mi", miles).where(F.col("_mi") <= radius_mi)
    return near.groupBy("trip_id", *cities.columns).agg(F.min("_mi").alias("route_mi"))


def _route_cells(route: DataFrame, reach: float) -> DataFrame:
    """(trip_id, cy, cx, legs): the cells of ``reach`` degrees that may hold a place within ``reach`` of a leg of the trip; each leg
    (alat, alon, blat, blon) is in the list of one of them.

    Legs from one small square to another go together. A row of cells takes the stretch that is within its reach, so a
    long leg asks cells along itself, not those of its box."""
    w = Window.partitionBy("trip_id").orderBy("ord")
    legs = route.select("trip_id", F.col("lat").alias("alat"), F.col("lon").alias("alon"), F.lead("lat", 1).over(w).alias("blat"), F.lead("lon", 1).over(w).alias("blon"))
    single = legs.withColumn("blat", F.coalesce("blat", "alat")).withColumn("blon", F.coalesce("blon", "alon"))
    ends = ["alat", "alon", "blat", "blon"]
    for c in ends:
        single = single.where(F.abs(c) < float("inf"))
    side = reach / 2
    centre = lambda c: ((F.floor(F.col(c) / side) + 0.5) * side).alias(f"_{c}")
    groups = single.groupBy("trip_id", *[centre(c) for c in ends]).agg(F.collect_list(F.struct(*ends)).alias("legs"))
    # a leg is nowhere farther than half a side from the line of the centres; the rest is for rounding
    slack = side / 2 + 1e-6
    cell = lambda c: F.floor(c / reach)
    ya, yb, xa, xb = (F.col(c) for c in ("_alat", "_blat", "_alon", "_blon"))
    rows = groups.select("*", F.posexplode(F.sequence(cell(F.least(ya, yb) - slack - reach), cell(F.greatest(ya, yb) + slack + reach))).alias("_i", "cy"))
    low, high = F.col("cy") * reach, (F.col("cy") + 1) * reach
    at = lambda lat: F.when(ya == yb, F.lit(None).cast("double")).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (lat - ya) / (yb - ya))))
    rows = rows.withColumn("_s", F.coalesce(at(low - reach - slack), F.lit(0.0))).withColumn("_t", F.coalesce(at(high + reach + slack), F.lit(1.0)))
    # a degree of longitude is shortest on the side of the row that is nearer to a pole; at a pole the reach is all around
    narrow = F.cos(F.radians(F.least(F.lit(90.0), F.greatest(F.abs(low), F.abs(high)))))
    rows = rows.withColumn("_wide", F.least(F.lit(360.0), F.lit(reach) / narrow) + slack).withColumn("_p", xa + F.col("_s") * (xb - xa)).withColumn("_q", xa + F.col("_t") * (xb - xa))
    rows = rows.select("*", F.posexplode(F.sequence(cell(F.least("_p", "_q") - F.col("_wide")), cell(F.greatest("_p", "_q") + F.col("_wide")))).alias("_j", "cx"))
    once = F.when((F.col("_i") == 0) & (F.col("_j") == 0), F.col("legs"))
    return rows.groupBy("trip_id", "cy", "cx").agg(F.flatten(F.collect_list(once)).alias("legs"))


def selected_cities(cities: DataFrame, route: DataFrame, radius_mi: float, min_gap_mi: float) -> DataFrame:
    """``thinned_cities`` of ``cities_on_route``, without making all pairs of trip, leg and city.

    Of the cities at one place the first by rank stands for all: the others are no gap away from it, or are refused by
    what refused it. A trip meets its legs and the places of its cells in one fold, which measures places in their order until
    what was taken leaves none open. Rows to and from Python are lists of a cell's numbers, so their size is bounded."""
    mi = scalar.MILES_PER_DEGREE
    reach = radius_mi / mi + 1e-6
    placed = cities.where((F.abs("lat") < float("inf")) & (F.abs("lon") < float("inf")))
    first = placed.groupBy("lat", "lon").agg(F.min(F.struct("rank", "name", "state")).alias("c")).select("c.*", "lat", "lon")
    # (rank, tie) orders as (rank, name, state, lat, lon) does
    tie = F.row_number().over(Window.partitionBy("rank").orderBy("name", "state", "lat", "lon"))
    cells = first.select("lat", "lon", "rank", tie.alias("tie"), F.floor(F.col("lat") / reach).alias("cy"), F.floor(F.col("lon") / reach).alias("cx"))
    part = F.floor((F.row_number().over(Window.partitionBy("cy", "cx").orderBy("rank", "tie")) - 1) / LIST_ROWS)
    lists = cells.withColumn("part", part).groupBy("cy", "cx", "part").agg(F.collect_list(F.struct("lat", "lon", "rank", "tie")).alias("places"))
    met = _route_cells(route, reach).join(lists, ["cy", "cx"], "left").where((F.size("legs") > 0) | F.col("places").isNotNull())
    in_trip = Window.partitionBy("trip_id").orderBy("cy", "cx", "part")
    legs = F.when(F.coalesce("part", F.lit(0)) == 0, F.col("legs")).otherwise(F.slice("legs", 1, 0))
    rows = met.select("trip_id", F.row_number().over(in_trip).alias("n"), legs.alias("legs"), F.coalesce("places", F.array().cast(lists.schema["places"].dataType)).alias("places"))

    def taken(legs: list[np.ndarray], places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        alat, alon, blat, blon = legs
        lat, lon, rank, tie = places
        open_ = np.lexsort((tie, rank))
        k = mi * np.cos(np.radians(lat))
        kept = []
        while len(open_):
            head, open_ = np.split(open_, [max(1, BLOCK // len(alat))])
            y, x, kx = lat[head, None], lon[head, None], k[head, None]
            ax, ay = (alon - x) * kx, (alat - y) * mi
            dx, dy = (blon - x) * kx - ax, (blat - y) * mi - ay
            square = dx * dx + dy * dy
            t = np.clip(-(ax * dx + ay * dy) / np.where(square == 0, 1.0, square), 0.0, 1.0)
            px, py = ax + t * dx, ay + t * dy
            near = head[(np.sqrt(px * px + py * py) <= radius_mi).any(1)]
            while len(near):
                c = near[0]
                kept.append(c)
                clear = lambda of: of[np.hypot((lon[of] - lon[c]) * k[of], (lat[of] - lat[c]) * mi) >= min_gap_mi]  # noqa: B023, E731
                near, open_ = clear(near[1:]), clear(open_)
        return lat[kept], lon[kept]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trip, held, kind = None, None, None

        def closed(done: list) -> Iterator[pa.RecordBatch]:
            found = [(t, *taken(*([np.concatenate(c) for c in zip(*lists, strict=True)] for lists in of))) for t, of in done]
            found = [f for f in found if len(f[1])]
            if found:
                ids = pa.array([t for t, lat, _ in found for _ in lat], kind)
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(np.concatenate([f[i] for f in found])) for i in (1, 2)]], ["trip_id", "lat", "lon"])

        for batch in batches:
            kind = batch.schema.field("trip_id").type
            starts = np.flatnonzero(batch.column("n").to_numpy() == 1)
            columns = [batch.column(c) for c in ("legs", "places")]
            offsets = [c.offsets.to_numpy() for c in columns]
            values = [[c.values.field(i).to_numpy(zero_copy_only=False) for i in range(4)] for c in columns]
            part = lambda a, b: [[v[o[a] : o[b]] for v in of] for o, of in zip(offsets, values, strict=True)]  # noqa: B023, E731
            bounds = [0, *starts.tolist(), batch.num_rows]
            done = []
            for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                if i:
                    if held is not None:
                        done.append((trip, held))
                    trip, held = batch.column("trip_id")[a].as_py(), ([], [])
                if b > a:
                    for to, piece in zip(held, part(a, b), strict=True):
                        to.append([v.copy() for v in piece])
            yield from closed(done)
        if held is not None:
            yield from closed([(trip, held)])

    schema = StructType([rows.schema["trip_id"], StructField("lat", DoubleType()), StructField("lon", DoubleType())])
    shown = first if min_gap_mi > 0 else placed.distinct()  # without a gap none is refused
    return rows.mapInArrow(fold, schema).join(shown, ["lat", "lon"]).select("trip_id", "rank", "name", "state", "lat", "lon")


def thinned_cities(near: DataFrame, min_gap_mi: float) -> DataFrame:
    """Of a trip's cities, by rank, those that are ``min_gap_mi`` or more from each one taken before. One fold per trip
    over its candidate cities, which the city file bounds."""
    city = F.struct("rank", "name", "state", "lat", "lon")
    lists = near.groupBy("trip_id").agg(F.array_sort(F.collect_list(city)).alias("_all"))
    kind = "array<struct<rank:int,name:string,state:string,lat:double,lon:double>>"

    def clear(acc: Column, c: Column) -> Column:
        k = scalar.miles_per_degree_lon(c["lat"])
        close = F.exists(acc, lambda o: F.hypot((c["lon"] - o["lon"]) * k, (c["lat"] - o["lat"]) * scalar.MILES_PER_DEGREE) < min_gap_mi)
        return F.when(close, acc).otherwise(F.array_append(acc, c))

    return lists.select("trip_id", F.explode(F.aggregate("_all", F.array().cast(kind), clear)).alias("c")).select("trip_id", "c.*")
