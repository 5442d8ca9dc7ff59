"""Track operators over a stream of fixes. Late fixes are dropped by the watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from waytrace.functions import scalar


def sessions(fixes: DataFrame, gap: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Drives of a trip: valid fixes (trip_id, event_time, speed_mph) less than ``gap`` apart."""
    rows = fixes.where("valid").withWatermark("event_time", late)
    grouped = rows.groupBy("trip_id", F.session_window("event_time", gap).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n_fixes"), F.max("speed_mph").alias("top_mph")).select("trip_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_fixes", "top_mph")


def speed_windows(fixes: DataFrame, width: str = "5 minutes", late: str = "30 minutes") -> DataFrame:
    rows = fixes.where("valid").withWatermark("event_time", late)
    return rows.groupBy("trip_id", F.window("event_time", width).alias("w")).agg(F.avg("speed_mph").alias("mean_mph"), F.count(F.lit(1)).alias("n_fixes")).select("trip_id", F.col("w.start").alias("start"), "mean_mph", "n_fixes")


def debounced_octants(fixes: DataFrame, hold: int = 2) -> DataFrame:
    """(trip_id, event_time, octant): the debounced octant with its state kept per trip between batches."""
    rows = fixes.select("trip_id", "event_time", scalar.compass8(F.col("heading")).alias("now"))

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        shown, streak = state.get if state.exists else (None, 0)
        batch = pd.concat(list(parts)).sort_values("event_time")
        out = []
        for now in batch["now"]:
            streak = 0 if shown is None or now == shown else streak + 1
            if shown is None or streak > hold:
                shown, streak = now, 0
            out.append(shown)
        state.update((shown, streak))
        yield pd.DataFrame({"trip_id": key[0], "event_time": batch["event_time"], "octant": out})

    return rows.groupBy("trip_id").applyInPandasWithState(fold, "trip_id long, event_time timestamp, octant string", "shown string, streak int", "append", GroupStateTimeout.NoTimeout)
