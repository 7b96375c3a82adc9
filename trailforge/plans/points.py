"""Observations of moving objects, derived from the ``events`` table, and the same as SQL.

The tables hold no places: an object is a user, and its places follow from the
event's number.  Objects and seconds that repeat count once, by the least event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import columns as C
from ..core import process
from ..functions import geodesy
from ..model import DataModel
from ..operators import features, fragments, segments

MODEL = DataModel(timestamp=C.TIMESTAMP)
_LAT = "48 + 128 * ((event_id * 7919) % 1500) / 1e6"
_LON = "2 + 128 * ((event_id * 104729) % 2500) / 1e6"
_STATE = "CASE WHEN event_id % 7 < 3 THEN 'STILL' WHEN event_id % 7 < 6 THEN 'MOVE' ELSE 'GAP' END"

POINTS_SQL = f"""
  SELECT id, {C.TIMESTAMP}, CAST({_LAT} AS DOUBLE) AS lat, CAST({_LON} AS DOUBLE) AS lon, value, event_id FROM (
    SELECT CAST(user_id AS VARCHAR) AS id, CAST(floor(epoch(ts)) AS BIGINT) AS {C.TIMESTAMP}, min(event_id) AS event_id, arg_min(value, event_id) AS value
    FROM events GROUP BY 1, 2)
"""

_PAIRS_SQL = f"(SELECT *, lag({C.TIMESTAMP}) OVER w AS pts, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM points WINDOW w AS (PARTITION BY id ORDER BY {C.TIMESTAMP}))"

FRAGMENTS_SQL = f"""
  SELECT id, event_id, value, id || '#' || pts || '_' || {C.TIMESTAMP} AS {C.FRAGMENT_ID}, {C.TIMESTAMP} - pts AS {C.DURATION}, pts AS {C.START}, {C.TIMESTAMP} AS {C.END},
    ({C.TIMESTAMP} + pts) // 2 AS {C.CENTER}, lat AS {C.END_LAT}, lon AS {C.END_LON}, round((lat + plat) / 2, 6) AS {C.CENTER_LAT}, round((lon + plon) / 2, 6) AS {C.CENTER_LON},
    plat, plon, {C.DISTANCE}, {C.BEARING}, {_STATE} AS {C.MOVING_STATE}
  FROM (SELECT * FROM {geodesy.sql(_PAIRS_SQL, "plat", "plon", "lat", "lon", C.DISTANCE, C.BEARING)} WHERE pts IS NOT NULL)
"""


def with_points(sql: str) -> str:
    return f"WITH points AS ({POINTS_SQL}) {sql}"


def with_fragments(sql: str, more: str = "") -> str:
    return f"WITH points AS ({POINTS_SQL}), fragments AS ({FRAGMENTS_SQL}){', ' + more if more else ''} {sql}"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")).alias(C.TIMESTAMP)
    once = events.groupBy(F.col("user_id").cast("string").alias("id"), seconds).agg(F.min("event_id").alias("event_id"), F.min_by("value", "event_id").alias("value"))
    return once.select("id", C.TIMESTAMP, F.expr(_LAT).cast("double").alias("lat"), F.expr(_LON).cast("double").alias("lon"), "value", "event_id")


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = process(points(spark, sf_dir), fragments.FlowFragments(MODEL))
    return made.withColumn(C.MOVING_STATE, F.expr(_STATE))


#: Runs of states, with the ids and durations of motions and courses.
RUNS_SQL = f"""
  begun AS (SELECT *, CASE WHEN lag({C.MOVING_STATE}) OVER w IS NULL OR {C.MOVING_STATE} <> lag({C.MOVING_STATE}) OVER w THEN id || '#' || {C.START} END AS b FROM fragments WINDOW w AS (PARTITION BY id ORDER BY {C.START})),
  motions AS (SELECT * EXCLUDE (b), last_value(b IGNORE NULLS) OVER (PARTITION BY id ORDER BY {C.START} ROWS UNBOUNDED PRECEDING) AS {C.MOTION_ID} FROM begun),
  lasting AS (SELECT *, max({C.END}) OVER w - min({C.START}) OVER w AS {C.MOTION_DURATION} FROM motions WINDOW w AS (PARTITION BY {C.MOTION_ID})),
  stops AS (SELECT *, CASE {C.MOVING_STATE} WHEN 'STILL' THEN CASE WHEN {C.MOTION_DURATION} < 40000 THEN 'COURSE' ELSE 'STOP' END WHEN 'GAP' THEN 'GAP' ELSE 'COURSE' END AS {C.COURSE_OR_STOP} FROM lasting),
  states AS (SELECT *, CASE WHEN {C.COURSE_OR_STOP} = 'COURSE' THEN CASE {C.MOVING_STATE} WHEN 'MOVE' THEN 'MOTION' WHEN 'STILL' THEN 'PAUSE' END END AS {C.COURSE_STATE},
    CASE WHEN lag({C.COURSE_OR_STOP}) OVER w IS NULL OR {C.COURSE_OR_STOP} <> lag({C.COURSE_OR_STOP}) OVER w THEN id || '#' || {C.START} END AS b FROM stops WINDOW w AS (PARTITION BY id ORDER BY {C.START})),
  courses AS (SELECT * EXCLUDE (b), last_value(b IGNORE NULLS) OVER (PARTITION BY id ORDER BY {C.START} ROWS UNBOUNDED PRECEDING) AS {C.COURSE_ID} FROM states),
  runs AS (SELECT *, max({C.END}) OVER w - min({C.START}) OVER w AS {C.COURSE_DURATION}, CASE WHEN {C.DURATION} > 28800 THEN 0.0e0 ELSE 1.0e0 END AS {C.VISIBILITY} FROM courses WINDOW w AS (PARTITION BY {C.COURSE_ID}))
"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process(
        flow(spark, sf_dir),
        segments.RunOnChange("id", C.MOVING_STATE, C.START, C.MOTION_ID),
        segments.DurationOfId(C.MOTION_ID, C.MOTION_DURATION),
        features.CourseOrStop(40000),
        features.CourseState(),
        segments.RunOnChange("id", C.COURSE_OR_STOP, C.START, C.COURSE_ID),
        segments.DurationOfId(C.COURSE_ID, C.COURSE_DURATION),
        features.VisibilityProportion(threshold=28800),
    )
