"""The registered queries of the moving-object operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import columns as C
from ..core import process
from ..functions import geodesy, wkt
from ..model import DataModel, HmmModel, period
from ..operators import features, fragments, hmm, missions, outliers, segments
from ..sources import io
from ..streaming import runs as stream_runs
from .points import MODEL, RUNS_SQL, flow, points, runs, with_fragments, with_points

FLAGSHIP = "flow_fragments"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(make):
        QUERIES[make.__name__] = make
        if sql is not None:
            ORACLES[make.__name__] = sql
        return make

    return register


_PTS = ("id", C.TIMESTAMP)
_FRG = ("id", C.START)
T, D = C.TIMESTAMP, C.DURATION


@_query(with_fragments(f"""SELECT id, {C.FRAGMENT_ID}, 2 AS {C.NB_POINTS}, {D}, {C.START}, {C.END}, {C.CENTER}, CAST(strftime(to_timestamp({C.CENTER}) AT TIME ZONE 'UTC', '%Y%m%d') AS INTEGER) AS {C.PARTITION},
  {C.END_LAT}, {C.END_LON}, {C.CENTER_LAT}, {C.CENTER_LON}, round({C.DISTANCE}, 3) AS {C.DISTANCE}, round({C.BEARING}, 5) AS {C.BEARING}, round({C.DISTANCE} / {D}, 6) AS {C.SPEED} FROM fragments"""))  # fmt: skip
def flow_fragments(spark, d):
    out = flow(spark, d)
    exact = ["id", C.FRAGMENT_ID, C.NB_POINTS, D, C.START, C.END, C.CENTER, C.PARTITION, C.END_LAT, C.END_LON, C.CENTER_LAT, C.CENTER_LON]
    return out.select(*exact, F.round(C.DISTANCE, 3).alias(C.DISTANCE), F.round(C.BEARING, 5).alias(C.BEARING), F.round(C.SPEED, 6).alias(C.SPEED))


@_query(with_fragments(f"""SELECT {C.FRAGMENT_ID}, CASE WHEN plat = {C.END_LAT} AND plon = {C.END_LON} THEN 'POINT (' || e || ')' ELSE 'LINESTRING (' || s || ', ' || e || ')' END AS {C.TRAIL} FROM (
  SELECT *, {wkt.number_sql("plon").replace("STRING", "VARCHAR")} || ' ' || {wkt.number_sql("plat").replace("STRING", "VARCHAR")} AS s, {wkt.number_sql(C.END_LON).replace("STRING", "VARCHAR")} || ' ' || {wkt.number_sql(C.END_LAT).replace("STRING", "VARCHAR")} AS e FROM fragments)"""))  # fmt: skip
def fragment_trails(spark, d):
    return flow(spark, d).select(C.FRAGMENT_ID, C.TRAIL)


@_query(with_points(f"SELECT id || '#' || p || '_' || {T} AS {C.FRAGMENT_ID}, (value + v) / 2 AS frag_value, round(abs(lat - plat) / 2, 9) AS {C.CENTER_LAT_STD} FROM (SELECT *, lag({T}) OVER w AS p, lag(value) OVER w AS v, lag(lat) OVER w AS plat FROM points WINDOW w AS (PARTITION BY id ORDER BY {T})) WHERE p IS NOT NULL"))
def fragment_means_and_precision(spark, d):
    out = process(points(spark, d), fragments.FlowFragments(MODEL, averaged=("value",), precision=True))
    return out.select(C.FRAGMENT_ID, "frag_value", F.round(C.CENTER_LAT_STD, 9).alias(C.CENTER_LAT_STD))


@_query(with_points(f"SELECT id, {T}, {T} - lag({T}) OVER (PARTITION BY id ORDER BY {T}) AS {D} FROM points"))
def duration_since_previous(spark, d):
    return process(points(spark, d), segments.DurationSincePrevious()).select(*_PTS, D)


@_query(with_fragments(f"SELECT points.id, points.{T}, round({C.DISTANCE}, 3) AS {C.DISTANCE} FROM points LEFT JOIN fragments f ON f.id = points.id AND f.{C.END} = points.{T}"))
def geodesic_distance(spark, d):
    return process(points(spark, d), segments.GeodesicDistance(MODEL)).select(*_PTS, F.round(C.DISTANCE, 3).alias(C.DISTANCE))


@_query(with_fragments(f"SELECT id, {C.START}, CASE WHEN {D} > 43200 THEN 'GAP' ELSE 'not_a_gap' END AS {C.GAP_STATE} FROM fragments"))
def gap_state(spark, d):
    return process(flow(spark, d), features.GapState()).select(*_FRG, C.GAP_STATE)


_VISIBLE = f"CASE WHEN {D} > 28800 THEN 0.0e0 ELSE 1.0e0 END"


@_query(with_fragments(f"SELECT id, {C.START}, {_VISIBLE} AS {C.VISIBILITY} FROM fragments"))
def visibility_proportion(spark, d):
    return process(flow(spark, d), features.VisibilityProportion(threshold=28800)).select(*_FRG, C.VISIBILITY)


def _change(flag: str, source: str, order: str) -> str:
    return f"""SELECT *, CASE WHEN h THEN NULL WHEN p AND n THEN 'appear_disappear' WHEN p THEN 'appear' WHEN n THEN 'disappear' END AS {C.VISIBILITY_CHANGE}
      FROM (SELECT *, lag(h, 1, false) OVER w AS p, lead(h, 1, false) OVER w AS n FROM (SELECT *, {flag} AS h FROM {source}) WINDOW w AS (PARTITION BY id ORDER BY {order}))"""


@_query(with_fragments(f"SELECT id, {C.START}, {C.VISIBILITY_CHANGE} FROM ({_change(f'{D} > 28800', 'fragments', C.CENTER)})"))
def visibility_change(spark, d):
    return process(flow(spark, d), features.VisibilityProportion(threshold=28800), segments.VisibilityChange()).select(*_FRG, C.VISIBILITY_CHANGE)


_TEMPO = f"CASE WHEN {D} < 10000 THEN 'tempo_short' WHEN {D} < 40000 THEN 'tempo_long' ELSE 'tempo_irregular' END"


@_query(with_fragments(f"SELECT id, {C.START}, CASE WHEN h THEN 0.0e0 ELSE 1.0e0 END AS {C.VISIBILITY}, {C.VISIBILITY_CHANGE} FROM ({_change(f'{D} >= 40000', 'fragments', C.CENTER)})"))
def visibility_from_tempo(spark, d):
    return process(flow(spark, d).withColumn(C.TEMPO, F.expr(_TEMPO)), segments.VisibilityFromTempo()).select(*_FRG, C.VISIBILITY, C.VISIBILITY_CHANGE)


@_query(with_fragments(f"SELECT id, {C.START}, round({C.DISTANCE} / {D}, 6) AS ms, round({C.DISTANCE} / {D} * 3.6, 6) AS kmh, round({C.DISTANCE} / {D} * 1.9438444924406, 6) AS nd FROM fragments"))
def speed_units(spark, d):
    steps = [features.Speed(t, u) for t, u in (("ms", "m/s"), ("kmh", "km/h"), ("nd", "nd"))]
    return process(flow(spark, d), *steps).select(*_FRG, *(F.round(c, 6).alias(c) for c in ("ms", "kmh", "nd")))


@_query(with_fragments(f"SELECT id, {C.START}, round(CASE WHEN sensor IS NULL OR {D} > 20000 THEN {C.DISTANCE} / {D} ELSE sensor END, 6) AS speed FROM (SELECT *, CASE WHEN event_id % 3 > 0 THEN value END AS sensor FROM fragments)"))
def gps_or_sensor_speed(spark, d):
    seen = flow(spark, d).withColumn("sensor", F.expr("CASE WHEN event_id % 3 > 0 THEN value END"))
    return process(seen, features.GpsOrSensorSpeed("speed", C.SPEED, "sensor", threshold=20000)).select(*_FRG, F.round("speed", 6).alias("speed"))


def _from_runs(columns: str) -> str:
    return with_fragments(f"SELECT id, {C.START}, {columns} FROM runs", RUNS_SQL)


@_query(_from_runs(C.COURSE_OR_STOP))
def course_or_stop(spark, d):
    return runs(spark, d).select(*_FRG, C.COURSE_OR_STOP)


@_query(_from_runs(C.COURSE_STATE))
def course_state(spark, d):
    return runs(spark, d).select(*_FRG, C.COURSE_STATE)


@_query(_from_runs(f"{C.MOTION_ID}, {C.COURSE_ID}"))
def state_id_on_change(spark, d):
    return runs(spark, d).select(*_FRG, C.MOTION_ID, C.COURSE_ID)


@_query(_from_runs(f"{C.MOTION_DURATION}, {C.COURSE_DURATION}"))
def duration_from_id(spark, d):
    return runs(spark, d).select(*_FRG, C.MOTION_DURATION, C.COURSE_DURATION)


@_query(with_fragments(f"SELECT id, {C.START}, last_value(CASE WHEN {C.MOVING_STATE} = 'GAP' THEN id || '#' || {C.START} END IGNORE NULLS) OVER (PARTITION BY id ORDER BY {C.START} ROWS UNBOUNDED PRECEDING) AS run FROM fragments"))
def state_id_from_state(spark, d):
    return process(flow(spark, d), segments.RunFromState("id", C.MOVING_STATE, C.START, C.GAP, "run")).select(*_FRG, "run")


@_query(with_fragments(f"""SELECT id, {C.START}, last_value(b IGNORE NULLS) OVER (PARTITION BY id ORDER BY {C.START} ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, CASE WHEN l IS NULL OR {C.MOVING_STATE} <> l OR {C.MOVING_STATE} = 'STILL' THEN id || '#' || {C.START} END AS b FROM (SELECT *, lag({C.MOVING_STATE}) OVER (PARTITION BY id ORDER BY {C.START}) AS l FROM fragments))"""))  # fmt: skip
def state_id_unique(spark, d):
    return process(flow(spark, d), segments.RunOnChange("id", C.MOVING_STATE, C.START, "run", C.STILL)).select(*_FRG, "run")


@_query(with_fragments(f"SELECT id, {C.START}, id || '#' || min({C.START}) OVER w || '_' || max({C.END}) OVER w AS {C.MOTION_ID} FROM runs WINDOW w AS (PARTITION BY {C.MOTION_ID})", RUNS_SQL))
def id_updater(spark, d):
    return process(runs(spark, d), segments.RenewedId(MODEL, C.MOTION_ID)).select(*_FRG, C.MOTION_ID)


@_query(with_fragments(f"""SELECT {C.MOTION_ID}, {C.START}, {C.MOTION_ID} || '_' || CAST(floor((sum({D}) OVER (PARTITION BY {C.MOTION_ID} ORDER BY {C.CENTER} ROWS UNBOUNDED PRECEDING) - 1) / 50000) - floor(({D} - 1) / 50000) AS BIGINT) AS {C.SAMPLE_ID} FROM runs""", RUNS_SQL))
def fragment_sample_id(spark, d):
    return process(runs(spark, d), segments.SampleId(C.MOTION_ID, 50000)).select(C.MOTION_ID, C.START, C.SAMPLE_ID)


@_query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_type IN ('view', 'click') THEN NULL ELSE event_type END AS kind FROM events),
  first AS (SELECT user_id, arg_min(kind, event_id) AS kind FROM e WHERE kind IS NOT NULL GROUP BY 1)
  SELECT e.event_id, coalesce(first.kind, 'none') AS kind FROM e LEFT JOIN first USING (user_id)""")
def static_fill(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", F.col("event_type").alias("kind"))
    return process(events, segments.StaticValues("user_id", {"kind": ("none", ["view", "click"])}, "event_id")).select("event_id", "kind")


@_query("SELECT s_suppkey, coalesce(n_name, CAST(k AS VARCHAR)) AS nation FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN 999 ELSE s_nationkey END AS k FROM supplier) LEFT JOIN nation ON n_nationkey = k")
def country_lookup(spark, d):
    nations = io.read_parquet(spark, f"{d}/nation.parquet")
    rows = io.read_parquet(spark, f"{d}/supplier.parquet").withColumn("k", F.when(F.col("s_suppkey") % 9 == 0, 999).otherwise(F.col("s_nationkey")))
    return process(rows, features.CountryNames("k", "nation", nations, "n_nationkey", "n_name")).select("s_suppkey", "nation")


@_query(with_fragments(f"SELECT id, {C.START}, CASE WHEN {D} < 10000 THEN 1.0e0 ELSE 0.0e0 END AS short, CASE WHEN {D} >= 10000 AND {D} < 40000 THEN 1.0e0 ELSE 0.0e0 END AS long, false AS {C.TEMPO_MULTI} FROM fragments"))
def tempo_proportions(spark, d):
    seen = flow(spark, d).withColumn(C.TEMPO, F.expr(_TEMPO))
    return process(seen, features.TempoProportions({"short": "tempo_short", "long": "tempo_long"})).select(*_FRG, "short", "long", C.TEMPO_MULTI)


@_query(with_fragments(f"SELECT id, {C.START}, len(v) AS n, list_sum(v) AS total FROM (SELECT *, CASE WHEN {D} > 36000 THEN [value, value, value] ELSE [value] END AS v FROM (SELECT * REPLACE (coalesce(value, 0.0e0) AS value) FROM fragments))"))
def support_values(spark, d):
    out = process(flow(spark, d), features.SupportValues("value", "v", 12000, 3))
    return out.select(*_FRG, F.size("v").cast("bigint").alias("n"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"))


@_query(with_points(f"SELECT id, {T} FROM points WHERE lat BETWEEN 48.05 AND 48.15 AND lon BETWEEN 2.1 AND 2.2"))
def out_of_range_filter(spark, d):
    return process(points(spark, d), features.WithinRange("lat", "lon", 48.05, 2.1, 48.15, 2.2)).select(*_PTS)


_LOCAL = f"""SELECT *, coalesce(value - f[CASE WHEN len(f) = 7 THEN 4 ELSE 2 END] > 20, false) AS outlier FROM (SELECT *, list_sort(list(value) FILTER (value IS NOT NULL) OVER (PARTITION BY id ORDER BY {T} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) AS f FROM points)"""


def _flagged(spark, d):
    return process(points(spark, d), outliers.LocalOutliers("id", "outlier", ["value"], 3, 20.0))


@_query(with_points(f"SELECT id, {T}, outlier FROM ({_LOCAL})"))
def local_outliers(spark, d):
    return _flagged(spark, d).select(*_PTS, "outlier")


@_query(with_points(f"""SELECT id, {T}, (a AND NOT r) OR lead(r, 1, false) OVER w AS outlier FROM (
  SELECT *, a AND NOT lead(a, 1, true) OVER w AS r FROM (
    SELECT *, outlier OR ((lead(outlier, 1, true) OVER w OR lead(outlier, 2, true) OVER w OR lead(outlier, 3, true) OVER w) AND (lag(outlier, 1, true) OVER w OR lag(outlier, 2, true) OVER w OR lag(outlier, 3, true) OVER w)) AS a
    FROM ({_LOCAL}) WINDOW w AS (PARTITION BY id ORDER BY {T})) WINDOW w AS (PARTITION BY id ORDER BY {T})) WINDOW w AS (PARTITION BY id ORDER BY {T})"""))  # fmt: skip
def outlier_propagation(spark, d):
    return process(_flagged(spark, d), outliers.PropagatedOutliers("id", "outlier")).select(*_PTS, "outlier")


@_query(with_points(f"""SELECT id, {T}, 'LINESTRING (' || p || ', ' || c || ', ' || n || ')' AS line, CASE WHEN p IS NOT NULL THEN 'POINT (' || c || ')' END AS point FROM (
  SELECT *, lag(c) OVER w AS p, lead(c) OVER w AS n FROM (SELECT *, lon || ' ' || lat AS c FROM ({_LOCAL})) WINDOW w AS (PARTITION BY id ORDER BY {T})) WHERE outlier"""))  # fmt: skip
def outliers_to_store(spark, d):
    return process(_flagged(spark, d), outliers.OutlierGeometry(MODEL, "outlier", "line", "point")).select(*_PTS, "line", "point")


@_query(with_points(f"SELECT id, {T}, value FROM ({_LOCAL}) WHERE NOT outlier"))
def drop_outliers(spark, d):
    return process(_flagged(spark, d), outliers.WithoutOutliers("outlier")).select(*_PTS, "value")


@_query(with_points(f"""SELECT id, min({T}) AS {C.START}, max({T}) AS {C.END}, count(*) AS n FROM (
  SELECT *, sum(b) OVER (PARTITION BY id ORDER BY {T} ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT *, CASE WHEN {T} - lag({T}) OVER (PARTITION BY id ORDER BY {T}) <= 43200 THEN 0 ELSE 1 END AS b FROM points)) GROUP BY id, run"""))  # fmt: skip
def stream_gap_runs(spark, d):
    return stream_runs.gap_runs(points(spark, d))


_RAW = DataModel("oid", "at", "y", "x", "yyyy-MM-dd HH:mm:ssXXX")


def _raw(spark, d):
    p = points(spark, d)
    text = F.concat(F.from_unixtime(T, "yyyy-MM-dd HH:mm:ss"), F.when(F.col("event_id") % 5 == 0, "").otherwise("+01:00"))
    return p.select(F.col("id").alias("oid"), text.alias("at"), F.regexp_replace(F.col("lat").cast("string"), "[.]", ",").alias("y"), F.col("lon").cast("string").alias("x"), F.lit("n/a").alias("depth"))


@_query(with_points(f"""SELECT id AS oid, CASE WHEN event_id % 5 = 0 THEN NULL ELSE {T} - 3600 END AS {T}, lat AS y, lon AS x, CAST(NULL AS DOUBLE) AS depth,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(strftime(to_timestamp({T} - 3600) AT TIME ZONE 'UTC', '%Y%m%d') AS INTEGER) END AS {C.PARTITION} FROM points"""))  # fmt: skip
def format_points(spark, d):
    return features.formatted(_raw(spark, d), _RAW, ("depth",)).select("oid", T, "y", "x", "depth", C.PARTITION)


@_query(with_points(f"SELECT id, {T}, CAST(strftime(to_timestamp({T}) AT TIME ZONE 'UTC', '%Y%m%d') AS INTEGER) AS {C.PARTITION} FROM points"))
def time_partition(spark, d):
    return process(points(spark, d), features.TimePartition()).select(*_PTS, C.PARTITION)


@_query(with_points(f"SELECT id, {T} FROM points WHERE {T} BETWEEN epoch(TIMESTAMP '2024-01-05 12:00:00') AND epoch(TIMESTAMP '2024-01-20 06:00:00')"))
def period_filter(spark, d):
    days = process(points(spark, d), features.TimePartition())
    return io.within(days, period("2024-01-05T12:00:00+00:00", "2024-01-20T07:00:00+01:00")).select(*_PTS)


@_query(with_points(f"SELECT id, {T}, lat AS py, lon AS px, value AS v FROM points"))
def nested_columns(spark, d):
    out = features.nested(points(spark, d), {"at": {"place": {"y": "lat", "x": "lon"}, "value": F.col("value")}})
    return out.select(*_PTS, F.col("at.place.y").alias("py"), F.col("at.place.x").alias("px"), F.col("at.value").alias("v"))


@_query(with_points(f"SELECT id, {T}, '[' || id || ',' || event_id || ']' AS pair FROM points"))
def csv_array_text(spark, d):
    rows = points(spark, d).withColumn("pair", F.array("id", F.col("event_id").cast("string")))
    return io.with_array_texts(rows).select(*_PTS, "pair")


@_query(with_points(f"SELECT id || '#' || {T} AS doc_key, lat || ',' || lon AS location FROM points"))
def document_ids(spark, d):
    return io.with_document_id(points(spark, d), MODEL).select("doc_key", "location")


def _summary_sql(key: str, condition: str, more: str, source: str = "runs") -> str:
    return f"""SELECT {key}, any_value(id) AS id, CAST(count(*) + 1 AS INTEGER) AS {C.NB_POINTS}, min({C.START}) AS {C.START}, max({C.END}) AS {C.END}, CAST(sum({D}) AS BIGINT) AS {D},
      round(sum({C.DISTANCE}), 3) AS {C.DISTANCE}, arg_max({C.END_LAT}, {C.START}) AS {C.END_LAT}, (min({C.START}) + max({C.END})) // 2 AS {C.CENTER}, round(sum({C.DISTANCE}) / sum({D}), 6) AS {C.SPEED}{more}
      FROM {source} WHERE {condition} GROUP BY {key}"""


_SUMMARY = ("id", C.NB_POINTS, C.START, C.END, D, C.END_LAT, C.CENTER)


def _rounded(df: DataFrame, key: str, *more) -> DataFrame:
    return df.select(key, *_SUMMARY, F.round(C.DISTANCE, 3).alias(C.DISTANCE), F.round(C.SPEED, 6).alias(C.SPEED), *more)


@_query(with_fragments(_summary_sql(C.MOTION_ID, f"{C.MOVING_STATE} = 'STILL'", f", any_value({C.COURSE_OR_STOP}) AS {C.COURSE_OR_STOP}, round(sum({C.VISIBILITY} * {D}) / sum({D}), 6) AS {C.VISIBILITY}"), RUNS_SQL))
def stop_pause_summary(spark, d):
    out = process(runs(spark, d), fragments.StopPauseSummary(MODEL, weighted=(C.VISIBILITY,))).where(F.col(C.MOVING_STATE) == C.STILL)
    return _rounded(out, C.MOTION_ID, C.COURSE_OR_STOP, F.round(C.VISIBILITY, 6).alias(C.VISIBILITY))


def _samples(spark, d):
    return process(runs(spark, d), segments.VisibilityChange(timestamp=C.CENTER), segments.SampleId(C.MOTION_ID, 50000))


_SAMPLES_SQL = RUNS_SQL + f""", changes AS ({_change(f'{C.VISIBILITY} = 0', 'runs', C.CENTER)}),
  samples AS (SELECT *, {C.MOTION_ID} || '_' || CAST(floor((sum({D}) OVER (PARTITION BY {C.MOTION_ID} ORDER BY {C.CENTER} ROWS UNBOUNDED PRECEDING) - 1) / 50000) - floor(({D} - 1) / 50000) AS BIGINT) AS {C.SAMPLE_ID} FROM changes),
  moved AS ({_summary_sql(C.SAMPLE_ID, f"{C.MOVING_STATE} = 'MOVE'", f", round(avg({C.VISIBILITY}), 6) AS {C.VISIBILITY}, coalesce(first({C.VISIBILITY_CHANGE} ORDER BY {C.START}), '') AS a, coalesce(last({C.VISIBILITY_CHANGE} ORDER BY {C.START}), '') AS b", 'samples')})"""


@_query(with_fragments(f"""SELECT * EXCLUDE (a, b), CASE WHEN a LIKE 'appear%' AND b LIKE '%disappear' THEN 'appear_disappear' WHEN a LIKE 'appear%' THEN 'appear' WHEN b LIKE '%disappear' THEN 'disappear' END AS {C.VISIBILITY_CHANGE} FROM moved""", _SAMPLES_SQL))
def moving_sample_summary(spark, d):
    out = process(_samples(spark, d), fragments.MovingSampleSummary(MODEL)).where(F.col(C.MOVING_STATE) == C.MOVE)
    return _rounded(out, C.SAMPLE_ID, F.round(C.VISIBILITY, 6).alias(C.VISIBILITY), C.VISIBILITY_CHANGE)


def _motion(ok: str, column: str) -> str:
    return f"coalesce(sum({column}) FILTER ({C.COURSE_STATE} = 'MOTION' AND {ok}), 0)"


_COURSES_SQL = RUNS_SQL + f""", summed AS ({_summary_sql(C.COURSE_ID, f"{C.COURSE_OR_STOP} <> 'STOP'", f''', any_value({C.COURSE_OR_STOP}) AS {C.COURSE_OR_STOP}, any_value({C.COURSE_DURATION}) AS cd,
    CAST({_motion(f"{C.VISIBILITY} >= 0.8", D)} AS BIGINT) AS motions_visible_duration_s, CAST({_motion(f"{C.VISIBILITY} < 0.8", D)} AS BIGINT) AS motions_invisible_duration_s,
    round({_motion(f"{C.VISIBILITY} >= 0.8", C.DISTANCE)}, 3) AS motions_visible_length_m, CAST(coalesce(sum({D}) FILTER ({C.COURSE_STATE} = 'PAUSE'), 0) AS BIGINT) AS pauses_duration_s,
    CAST(count(*) FILTER ({C.COURSE_STATE} = 'PAUSE') AS INTEGER) AS pauses_short_number,
    round(sum({C.VISIBILITY} * {D}) FILTER ({C.COURSE_STATE} = 'PAUSE') / sum({D}) FILTER ({C.COURSE_STATE} = 'PAUSE'), 6) AS pauses_visibility_proportion''')}),
  adjacent AS (SELECT id, {C.COURSE_ID}, {C.START}, {C.END}, {C.COURSE_OR_STOP}, {D} FROM summed UNION ALL SELECT id, {C.COURSE_ID}, {C.START}, {C.END}, {C.COURSE_OR_STOP}, {D} FROM runs WHERE {C.COURSE_OR_STOP} = 'STOP'),
  beside AS (SELECT {C.COURSE_ID}, {C.COURSE_OR_STOP} AS kind, {C.START} AS s, CASE WHEN {C.COURSE_OR_STOP} = 'COURSE' AND lag({C.COURSE_OR_STOP}) OVER w = 'STOP' THEN lag({D}) OVER w END AS stop_before_duration_s,
    CASE WHEN {C.COURSE_OR_STOP} = 'COURSE' AND lead({C.COURSE_OR_STOP}) OVER w = 'STOP' THEN lead({D}) OVER w END AS stop_after_duration_s FROM adjacent WINDOW w AS (PARTITION BY id ORDER BY {C.START}, {C.END}))"""


@_query(with_fragments(f"SELECT summed.* EXCLUDE (cd), round(pauses_duration_s / cd, 6) AS pauses_proportion, stop_before_duration_s, stop_after_duration_s FROM summed JOIN beside ON summed.{C.COURSE_ID} = beside.{C.COURSE_ID} AND beside.kind <> 'STOP'", _COURSES_SQL))
def course_extract(spark, d):
    out = process(runs(spark, d), fragments.CourseExtraction(MODEL))
    exact = [C.COURSE_OR_STOP, "motions_visible_duration_s", "motions_invisible_duration_s", "pauses_duration_s", "pauses_short_number", "stop_before_duration_s", "stop_after_duration_s"]
    return _rounded(out, C.COURSE_ID, *exact, F.round("motions_visible_length_m", 3).alias("motions_visible_length_m"), F.round("pauses_visibility_proportion", 6).alias("pauses_visibility_proportion"), F.round("pauses_proportion", 6).alias("pauses_proportion"))


@_query()
def course_trails(spark, d):
    out = process(runs(spark, d), fragments.CourseExtraction(MODEL))
    return out.select(C.COURSE_ID, C.TRAIL, "pauses_trail", "pauses_location", "motions_visible_trail", "motions_invisible_trail", "departure_lat", "departure_lon", "arrival_lat", "arrival_lon")


@_query()
def stop_pause_trails(spark, d):
    out = process(runs(spark, d), fragments.StopPauseSummary(MODEL, precision=True)).where(F.col(C.MOVING_STATE) == C.STILL)
    return out.select(C.MOTION_ID, C.TRAIL, C.PRECISION_TRAIL)


# The fold over courses as recursion: each course's distance from every earlier departure is looked up.
_MISSIONS_SQL = _COURSES_SQL + f""",
  placed AS (SELECT {C.COURSE_ID}, id, {C.START} AS s, {C.END} AS e, cd, full_m AS gps, row_number() OVER (PARTITION BY id ORDER BY {C.START}, {C.END}) AS j FROM (SELECT summed.*, exact.g AS full_m FROM summed JOIN (SELECT {C.COURSE_ID}, sum({C.DISTANCE}) AS g FROM runs WHERE {C.COURSE_OR_STOP} <> 'STOP' GROUP BY 1) exact USING ({C.COURSE_ID}))),
  ends AS (SELECT {C.COURSE_ID}, round(CASE WHEN arg_min({C.MOVING_STATE}, {C.START}) = 'STILL' THEN arg_min({C.CENTER_LAT}, {C.START}) ELSE arg_min(plat, {C.START}) END, 6) AS dlat, round(CASE WHEN arg_min({C.MOVING_STATE}, {C.START}) = 'STILL' THEN arg_min({C.CENTER_LON}, {C.START}) ELSE arg_min(plon, {C.START}) END, 6) AS dlon,
    round(CASE WHEN arg_max({C.MOVING_STATE}, {C.START}) = 'STILL' THEN arg_max({C.CENTER_LAT}, {C.START}) ELSE arg_max({C.END_LAT}, {C.START}) END, 6) AS alat, round(CASE WHEN arg_max({C.MOVING_STATE}, {C.START}) = 'STILL' THEN arg_max({C.CENTER_LON}, {C.START}) ELSE arg_max({C.END_LON}, {C.START}) END, 6) AS alon FROM runs WHERE {C.COURSE_OR_STOP} <> 'STOP' GROUP BY 1),
  located AS (SELECT * FROM placed JOIN ends USING ({C.COURSE_ID})),
  away AS (SELECT id, i, j, m FROM {geodesy.sql("(SELECT a.id, a.j AS i, b.j, a.dlat, a.dlon, b.alat, b.alon FROM located a JOIN located b ON a.id = b.id AND a.j <= b.j)", "dlat", "dlon", "alat", "alon", "m")}),
  folded AS (
    SELECT id, j, j AS i, m AS last, 0 AS mission FROM away WHERE i = 1 AND j = 1
    UNION ALL
    SELECT f.id, f.j + 1, CASE WHEN o.m < f.last THEN f.j + 1 ELSE f.i END, CASE WHEN o.m < f.last THEN n.m ELSE o.m END, f.mission + CASE WHEN o.m < f.last THEN 1 ELSE 0 END
    FROM folded f JOIN away o ON o.id = f.id AND o.i = f.i AND o.j = f.j + 1 JOIN away n ON n.id = f.id AND n.i = f.j + 1 AND n.j = f.j + 1),
  missions AS (SELECT id, mission, min(s) AS s, max(e) AS e, sum(cd) AS cd, sum(gps) AS gps, arg_max(last, s) AS line FROM folded JOIN located USING (id, j) GROUP BY 1, 2)"""


@_query(with_fragments(f"""SELECT id, {C.COURSE_ID}, id || '#' || m.s || '_' || m.e AS {C.MISSION}id, CAST(m.cd AS BIGINT) AS {C.MISSION}duration_s, round(m.line, 3) AS {C.MISSION}straight_line_m, round(CASE WHEN m.line = 0 OR m.gps = 0 THEN 0.0e0 ELSE m.line / m.gps END, 5) AS {C.MISSION}straightness
  FROM folded JOIN located USING (id, j) JOIN missions m USING (id, mission)""", _MISSIONS_SQL).replace("WITH points", "WITH RECURSIVE points", 1))
def mission_tag(spark, d):
    courses = process(runs(spark, d), fragments.CourseExtraction(MODEL)).withColumn("sensor", F.col(C.DISTANCE))
    named = courses.withColumns({f"{s}{f}": F.lit(None).cast("string") for s in (C.DEPARTURE, C.ARRIVAL) for f in C.ADDRESS_FIELDS})
    tag = missions.Missions(MODEL, "sensor", C.DISTANCE)
    # no more goes through the fold than it needs: what Python takes, Spark can't prune, and trails are dear
    out = process(named.select(C.COURSE_ID, *tag.required()), tag)
    return out.select("id", C.COURSE_ID, f"{C.MISSION}id", f"{C.MISSION}duration_s", F.round(f"{C.MISSION}straight_line_m", 3).alias(f"{C.MISSION}straight_line_m"), F.round(f"{C.MISSION}straightness", 5).alias(f"{C.MISSION}straightness"))


# A geohash of six letters by whole numbers: fifteen bits of either axis, interleaved.
_BITS = "CAST(greatest(ceil(({x} + {half}) / (2 * {half}) * 32768) - 1, 0) AS INTEGER)"
_HASH = f"""array_to_string(list_transform(range(6), lambda k: substr('0123456789bcdefghjkmnpqrstuvwxyz', 1 + CAST(list_sum(list_transform(range(5), lambda b: CAST(((CASE WHEN (k * 5 + b) % 2 = 0 THEN {_BITS.format(x="x", half=180)} ELSE {_BITS.format(x="y", half=90)} END) >> CAST(14 - (k * 5 + b) // 2 AS INTEGER)) & 1 AS INTEGER) << CAST(4 - b AS INTEGER))) AS INTEGER), 1)), '')"""


@_query(with_fragments(f"SELECT {C.FRAGMENT_ID}, string_agg(DISTINCT h, ',' ORDER BY h) AS hashes FROM (SELECT {C.FRAGMENT_ID}, {_HASH} AS h FROM (SELECT {C.FRAGMENT_ID}, plat AS y, plon AS x FROM fragments UNION ALL SELECT {C.FRAGMENT_ID}, {C.END_LAT}, {C.END_LON} FROM fragments)) GROUP BY 1"))
def geohash_trail(spark, d):
    return process(flow(spark, d), features.Geohashes(C.TRAIL, "hashes")).select(C.FRAGMENT_ID, F.array_join("hashes", ",").alias("hashes"))


@_query()
def simplify_trail(spark, d):
    summary = process(runs(spark, d), fragments.StopPauseSummary(MODEL)).where(F.col(C.MOVING_STATE) == C.STILL)
    return process(summary, features.SimplifiedGeometry(C.TRAIL, "simple", 0.02)).select(C.MOTION_ID, "simple")


_COORDINATE = lambda x: f"regexp_replace(CAST(CAST({x} AS DECIMAL(12, 7)) AS VARCHAR), '[.]?0+$', '')"
_SHIFTED = f"""(SELECT id, {T} AS t, lat AS y, x, lag({T}) OVER w AS pt, lag(lat) OVER w AS py, lag(x) OVER w AS px FROM (SELECT *, CASE WHEN lon > 2.15 THEN lon - 182 ELSE lon + 177 END AS x FROM points) WINDOW w AS (PARTITION BY id ORDER BY {T}))"""
_CUT = "(CASE WHEN x < 0 THEN py + (180 - px) / (x + 360 - px) * (y - py) ELSE py + (180 - (px + 360)) / (x - (px + 360)) * (y - py) END)"


@_query(with_points(f"""SELECT id || '#' || pt || '_' || t AS {C.FRAGMENT_ID}, CASE WHEN px = x AND py = y THEN 'POINT (' || b || ')' WHEN abs(x - px) < 180 THEN 'LINESTRING (' || a || ', ' || b || ')'
  ELSE 'MULTILINESTRING ((' || a || ', ' || CASE WHEN x < 0 THEN '180' ELSE '-180' END || ' ' || c || '), (' || CASE WHEN x < 0 THEN '-180' ELSE '180' END || ' ' || c || ', ' || b || '))' END AS fixed
  FROM (SELECT *, {_COORDINATE('px')} || ' ' || {_COORDINATE('py')} AS a, {_COORDINATE('x')} || ' ' || {_COORDINATE('y')} AS b, {_COORDINATE(_CUT)} AS c FROM {_SHIFTED} WHERE pt IS NOT NULL)"""))  # fmt: skip
def antimeridian_fix(spark, d):
    shifted = points(spark, d).withColumn("lon", F.expr("CASE WHEN lon > 2.15 THEN lon - 182 ELSE lon + 177 END"))
    return process(process(shifted, fragments.FlowFragments(MODEL)), features.AntimeridianGeometry(C.TRAIL, "fixed")).select(C.FRAGMENT_ID, "fixed")


_MOVING = HmmModel(("STILL", "MOVE"), (20.0, 50.0), {"STILL": (0.7, 0.2, 0.1), "MOVE": (0.1, 0.3, 0.6)}, {"STILL": {"STILL": 0.8, "MOVE": 0.2}, "MOVE": {"STILL": 0.3, "MOVE": 0.7}}, {"STILL": 0.6, "MOVE": 0.4})
_TEMPI = HmmModel(("tempo_short", "tempo_irregular"), (10000.0, 40000.0), {"tempo_short": (0.6, 0.3, 0.1), "tempo_irregular": (0.2, 0.3, 0.5)}, {"tempo_short": {"tempo_short": 0.7, "tempo_irregular": 0.3}, "tempo_irregular": {"tempo_short": 0.4, "tempo_irregular": 0.6}}, {"tempo_short": 0.5, "tempo_irregular": 0.5})


def _viterbi(model: HmmModel, value: str, order: str) -> str:
    """The likeliest of two states for each row of ``fragments``, by recursion over each object's rows with the best path to either state."""
    a, b = model.states
    emit = {s: "ln(CASE " + " ".join(f"WHEN x < {edge!r}e0 THEN {p!r}e0" for edge, p in zip(model.edges, model.emission[s], strict=False)) + f" ELSE {model.emission[s][-1]!r}e0 END)" for s in model.states}
    step = lambda p, q: f"ln({model.transition[p][q]!r}e0)"

    def best(q: str) -> tuple[str, str]:
        one, two = f"(w.sa + {step(a, q)})", f"(w.sb + {step(b, q)})"
        return f"greatest({one}, {two}) + {emit[q]}", f"list_append(CASE WHEN {one} >= {two} THEN w.pa ELSE w.pb END, '{q}')"

    (sa, pa), (sb, pb) = best(a), best(b)
    return f"""numbered AS (SELECT id, {order} AS at, coalesce(CAST({value} AS DOUBLE), 0) AS x, row_number() OVER (PARTITION BY id ORDER BY {order}) AS n, count(*) OVER (PARTITION BY id) AS size FROM fragments),
      walked AS (
        SELECT id, n, size, ln({model.initial[a]!r}e0) + {emit[a]} AS sa, ln({model.initial[b]!r}e0) + {emit[b]} AS sb, ['{a}'] AS pa, ['{b}'] AS pb FROM numbered WHERE n = 1
        UNION ALL SELECT w.id, r.n, w.size, {sa}, {sb}, {pa}, {pb} FROM walked w JOIN numbered r ON r.id = w.id AND r.n = w.n + 1),
      decoded AS (SELECT numbered.id, numbered.at, (CASE WHEN sa >= sb THEN pa ELSE pb END)[numbered.n] AS state FROM walked JOIN numbered USING (id) WHERE walked.n = walked.size)"""


def _decoded(model: HmmModel, value: str, target: str, shown: str = "state") -> str:
    sql = with_fragments(f"SELECT f.id, f.{C.START}, {shown} AS {target} FROM fragments f JOIN decoded ON decoded.id = f.id AND decoded.at = f.{C.CENTER}", _viterbi(model, value, C.CENTER))
    return sql.replace("WITH points", "WITH RECURSIVE points", 1)


@_query(_decoded(_MOVING, "value", C.MOVING_STATE, f"CASE WHEN f.{D} > 43200 THEN 'GAP' ELSE state END"))
def hmm_moving_state(spark, d):
    gaps = process(flow(spark, d).drop(C.MOVING_STATE), features.GapState())
    return process(gaps, hmm.MovingState(_MOVING, speed="value", gap=C.GAP_STATE)).select(*_FRG, C.MOVING_STATE)


@_query(_decoded(_TEMPI, D, C.TEMPO))
def hmm_tempo(spark, d):
    return process(flow(spark, d), hmm.Tempo(_TEMPI)).select(*_FRG, C.TEMPO)


@_query(with_points(f"SELECT DISTINCT CAST(id AS INTEGER) % 10 || 'o' AS id, CAST({T} // 86400 AS VARCHAR) AS {T}, count(*) OVER (PARTITION BY CAST(id AS INTEGER) % 10, {T} // 86400) AS n FROM points"))
def deduplicated_points(spark, d):
    """Rows that share object and time, of which the formatter keeps one."""
    many = points(spark, d).select(F.concat((F.col("id").cast("int") % 10).cast("string"), F.lit("o")).alias("id"), F.expr(f"{T} div 86400").cast("string").alias(T), F.lit("1,5").alias("lat"), F.lit("2").alias("lon"))
    counted = many.withColumn("n", F.count("*").over(Window.partitionBy("id", T)))
    return process(counted, features.FormatPoints(MODEL)).select("id", T, "n")


@_query(with_points(f"SELECT id, {T}, last_value(CASE WHEN value > 40 THEN id || '#' || {T} END IGNORE NULLS) OVER (PARTITION BY id ORDER BY {T} ROWS UNBOUNDED PRECEDING) AS run FROM points"))
def state_id_from_condition(spark, d):
    return process(points(spark, d), segments.RunFromCondition("id", T, "run", F.col("value") > 40)).select(*_PTS, "run")


@_query(with_fragments(f"SELECT {C.FRAGMENT_ID}, round({C.DISTANCE}, 3) AS {C.STRAIGHT}, 1.0e0 AS {C.STRAIGHTNESS} FROM fragments"))
def straight_lines(spark, d):
    return flow(spark, d).select(C.FRAGMENT_ID, F.round(C.STRAIGHT, 3).alias(C.STRAIGHT), C.STRAIGHTNESS)


_CORNER = "CASE WHEN std = 0 THEN 1e-4 ELSE std END"


@_query(with_fragments(f"""SELECT {C.FRAGMENT_ID}, CAST(len(c) AS BIGINT) AS corners, round(list_max(list_transform(c, lambda i: mx + rx * cos(i * pi() / 6))), 5) AS east, round(list_min(list_transform(c, lambda i: my + ry * sin(i * pi() / 6))), 5) AS south
  FROM (SELECT {C.FRAGMENT_ID}, range(13) AS c, {C.CENTER_LON} AS mx, {C.CENTER_LAT} AS my, {_CORNER.replace("std", f"abs({C.END_LON} - plon) / 2")} AS rx, {_CORNER.replace("std", f"abs({C.END_LAT} - plat) / 2")} AS ry FROM fragments)"""))  # fmt: skip
def precision_ellipses(spark, d):
    """Extents of the ellipses around fragments."""
    out = process(points(spark, d), fragments.FlowFragments(MODEL, precision=True))
    pair = F.regexp_extract_all(C.PRECISION_TRAIL, F.lit(r"-?[0-9.]+ -?[0-9.]+"), F.lit(0))
    xs = F.transform(pair, lambda p: F.substring_index(p, " ", 1).cast("double"))
    ys = F.transform(pair, lambda p: F.substring_index(p, " ", -1).cast("double"))
    return out.select(C.FRAGMENT_ID, F.size(pair).cast("bigint").alias("corners"), F.round(F.array_max(xs), 5).alias("east"), F.round(F.array_min(ys), 5).alias("south"))
