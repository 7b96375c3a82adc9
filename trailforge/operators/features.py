"""Columns derived row by row, range filters, lookups and formatting."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import columns as C
from ..core import Transformer, process, require
from ..functions import wkt
from ..model import DataModel


class GapState(Transformer):
    """``GAP`` where the duration is over the threshold; else, and for null, ``not_a_gap``."""

    def __init__(self, target: str = C.GAP_STATE, duration: str = C.DURATION, threshold: int = 43200) -> None:
        self.target, self.duration, self.threshold = target, duration, threshold

    def required(self) -> list[str]:
        return [self.duration]

    def build(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.target, F.when(F.col(self.duration) > self.threshold, C.GAP).otherwise(C.NOT_GAP))


class VisibilityProportion(Transformer):
    """0.0 where the duration is over the threshold; else, and for null, 1.0."""

    def __init__(self, target: str = C.VISIBILITY, duration: str = C.DURATION, threshold: int = 1800) -> None:
        self.target, self.duration, self.threshold = target, duration, threshold

    def required(self) -> list[str]:
        return [self.duration]

    def build(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.target, F.when(F.col(self.duration) > self.threshold, 0.0).otherwise(1.0))


class Speed(Transformer):
    """Distance over duration in a unit; null for a duration of 0."""

    UNITS = {"m/s": 1.0, "km/h": 3.6, "nd": 1.9438444924406}

    def __init__(self, target: str, unit: str = "m/s", duration: str = C.DURATION, distance: str = C.DISTANCE) -> None:
        self.target, self.factor, self.duration, self.distance = target, self.UNITS.get(unit, 1.0), duration, distance

    def required(self) -> list[str]:
        return [self.duration, self.distance]

    def build(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.target, F.try_divide(F.col(self.distance), F.col(self.duration)) * self.factor)


class GpsOrSensorSpeed(Transformer):
    """The sensor's speed, or the one from places where it is null or the duration over the threshold."""

    def __init__(self, target: str, gps: str, sensor: str, duration: str = C.DURATION, threshold: int = 300) -> None:
        self.target, self.gps, self.sensor, self.duration, self.threshold = target, gps, sensor, duration, threshold

    def required(self) -> list[str]:
        return [self.gps, self.sensor, self.duration]

    def build(self, df: DataFrame) -> DataFrame:
        far = F.col(self.sensor).isNull() | (F.col(self.duration) > self.threshold)
        return df.withColumn(self.target, F.when(far, F.col(self.gps)).otherwise(F.col(self.sensor)))


class CourseOrStop(Transformer):
    """Long stills (or of unknown length) are stops, gaps stay gaps, all else is course."""

    def __init__(self, timeout: int = 600, target: str = C.COURSE_OR_STOP, state: str = C.MOVING_STATE, duration: str = C.MOTION_DURATION) -> None:
        self.timeout, self.target, self.state, self.duration = timeout, target, state, duration

    def required(self) -> list[str]:
        return [self.state, self.duration]

    def build(self, df: DataFrame) -> DataFrame:
        state = F.col(self.state)
        still = F.when(F.col(self.duration) < self.timeout, C.COURSE).otherwise(C.STOP)
        return df.withColumn(self.target, F.when(state == C.STILL, still).when(state == C.GAP, C.GAP).otherwise(C.COURSE))


class CourseState(Transformer):
    """``MOTION`` or ``PAUSE`` within a course, null elsewhere."""

    def __init__(self, target: str = C.COURSE_STATE, course: str = C.COURSE_OR_STOP, state: str = C.MOVING_STATE) -> None:
        self.target, self.course, self.state = target, course, state

    def required(self) -> list[str]:
        return [self.course, self.state]

    def build(self, df: DataFrame) -> DataFrame:
        inside = F.when(F.col(self.state) == C.MOVE, C.MOTION).when(F.col(self.state) == C.STILL, C.PAUSE)
        return df.withColumn(self.target, F.when(F.col(self.course) == C.COURSE, inside))


class CountryNames(Transformer):
    """Country names in another format by a lookup table; a name that isn't there stays as it is.

    Keys that the table repeats count once.  The table is broadcast only if
    Spark finds it small (``spark.sql.autoBroadcastJoinThreshold``).
    """

    def __init__(self, source: str, target: str, table: DataFrame, key: str = "alpha2", value: str = "nom") -> None:
        self.source, self.target, self.table, self.key, self.value = source, target, table, key, value

    def required(self) -> list[str]:
        return [self.source]

    def build(self, df: DataFrame) -> DataFrame:
        known = self.table.groupBy(F.col(self.key).alias("__key")).agg(F.min(self.value).alias("__value"))
        joined = df.join(known, F.col(self.source) == F.col("__key"), "left")
        return joined.withColumn(self.target, F.coalesce("__value", F.col(self.source).cast("string"))).drop("__key", "__value")


class TempoProportions(Transformer):
    """For each ``{target: tempo}`` 1.0 where the row has that tempo, else 0.0; and that it isn't of several tempos."""

    def __init__(self, proportions: dict[str, str], tempo: str = C.TEMPO, multi: str = C.TEMPO_MULTI) -> None:
        self.proportions, self.tempo, self.multi = proportions, tempo, multi

    def required(self) -> list[str]:
        return [self.tempo]

    def build(self, df: DataFrame) -> DataFrame:
        hot = {target: F.when(F.col(self.tempo) == tempo, 1.0).otherwise(0.0) for target, tempo in self.proportions.items()}
        return df.withColumns(hot | {self.multi: F.lit(False)})


class Geohashes(Transformer):
    """Distinct geohashes of a trail's vertices, sorted; empty for null and empty trails."""

    def __init__(self, trail: str, target: str, precision: int = 6) -> None:
        self.trail, self.target, self.precision = trail, target, precision

    def required(self) -> list[str]:
        return [self.trail]

    def build(self, df: DataFrame) -> DataFrame:
        precision = self.precision
        return df.withColumn(self.target, wkt.column(lambda t: wkt.geohashes(t, precision), T.ArrayType(T.StringType()))(F.col(self.trail)))


class SimplifiedGeometry(Transformer):
    """Douglas-Peucker on a geometry; null for null and empty ones."""

    def __init__(self, source: str, target: str, tolerance: float | None = None) -> None:
        self.source, self.target, self.tolerance = source, target, wkt.TOLERANCE if tolerance is None else tolerance

    def required(self) -> list[str]:
        return [self.source]

    def build(self, df: DataFrame) -> DataFrame:
        tolerance = self.tolerance
        return df.withColumn(self.target, wkt.column(lambda t: wkt.simplify(t, tolerance))(F.col(self.source)))


class AntimeridianGeometry(Transformer):
    """Lines that cross the antimeridian, cut there; other geometries as they are."""

    def __init__(self, source: str, target: str) -> None:
        self.source, self.target = source, target

    def required(self) -> list[str]:
        return [self.source]

    def build(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.target, wkt.column(wkt.split_antimeridian)(F.col(self.source)))


class SupportValues(Transformer):
    """A value repeated for long durations: ``most`` times where the duration is over ``delta * most``, else once (nulls as 0)."""

    def __init__(self, source: str, target: str, delta: int = 120, most: int = 10, duration: str = C.DURATION) -> None:
        self.source, self.target, self.delta, self.most, self.duration = source, target, delta, most, duration

    def required(self) -> list[str]:
        return [self.source, self.duration]

    def build(self, df: DataFrame) -> DataFrame:
        value = F.coalesce(F.col(self.source).cast("double"), F.lit(0.0))
        times = F.when(F.coalesce(F.col(self.duration), F.lit(0)) > self.delta * self.most, self.most).otherwise(1)
        return df.withColumn(self.target, F.array_repeat(value, times))


class WithinRange(Transformer):
    """Rows whose place lies in closed ranges; null places go."""

    def __init__(self, lat: str, lon: str, lat_min: float = -90, lon_min: float = -180, lat_max: float = 90, lon_max: float = 180) -> None:
        self.lat, self.lon, self.lats, self.lons = lat, lon, (lat_min, lat_max), (lon_min, lon_max)

    def required(self) -> list[str]:
        return [self.lat, self.lon]

    def build(self, df: DataFrame) -> DataFrame:
        return df.where(F.col(self.lat).between(*self.lats) & F.col(self.lon).between(*self.lons))


class StandardTimestamp(Transformer):
    """Epoch seconds from a time text: with the pattern's zone, or as UTC where it has none; null where it doesn't parse."""

    def __init__(self, model: DataModel, target: str = C.TIMESTAMP) -> None:
        self.model, self.target = model, target

    def required(self) -> list[str]:
        return [self.model.timestamp]

    def build(self, df: DataFrame) -> DataFrame:
        text, pattern = F.col(self.model.timestamp).cast("string"), self.model.time_format
        if not set("XxZzVO") & set(re.sub("'[^']*'", "", pattern)):  # no zone in it: the session's must not be taken
            text, pattern = F.concat(text, F.lit(" +00:00")), f"{pattern} XXX"
        at = F.try_to_timestamp(text, F.lit(pattern))
        return df.withColumn(self.target, F.unix_seconds(at))


class TimePartition(Transformer):
    """The day of epoch seconds as an integer (session time zone)."""

    def __init__(self, timestamp: str = C.TIMESTAMP, target: str = C.PARTITION, pattern: str = "yyyyMMdd") -> None:
        self.timestamp, self.target, self.pattern = timestamp, target, pattern

    def required(self) -> list[str]:
        return [self.timestamp]

    def build(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.target, F.from_unixtime(self.timestamp, self.pattern).cast("int"))


def deduplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: the least by its JSON text, so that the choice is repeatable for columns of any type."""
    row = F.struct(*(F.col(f"`{c}`").alias(c) for c in df.columns))
    best = df.groupBy(*(F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return best.select(*(F.col("row")[c].alias(c) for c in df.columns))


class FormatPoints(Transformer):
    """One row for each object and time; places and the named columns as doubles (decimal commas too), ids and times as texts."""

    def __init__(self, model: DataModel, doubles: tuple[str, ...] = ()) -> None:
        self.model, self.doubles = model, doubles

    def required(self) -> list[str]:
        m = self.model
        return [m.id, m.timestamp, m.lat, m.lon, *self.doubles]

    def build(self, df: DataFrame) -> DataFrame:
        m = self.model
        out = deduplicated(df, [m.id, m.timestamp])
        kinds = dict(df.dtypes)

        def number(c: str) -> Column:
            if kinds[c] == "string":
                return F.regexp_replace(c, ",", ".").try_cast("double")
            return F.col(c).cast("double")

        return out.withColumns({c: number(c) for c in (m.lat, m.lon, *self.doubles)} | {c: F.col(c).cast("string") for c in (m.id, m.timestamp)})


def valid_name(name: str) -> str:
    """White space to underscores, only letters, digits and underscores, no underscore in front, lower case."""
    kept = "".join("_" if c.isspace() else c for c in name if c.isspace() or c == "_" or (c.isascii() and c.isalnum()))
    return kept.removeprefix("_").lower()


def with_valid_names(df: DataFrame) -> DataFrame:
    return df.toDF(*map(valid_name, df.columns))


def formatted(df: DataFrame, model: DataModel, doubles: tuple[str, ...] = ()) -> DataFrame:
    """Formatted points with standard times and day partitions."""
    return process(df, FormatPoints(model, doubles), StandardTimestamp(model), TimePartition())


def with_empty(df: DataFrame, name: str, kind: str = "string") -> DataFrame:
    return df.withColumn(name, F.lit(None).cast(kind))


def nested(df: DataFrame, groups: dict[str, dict]) -> DataFrame:
    """``df`` with struct columns; a group maps a field to a column's name, a Column or a further group."""
    clash = [g for g in groups if g in df.columns]
    if clash:
        raise ValueError(f"Group {clash[0]} cannot be made because the table has a column of this name")

    def build(group: dict) -> Column:
        return F.struct(*((build(v) if isinstance(v, dict) else F.col(v) if isinstance(v, str) else v).alias(k) for k, v in group.items()))

    def names(group: dict) -> list[str]:
        return [n for v in group.values() for n in (names(v) if isinstance(v, dict) else [v] if isinstance(v, str) else [])]

    require(df.schema, [n for g in groups.values() for n in names(g) if "." not in n])
    return df.withColumns({name: build(group) for name, group in groups.items()})
