"""Fragments between consecutive points, and summaries of runs of fragments.

A summary aggregates the rows that meet a condition by a key and leaves the
others as they are, in one ``groupBy`` that reads its rows once.  Values that
hang on order (first, last, trails) come from ``min_by``/``max_by`` and sorted
lists over the start time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import columns as C
from ..core import Transformer
from ..functions import geodesy, wkt
from ..model import DataModel

#: A fragment this visible, or more, counts as seen.
SEEN = 0.8


class FlowFragments(Transformer):
    """A fragment for each point of an object but its first, from the one before.

    Named numeric columns become means over both points (``frag_<name>``, the
    source is dropped).  With ``precision`` the deviations of the two points and
    an ellipse of ``corners`` corners are added.
    """

    def __init__(self, model: DataModel, group: str | None = None, averaged: tuple[str, ...] = (), corners: int = 12, precision: bool = False, timestamp: str = C.TIMESTAMP) -> None:
        self.model, self.group, self.averaged, self.corners, self.precision, self.ts = model, group or model.id, averaged, corners, precision, timestamp

    def required(self) -> list[str]:
        m = self.model
        return [m.lat, m.lon, self.group, self.ts, *self.averaged]

    def build(self, df: DataFrame) -> DataFrame:
        lat, lon, ts = self.model.lat, self.model.lon, self.ts
        w = W.partitionBy(self.group).orderBy(ts)
        before = {"__ts": F.lag(ts).over(w), "__lat": F.lag(lat).over(w), "__lon": F.lag(lon).over(w)}
        before |= {f"__m_{c}": F.avg(c).over(w.rowsBetween(-1, 0)) for c in self.averaged}
        pairs = df.withColumns(before).where("__ts is not null")
        pairs = geodesy.with_geodesic(pairs, "__lat", "__lon", lat, lon, C.DISTANCE, C.BEARING)
        seconds = F.col(ts) - F.col("__ts")
        center = F.expr(f"CAST((`{ts}` + __ts) / 2 AS BIGINT)")
        made = {
            C.FRAGMENT_ID: F.concat(F.col(self.group), F.lit("#"), F.col("__ts").cast("string"), F.lit("_"), F.col(ts).cast("string")),
            C.NB_POINTS: F.lit(2),
            C.TRAIL: F.expr(wkt.pair_trail_sql("__lat", "__lon", f"`{lat}`", f"`{lon}`")),
            C.DURATION: seconds,
            C.START: F.col("__ts"),
            C.END: F.col(ts),
            C.CENTER: center,
            C.PARTITION: F.from_unixtime(center, "yyyyMMdd").cast("int"),
            C.END_LAT: F.col(lat),
            C.END_LON: F.col(lon),
            C.CENTER_LAT: F.round((F.col(lat) + F.col("__lat")) / 2, 6),
            C.CENTER_LON: F.round((F.col(lon) + F.col("__lon")) / 2, 6),
            C.STRAIGHT: F.col(C.DISTANCE),
            C.STRAIGHTNESS: F.lit(1.0),
            C.SPEED: F.try_divide(F.col(C.DISTANCE), seconds),
        }
        if self.precision:
            for target, now, old in ((C.CENTER_LAT_STD, lat, "__lat"), (C.CENTER_LON_STD, lon, "__lon")):
                made[target] = F.round(F.abs(F.col(now) - F.col(old)) / 2, 12)  # the deviation of two values
        out = pairs.withColumns(made | {f"{C.AVERAGED}{c}": F.col(f"__m_{c}") for c in self.averaged})
        if self.precision:
            out = out.withColumn(C.PRECISION_TRAIL, F.expr(wkt.ellipse_sql(C.CENTER_LAT, C.CENTER_LON, C.CENTER_LAT_STD, C.CENTER_LON_STD, self.corners)))
        return out.withColumn(ts, F.col(C.CENTER)).drop(*before, *self.averaged)


class FragmentSummary(Transformer):
    """The common part of summaries; see the module.

    Subclasses give the key, the condition, the columns taken from the first
    row of a key (``propagated``) and further aggregates.  ``weighted`` columns
    are means by duration, ``tempos`` maps a proportion column to its tempo.
    A null condition passes a row through.  Rows of a key that meet the
    condition are aggregated even if the key's first row doesn't.
    """

    MIXED = 0.1

    def __init__(self, model: DataModel, weighted: tuple[str, ...] = (), tempos: dict[str, str] | None = None, irregular: str = C.IRREGULAR, precision: bool = False) -> None:
        self.model, self.weighted, self.tempos, self.irregular, self.precision = model, weighted, tempos or {}, irregular, precision

    key: str
    propagated: tuple[str, ...] = ()

    def condition(self) -> Column:
        raise NotImplementedError

    def extra(self, df: DataFrame) -> dict[str, Column]:
        return {}

    def after(self, summary: DataFrame) -> DataFrame:
        """Changes the summary rows, before they join the others."""
        return summary

    def finish(self, df: DataFrame) -> DataFrame:
        return df

    def required(self) -> list[str]:
        fixed = [C.NB_POINTS, C.TRAIL, C.DURATION, C.START, C.END, C.END_LAT, C.END_LON, C.CENTER_LAT, C.CENTER_LON, C.DISTANCE]
        return [self.model.id, self.key, *fixed, *self.weighted, *self.tempos, *self.propagated]

    def build(self, df: DataFrame) -> DataFrame:
        ok = F.coalesce(self.condition(), F.lit(False)) & F.col(self.key).isNotNull()
        start = F.struct(C.START, C.END)
        mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col(C.DURATION)), F.sum(C.DURATION))
        aggregates: dict[str, Column] = {c: mean(c) for c in (*self.weighted, *self.tempos)}
        aggregates |= {c: F.min_by(c, start) for c in dict.fromkeys((self.model.id, *self.propagated)) if c != self.key}
        aggregates |= {
            "__first": F.min_by(C.TRAIL, start),
            "__last": F.max_by(C.TRAIL, start),
            C.DISTANCE: F.sum(C.DISTANCE),
            C.NB_POINTS: (F.sum(C.NB_POINTS) - F.count("*") + 1).cast("int"),
            C.START: F.min(C.START),
            C.END: F.max(C.END),
            C.DURATION: F.sum(C.DURATION),
            C.CENTER_LAT: F.round(F.mean(C.CENTER_LAT), 6),
            C.CENTER_LON: F.round(F.mean(C.CENTER_LON), 6),
            C.END_LAT: F.max_by(C.END_LAT, start),
            C.END_LON: F.max_by(C.END_LON, start),
        }
        if self.precision:
            aggregates |= {C.CENTER_LAT_STD: F.round(F.stddev_pop(C.CENTER_LAT), 12), C.CENTER_LON_STD: F.round(F.stddev_pop(C.CENTER_LON), 12)}
        aggregates |= self.extra(df)
        if "__rows" in aggregates:
            aggregates["__rows"] = F.when(F.col("__ok"), aggregates["__rows"])
        # one pass: a row that isn't summed up is a group of its own, numbered within its key (rows without one: within their object)
        w = W.partitionBy(self.key, "__spread").orderBy(C.START, C.END)
        marked = df.withColumns({"__ok": ok, "__spread": F.when(F.col(self.key).isNull(), F.col(self.model.id))})
        marked = marked.withColumn("__own", F.when(~F.col("__ok"), F.row_number().over(w)))
        own = {c: F.first(c).alias(f"__own_{c}") for c in df.columns if c != self.key}
        summary = marked.groupBy(self.key, "__spread", "__ok", "__own").agg(*(v.alias(k) for k, v in aggregates.items()), *own.values())
        for side, last in (("first", False), ("last", True)):
            pair = F.regexp_extract_all(f"__{side}", F.lit(r"(-?[0-9.]+ -?[0-9.]+)"))
            xy = F.split(F.element_at(pair, -1 if last else 1), " ")
            summary = summary.withColumns({f"__{side}_lon": F.get(xy, F.lit(0)).try_cast("double"), f"__{side}_lat": F.get(xy, F.lit(1)).try_cast("double")})
        summary = geodesy.with_geodesic(summary, "__first_lat", "__first_lon", "__last_lat", "__last_lon", C.STRAIGHT)
        center = F.expr(f"CAST(({C.START} + {C.END}) / 2 AS BIGINT)")
        summary = summary.withColumns({
            C.STRAIGHT: F.coalesce(C.STRAIGHT, F.lit(0.0)),
            C.CENTER: center,
            C.TIMESTAMP: center,
            C.PARTITION: F.from_unixtime(center, "yyyyMMdd").cast("int"),
            C.FRAGMENT_ID: F.concat(F.col(self.key), F.lit("#"), F.col(C.START).cast("string"), F.lit("_"), F.col(C.END).cast("string")),
            C.SPEED: F.try_divide(F.col(C.DISTANCE), F.col(C.DURATION)),
        })
        summary = summary.withColumn(C.STRAIGHTNESS, F.try_divide(F.col(C.STRAIGHT), F.col(C.DISTANCE)))
        if self.tempos:
            summary = summary.withColumns(self._main_tempo())
        summary = self.after(summary).drop(*(f"__{s}{x}" for s in ("first", "last") for x in ("", "_lat", "_lon")))
        hidden = {"__spread", "__ok", "__own", *(f"__own_{c}" for c in own)}
        summed = [c for c in summary.columns if c not in hidden]
        is_sum = F.col("__ok")
        either = [F.col(c) if c == self.key else F.when(is_sum, F.col(c)).otherwise(F.col(f"__own_{c}") if c in own else None).alias(c) for c in summed]
        return self.finish(summary.select(*either, *(F.when(~is_sum, F.col(f"__own_{c}")).alias(c) for c in own if c not in summed)))

    def _main_tempo(self) -> dict[str, Column]:
        regular = [c for c, tempo in self.tempos.items() if tempo != self.irregular]
        if not regular:
            return {C.TEMPO: F.lit(self.irregular), C.TEMPO_MULTI: F.lit(False)}
        best = F.greatest(*regular) if len(regular) > 1 else F.col(regular[0])
        main = reduce(lambda w, c: w.when(F.col(c) == best, self.tempos[c]), regular, F.when(F.coalesce(best, F.lit(0.0)) == 0, self.irregular))
        shares = reduce(Column.__add__, (F.coalesce(F.col(c) > self.MIXED, F.lit(False)).cast("int") for c in regular))
        return {C.TEMPO: main, C.TEMPO_MULTI: shares > 1}


def _in_order(*columns: str) -> Column:
    """The rows of a group by start, as an array of structs (nulls kept)."""
    return F.sort_array(F.collect_list(F.struct(C.START, C.END, *columns)))


_TRAIL = wkt.column(lambda rows: wkt.joined_trail([r[C.TRAIL] for r in rows], [r[C.CENTER_LAT] for r in rows], [r[C.CENTER_LON] for r in rows], [r["use"] for r in rows]) if rows else None)


def _joined(rows: Column, use) -> Column:
    return _TRAIL(F.transform(rows, lambda r: F.struct(r[C.TRAIL].alias(C.TRAIL), r[C.CENTER_LAT].alias(C.CENTER_LAT), r[C.CENTER_LON].alias(C.CENTER_LON), use(r).alias("use"))))


_VERTEX = r"-?[0-9.]+(?:[eE][-+]?[0-9]+)?\s+-?[0-9.]+(?:[eE][-+]?[0-9]+)?"


def _along(state) -> Column:
    """Whether a course's trail takes the row's own vertices; of a still row it takes the centre."""
    return F.coalesce(state != C.STILL, F.lit(True))


def _placed() -> Column:
    """Whether the row gives the course's trail a vertex."""
    return ~_along(F.col(C.MOVING_STATE)) | F.coalesce(F.col(C.TRAIL).rlike(_VERTEX), F.lit(False))


class StopPauseSummary(FragmentSummary):
    """One row for each still motion."""

    key = C.MOTION_ID

    def __init__(self, model: DataModel, propagated: tuple[str, ...] = (), corners: int = 12, **options) -> None:
        super().__init__(model, **options)
        self.corners = corners
        self.propagated = (C.MOVING_STATE, C.COURSE_OR_STOP, C.COURSE_STATE, C.MOTION_DURATION, C.COURSE_ID, C.COURSE_DURATION, *propagated)

    def condition(self) -> Column:
        return F.col(C.MOVING_STATE) == C.STILL

    def extra(self, df: DataFrame) -> dict[str, Column]:
        return {"__rows": _in_order(C.TRAIL, C.CENTER_LAT, C.CENTER_LON)}

    def after(self, summary: DataFrame) -> DataFrame:
        out = summary.withColumn(C.TRAIL, _joined(F.col("__rows"), lambda r: F.lit(True))).drop("__rows")
        if self.precision:
            low = {c: F.least(F.col(c), F.lit(0.001)) for c in (C.CENTER_LAT_STD, C.CENTER_LON_STD)}
            shown = out.withColumns({f"__c_{c}": v for c, v in low.items()})
            ellipse = wkt.ellipse_sql(C.CENTER_LAT, C.CENTER_LON, f"__c_{C.CENTER_LAT_STD}", f"__c_{C.CENTER_LON_STD}", self.corners)
            out = shown.withColumn(C.PRECISION_TRAIL, F.expr(ellipse)).drop(*(f"__c_{c}" for c in low))
        return out


class MovingSampleSummary(FragmentSummary):
    """One row for each sample of a moving motion; the change of visibility joins that of its first and last row."""

    key = C.SAMPLE_ID

    def __init__(self, model: DataModel, propagated: tuple[str, ...] = (), **options) -> None:
        super().__init__(model, **options)
        self.propagated = (C.MOVING_STATE, C.MOTION_ID, C.MOTION_DURATION, *propagated)

    def required(self) -> list[str]:
        return [*super().required(), C.VISIBILITY, C.VISIBILITY_CHANGE]

    def condition(self) -> Column:
        return F.col(C.MOVING_STATE) == C.MOVE

    def extra(self, df: DataFrame) -> dict[str, Column]:
        at = F.struct(C.START, C.END)
        return {
            C.VISIBILITY: F.mean(C.VISIBILITY),
            "__from": F.min_by(C.VISIBILITY_CHANGE, at),
            "__to": F.max_by(C.VISIBILITY_CHANGE, at),
            "__rows": _in_order(C.TRAIL, C.CENTER_LAT, C.CENTER_LON),
        }

    def after(self, summary: DataFrame) -> DataFrame:
        first = F.coalesce(F.col("__from").isin(C.APPEAR, C.APPEAR_DISAPPEAR), F.lit(False))
        last = F.coalesce(F.col("__to").isin(C.DISAPPEAR, C.APPEAR_DISAPPEAR), F.lit(False))
        change = F.when(first & last, C.APPEAR_DISAPPEAR).when(first, C.APPEAR).when(last, C.DISAPPEAR)
        return summary.withColumns({C.VISIBILITY_CHANGE: change, C.TRAIL: _joined(F.col("__rows"), lambda r: F.lit(True))}).drop("__from", "__to", "__rows")


class CourseExtraction(FragmentSummary):
    """One row for each course, with its motions and pauses, and the stops before and after it; stops themselves go."""

    key = C.COURSE_ID

    def __init__(self, model: DataModel, propagated: tuple[str, ...] = (), **options) -> None:
        super().__init__(model, **options)
        self.propagated = (C.COURSE_DURATION, C.COURSE_STATE, C.COURSE_OR_STOP, C.MOVING_STATE, *propagated)

    def required(self) -> list[str]:
        return [*super().required(), C.VISIBILITY]

    def condition(self) -> Column:
        return F.col(C.COURSE_OR_STOP) != C.STOP

    def extra(self, df: DataFrame) -> dict[str, Column]:
        motion, pause = F.col(C.COURSE_STATE) == C.MOTION, F.col(C.COURSE_STATE) == C.PAUSE
        seen = F.coalesce(F.col(C.VISIBILITY) >= SEEN, F.lit(False))
        total = lambda ok, c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0))
        weight = F.sum(F.when(pause & F.col(C.VISIBILITY).isNotNull(), F.col(C.DURATION)))
        parts = (C.TRAIL, C.CENTER_LAT, C.CENTER_LON, C.COURSE_STATE, C.MOVING_STATE, C.VISIBILITY)
        return {
            "motions_visible_duration_s": total(motion & seen, C.DURATION),
            "motions_invisible_duration_s": total(motion & ~seen, C.DURATION),
            "motions_visible_length_m": total(motion & seen, C.DISTANCE).cast("double"),
            "motions_invisible_length_m": total(motion & ~seen, C.DISTANCE).cast("double"),
            "pauses_duration_s": total(pause, C.DURATION),
            "pauses_short_number": F.count_if(pause).cast("int"),
            "pauses_long_number": F.lit(0),
            "pauses_visibility_proportion": F.try_divide(F.sum(F.when(pause, F.col(C.VISIBILITY) * F.col(C.DURATION))), weight),
            "__rows": _in_order(*parts),
            # the ends of the trail on their own, so that who needs only places makes no trails
            "__from": F.min(F.when(_placed(), F.struct(C.START, C.END, *parts))),
            "__to": F.max(F.when(_placed(), F.struct(C.START, C.END, *parts))),
        }

    def after(self, summary: DataFrame) -> DataFrame:
        rows = F.col("__rows")
        motions = F.filter(rows, lambda r: r[C.COURSE_STATE] == C.MOTION)
        pauses = F.filter(rows, lambda r: r[C.COURSE_STATE] == C.PAUSE)
        share = lambda a, b: F.try_divide(F.col(a), F.col(a) + F.col(b))
        flags = F.transform(motions, lambda r: F.coalesce(r[C.VISIBILITY] >= SEEN, F.lit(False)))
        trails = F.transform(motions, lambda r: r[C.TRAIL])
        grouped = {seen: wkt.column(lambda v, t, seen=seen: wkt.grouped_trails(seen, v, t)) for seen in (True, False)}
        collected = wkt.column(lambda t: wkt.multi_line([wkt.vertices(x) for x in t or []]))
        out = summary.withColumns({
            "motion_visibility_proportion_duration": share("motions_visible_duration_s", "motions_invisible_duration_s"),
            "motion_visibility_proportion_distance": share("motions_visible_length_m", "motions_invisible_length_m"),
            "pauses_proportion": F.try_divide(F.col("pauses_duration_s"), F.col(C.COURSE_DURATION)),
            f"{C.DEPARTURE}timestamp": F.col(C.START),
            f"{C.ARRIVAL}timestamp": F.col(C.END),
            "pauses_trail": collected(F.transform(pauses, lambda r: r[C.TRAIL])),
            "pauses_location": F.transform(pauses, lambda r: F.concat_ws(",", r[C.CENTER_LAT].cast("string"), r[C.CENTER_LON].cast("string"))),
            "motions_visible_trail": grouped[True](flags, trails),
            "motions_invisible_trail": grouped[False](flags, trails),
            C.TRAIL: _joined(rows, lambda r: _along(r[C.MOVING_STATE])),
        })
        for side, end, at in ((C.DEPARTURE, "__from", 1), (C.ARRIVAL, "__to", -1)):
            row = F.col(end)
            xy = F.split(F.try_element_at(F.regexp_extract_all(row[C.TRAIL], F.lit(f"({_VERTEX})")), F.lit(at)), r"\s+")
            for i, x, centre in ((0, "lon", C.CENTER_LON), (1, "lat", C.CENTER_LAT)):
                place = F.when(_along(row[C.MOVING_STATE]), F.get(xy, F.lit(i)).try_cast("double")).otherwise(row[centre])
                # as the trail writes it: seven decimals
                out = out.withColumn(f"{side}{x}", F.round(F.bround(place.try_cast("decimal(38,18)"), 7).cast("double"), 6))
        return out.drop("__rows", "__from", "__to")

    def finish(self, df: DataFrame) -> DataFrame:
        w = W.partitionBy(self.model.id).orderBy(C.START, C.END)
        kept = {"duration_s": C.DURATION, "lon": C.CENTER_LON, "lat": C.CENTER_LAT, "visibility_proportion": C.VISIBILITY}
        if self.precision:
            kept["precision_trail"] = C.PRECISION_TRAIL
        course = F.col(C.COURSE_OR_STOP) == C.COURSE
        near = {}
        for name, move in (("stop_before", F.lag), ("stop_after", F.lead)):
            ok = course & (move(C.COURSE_OR_STOP).over(w) == C.STOP)
            near |= {f"{name}_{k}": F.when(ok, move(c).over(w)) for k, c in kept.items()}
        return df.withColumns(near).where(F.coalesce(F.col(C.COURSE_OR_STOP) != C.STOP, F.lit(True)))
