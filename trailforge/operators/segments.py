"""Window operators over the rows of one object: durations, ids of runs, samples, visibility, static values.

Windows of one object are ordered by time and then by every remaining column
that a caller names, so results don't hang on ties.  All windows of a
transformer share their partitioning, hence one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import columns as C
from ..core import Transformer
from ..functions import geodesy
from ..model import DataModel

_ALL = (W.unboundedPreceding, W.unboundedFollowing)
_SO_FAR = (W.unboundedPreceding, W.currentRow)


class DurationSincePrevious(Transformer):
    """Seconds since the object's previous row; null for the first."""

    def __init__(self, id: str = "id", timestamp: str = C.TIMESTAMP, target: str = C.DURATION) -> None:
        self.id, self.timestamp, self.target = id, timestamp, target

    def required(self) -> list[str]:
        return [self.id, self.timestamp]

    def build(self, df: DataFrame) -> DataFrame:
        w = W.partitionBy(self.id).orderBy(self.timestamp)
        return df.withColumn(self.target, F.col(self.timestamp) - F.lag(self.timestamp).over(w))


class GeodesicDistance(Transformer):
    """Metres from the object's previous place; null for the first."""

    def __init__(self, model: DataModel, target: str = C.DISTANCE, timestamp: str = C.TIMESTAMP) -> None:
        self.model, self.target, self.timestamp = model, target, timestamp

    def required(self) -> list[str]:
        return [self.model.id, self.model.lat, self.model.lon, self.timestamp]

    def build(self, df: DataFrame) -> DataFrame:
        m, w = self.model, W.partitionBy(self.model.id).orderBy(self.timestamp)
        before = df.withColumns({"__lat": F.lag(m.lat).over(w), "__lon": F.lag(m.lon).over(w)})
        return geodesy.with_geodesic(before, "__lat", "__lon", m.lat, m.lon, self.target).drop("__lat", "__lon")


class DurationOfId(Transformer):
    """Seconds from the first start to the last end of all rows with an id."""

    def __init__(self, id: str, target: str, start: str = C.START, end: str = C.END) -> None:
        self.id, self.target, self.start, self.end = id, target, start, end

    def required(self) -> list[str]:
        return [self.id, self.start, self.end]

    def build(self, df: DataFrame) -> DataFrame:
        w = W.partitionBy(self.id).orderBy(self.start, self.end).rowsBetween(*_ALL)
        return df.withColumn(self.target, F.last(self.end).over(w) - F.first(self.start).over(w))


class RenewedId(Transformer):
    """The id of a run, made anew from its object, first start and last end."""

    def __init__(self, model: DataModel, id: str, start: str = C.START, end: str = C.END) -> None:
        self.model, self.id, self.start, self.end = model, id, start, end

    def required(self) -> list[str]:
        return [self.model.id, self.id, self.start, self.end]

    def build(self, df: DataFrame) -> DataFrame:
        w = W.partitionBy(self.id).orderBy(self.start, self.end).rowsBetween(*_ALL)
        ends = F.concat(F.first(self.start).over(w).cast("string"), F.lit("_"), F.last(self.end).over(w).cast("string"))
        return df.withColumn(self.id, F.when(F.col(self.id).isNotNull(), F.concat(F.col(self.model.id), F.lit("#"), ends)))


class RunId(Transformer):
    """``<object>#<order>`` of the last row that begins a run; null before the first."""

    def __init__(self, id: str, order: str, target: str) -> None:
        self.id, self.order, self.target = id, order, target

    def begins(self, w) -> Column:
        raise NotImplementedError

    def required(self) -> list[str]:
        return [self.id, self.order]

    def build(self, df: DataFrame) -> DataFrame:
        w = W.partitionBy(self.id).orderBy(self.order)
        marked = df.withColumn("__begin", F.when(self.begins(w), F.concat(F.col(self.id), F.lit("#"), F.col(self.order).cast("string"))))
        return marked.withColumn(self.target, F.last("__begin", ignorenulls=True).over(w.rowsBetween(*_SO_FAR))).drop("__begin")


class RunFromCondition(RunId):
    """A run begins where a given condition holds."""

    def __init__(self, id: str, order: str, target: str, condition: Column) -> None:
        super().__init__(id, order, target)
        self.condition = condition

    def begins(self, w) -> Column:
        return self.condition


class RunFromState(RunId):
    """A run begins at every row in a state."""

    def __init__(self, id: str, state: str, order: str, begin: str, target: str) -> None:
        super().__init__(id, order, target)
        self.state, self.begin = state, begin

    def required(self) -> list[str]:
        return [self.id, self.order, self.state]

    def begins(self, w) -> Column:
        return F.col(self.state) == self.begin


class RunOnChange(RunId):
    """A run begins where the state changes, after a null state, and at every row in the unique state; a null state goes on."""

    def __init__(self, id: str, state: str, order: str, target: str, unique: str | None = None) -> None:
        super().__init__(id, order, target)
        self.state, self.unique = state, unique

    def required(self) -> list[str]:
        return [self.id, self.order, self.state]

    def begins(self, w) -> Column:
        before = F.lag(self.state).over(w)
        begin = before.isNull() | (F.col(self.state) != before)
        return begin | (F.col(self.state) == self.unique) if self.unique is not None else begin


class SampleId(Transformer):
    """``<group>_<n>``: samples of about so many seconds within a group, a long row staying whole."""

    def __init__(self, group: str, sampling: int, target: str = C.SAMPLE_ID, duration: str = C.DURATION, order: str = C.CENTER) -> None:
        self.group, self.sampling, self.target, self.duration, self.order = group, sampling, target, duration, order

    def required(self) -> list[str]:
        return [self.group, self.duration, self.order]

    def build(self, df: DataFrame) -> DataFrame:
        w = W.partitionBy(self.group).orderBy(self.order).rowsBetween(*_SO_FAR)
        step = lambda seconds: F.floor((seconds - 1) / self.sampling)
        index = step(F.sum(self.duration).over(w)) - step(F.col(self.duration))
        return df.withColumn(self.target, F.concat(F.col(self.group), F.lit("_"), index.cast("string")))


class VisibilityChange(Transformer):
    """How visible rows border on invisible ones: ``appear``, ``disappear``, both, or null."""

    def __init__(self, id: str = "id", timestamp: str = C.TIMESTAMP, target: str = C.VISIBILITY_CHANGE, proportion: str = C.VISIBILITY) -> None:
        self.id, self.timestamp, self.target, self.proportion = id, timestamp, target, proportion

    def required(self) -> list[str]:
        return [self.id, self.timestamp, self.proportion]

    def build(self, df: DataFrame) -> DataFrame:
        w = W.partitionBy(self.id).orderBy(self.timestamp)
        hidden = F.coalesce(F.col(self.proportion) == 0, F.lit(False))
        flags = df.withColumn("__h", hidden).withColumns({"__p": F.lag("__h", 1, False).over(w), "__n": F.lead("__h", 1, False).over(w)})
        change = F.when(F.col("__h"), None).when(F.col("__p") & F.col("__n"), C.APPEAR_DISAPPEAR).when(F.col("__p"), C.APPEAR).when(F.col("__n"), C.DISAPPEAR)
        return flags.withColumn(self.target, change).drop("__h", "__p", "__n")


class VisibilityFromTempo(Transformer):
    """Invisible in the irregular tempo, visible in others, with the change of it."""

    def __init__(self, id: str = "id", timestamp: str = C.TIMESTAMP, tempo: str = C.TEMPO, irregular: str = C.IRREGULAR) -> None:
        self.id, self.timestamp, self.tempo, self.irregular = id, timestamp, tempo, irregular

    def required(self) -> list[str]:
        return [self.id, self.timestamp, self.tempo]

    def build(self, df: DataFrame) -> DataFrame:
        seen = df.withColumn(C.VISIBILITY, F.when(F.col(self.tempo) == self.irregular, 0.0).otherwise(1.0))
        return VisibilityChange(self.id, self.timestamp).transform(seen)


class StaticValues(Transformer):
    """Columns that don't change for an object: its first value that isn't null or undefined, else a default.

    ``values`` maps a column to ``(default, undefined values)``; with ``order``
    the first is that of the least order, else the least value.
    """

    def __init__(self, id: str, values: dict[str, tuple], order: str | None = None) -> None:
        self.id, self.values, self.order = id, values, order

    def required(self) -> list[str]:
        return [self.id, *self.values]

    def build(self, df: DataFrame) -> DataFrame:
        def known(c: str, undefined) -> Column:
            return F.when(~F.col(c).isin(list(undefined)), F.col(c)) if len(undefined) else F.col(c)

        cleaned = df.withColumns({c: known(c, u) for c, (_, u) in self.values.items()})
        w = W.partitionBy(self.id)
        if self.order is None:
            first = {c: F.min(c).over(w) for c in self.values}
        else:
            ordered = w.orderBy(self.order).rowsBetween(*_ALL)
            first = {c: F.first(c, ignorenulls=True).over(ordered) for c in self.values}
        return cleaned.withColumns({c: F.coalesce(v, F.lit(self.values[c][0])) for c, v in first.items()})
