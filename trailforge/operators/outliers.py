"""Outliers: local medians, propagation to what they enclose, geometry to keep, removal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import columns as C
from ..core import Transformer
from ..model import DataModel


class WithoutOutliers(Transformer):
    """Rows whose flag is false (null goes), without the flag."""

    def __init__(self, flag: str) -> None:
        self.flag = flag

    def required(self) -> list[str]:
        return [self.flag]

    def build(self, df: DataFrame) -> DataFrame:
        return df.where(~F.col(self.flag)).drop(self.flag)


class LocalOutliers(Transformer):
    """Flags rows that exceed a local median by more than a threshold in any of some columns.

    The median of a whole frame of ``2h + 1`` rows is its element ``h``; frames
    cut at an end use element ``h // 2``.  With ``keep_innovation`` the excess
    over the median stays in ``<column>_innovation``.
    """

    def __init__(self, id: str, flag: str, columns: list[str], half: int, threshold: float, keep_innovation: bool = False, order: str = C.TIMESTAMP) -> None:
        self.id, self.flag, self.columns, self.half, self.threshold, self.keep, self.order = id, flag, columns, half, threshold, keep_innovation, order

    def required(self) -> list[str]:
        return [self.id, self.order, *self.columns]

    def build(self, df: DataFrame) -> DataFrame:
        w = W.partitionBy(self.id).orderBy(self.order).rowsBetween(-self.half, self.half)
        frames = df.withColumns({f"__f_{c}": F.array_sort(F.collect_list(c).over(w)) for c in self.columns})

        def innovation(c: str) -> Column:
            frame = F.col(f"__f_{c}")
            whole = F.size(frame) == 2 * self.half + 1
            return F.col(c) - F.get(frame, F.when(whole, self.half).otherwise(self.half // 2))

        out = frames.withColumns({f"{c}_innovation": innovation(c) for c in self.columns})
        beyond = reduce(Column.__or__, (F.coalesce(F.col(f"{c}_innovation") > self.threshold, F.lit(False)) for c in self.columns))
        out = out.withColumn(self.flag, beyond).drop(*(f"__f_{c}" for c in self.columns))
        return out if self.keep else out.drop(*(f"{c}_innovation" for c in self.columns))


class PropagatedOutliers(Transformer):
    """Also flags rows enclosed by outliers, and moves the flag off the row on which an object returns.

    A row is enclosed if one of the three rows before and one of the three
    after are flagged (rows beyond an end count as flagged).
    """

    def __init__(self, id: str, flag: str, order: str = C.TIMESTAMP) -> None:
        self.id, self.flag, self.order = id, flag, order

    def required(self) -> list[str]:
        return [self.id, self.order, self.flag]

    def build(self, df: DataFrame) -> DataFrame:
        w, flag = W.partitionBy(self.id).orderBy(self.order), F.col(self.flag)
        near = lambda move: reduce(Column.__or__, (move(self.flag, k, True).over(w) for k in (1, 2, 3)))
        step = df.withColumn("__all", flag | (~flag & near(F.lead) & near(F.lag)))
        step = step.withColumn("__return", F.col("__all") & ~F.lead("__all", 1, True).over(w))
        moved = (F.col("__all") & ~F.col("__return")) | F.lead("__return", 1, False).over(w)
        return step.withColumn(self.flag, moved).drop("__all", "__return")


class OutlierGeometry(Transformer):
    """Only outliers, with the line through their neighbours (null at an end) and their point (null for the first row)."""

    def __init__(self, model: DataModel, flag: str, trail: str, location: str, order: str = C.TIMESTAMP) -> None:
        self.model, self.flag, self.trail, self.location, self.order = model, flag, trail, location, order

    def required(self) -> list[str]:
        m = self.model
        return [m.id, m.lat, m.lon, self.order, self.flag]

    def build(self, df: DataFrame) -> DataFrame:
        m, w = self.model, W.partitionBy(self.model.id).orderBy(self.order)
        here = F.concat(F.col(m.lon).cast("string"), F.lit(" "), F.col(m.lat).cast("string"))
        out = df.withColumn("__at", here).withColumns({"__before": F.lag("__at").over(w), "__after": F.lead("__at").over(w)})
        line = F.concat(F.lit("LINESTRING ("), "__before", F.lit(", "), "__at", F.lit(", "), "__after", F.lit(")"))
        point = F.when(F.col("__before").isNotNull(), F.concat(F.lit("POINT ("), "__at", F.lit(")")))
        return out.withColumns({self.trail: line, self.location: point}).where(F.col(self.flag)).drop("__at", "__before", "__after")
