"""Missions: courses of an object, for as long as they lead away from where it set out."""

from __future__ import annotations

from collections.abc import Iterator
from math import atan, atan2, cos, radians, sin, sqrt, tan

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import columns as C
from ..core import Transformer
from ..functions import geodesy
from ..model import DataModel

_ADDRESS = [f"{side}{f}" for side in (C.DEPARTURE, C.ARRIVAL) for f in C.ADDRESS_FIELDS]


def inverse(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """Metres between two places (Vincenty, as in ``geodesy``)."""
    f = geodesy.FLATTENING
    u, v, lam0 = atan((1 - f) * tan(radians(lat1))), atan((1 - f) * tan(radians(lat2))), radians(lon2 - lon1)
    su, cu, sv, cv = sin(u), cos(u), sin(v), cos(v)
    lam = lam0
    for _ in range(geodesy.ROUNDS):
        sl, cl = sin(lam), cos(lam)
        ss = sqrt((cv * sl) ** 2 + (cu * sv - su * cv * cl) ** 2)
        if ss == 0:
            return 0.0
        cs = su * sv + cu * cv * cl
        s, sa = atan2(ss, cs), cu * cv * sl / ss
        ca = 1 - sa * sa
        cm = cs - 2 * su * sv / ca if ca > 0 else 0.0
        c = f / 16 * ca * (4 + f * (4 - 3 * ca))
        lam = lam0 + (1 - c) * f * sa * (s + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
    q = ca * (geodesy.AXIS**2 - geodesy.MINOR**2) / geodesy.MINOR**2
    a, b = 1 + q / 16384 * (4096 + q * (q * (320 - 175 * q) - 768)), q / 1024 * (256 + q * (q * (74 - 47 * q) - 128))
    d = b * ss * (cm + b / 4 * (cs * (2 * cm * cm - 1) - b / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
    return geodesy.MINOR * a * (s - d)


class Missions(Transformer):
    """Tags each course with its mission: a new one begins at the course that ends nearer the departure than the one before.

    The mission's anchor hangs on all earlier rows of the object, so each object
    is read once, in order, by one task; only the anchor, two numbers and a
    counter are kept (rows stream through a sorted partition, once).  Metrics
    of missions are windows over object and mission.
    """

    def __init__(self, model: DataModel, sensor_distance: str, gps_distance: str) -> None:
        self.model, self.sensor, self.gps = model, sensor_distance, gps_distance

    def required(self) -> list[str]:
        places = [f"{side}{x}" for side in (C.DEPARTURE, C.ARRIVAL) for x in ("lat", "lon")]
        return [self.model.id, C.START, C.END, self.sensor, self.gps, C.COURSE_DURATION, *places, *_ADDRESS]

    def build(self, df: DataFrame) -> DataFrame:
        oid = self.model.id

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            same = anchor = None
            last, number = 0.0, 0
            for batch in batches:
                numbers, distances = [], []
                places = (batch[c].to_numpy(zero_copy_only=False).astype(float).tolist() for c in (f"{C.DEPARTURE}lat", f"{C.DEPARTURE}lon", f"{C.ARRIVAL}lat", f"{C.ARRIVAL}lon"))
                for o, dlat, dlon, alat, alon in zip(batch[oid].to_pylist(), *places, strict=True):
                    if same is None or o != same[0]:
                        same, anchor, last, number = (o,), (dlat, dlon), 0.0, 0
                    d = inverse(*anchor, alat, alon)
                    if d < last:
                        anchor, number = (dlat, dlon), number + 1
                        d = inverse(*anchor, alat, alon)
                    last = d
                    numbers.append(number)
                    distances.append(d)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64()), pa.array(distances, pa.float64())], names=[*batch.schema.names, "__mission", "__away"])

        schema = T.StructType(list(df.schema.fields)).add("__mission", "long").add("__away", "double")
        folded = df.repartition(oid).sortWithinPartitions(oid, C.START, C.END).mapInArrow(fold, schema)
        at = F.struct(C.START, C.END)
        m, w = C.MISSION, W.partitionBy(oid, "__mission")
        metrics = {
            f"{m}duration_s": F.sum(C.COURSE_DURATION),
            f"{m}sensor_distance_m": F.sum(self.sensor),
            f"{m}gps_distance_m": F.sum(self.gps),
            f"{m}straight_line_m": F.max_by("__away", at),
            f"{m}{C.DEPARTURE}timestamp": F.min(C.START),
            f"{m}{C.ARRIVAL}timestamp": F.max(C.END),
            **{f"{m}{C.DEPARTURE}{x}": F.min_by(f"{C.DEPARTURE}{x}", at) for x in ("lat", "lon", *C.ADDRESS_FIELDS)},
            **{f"{m}{C.ARRIVAL}{x}": F.max_by(f"{C.ARRIVAL}{x}", at) for x in ("lat", "lon", *C.ADDRESS_FIELDS)},
        }
        missions = folded.withColumns({k: v.over(w) for k, v in metrics.items()})
        line, gps = F.col(f"{m}straight_line_m"), F.col(f"{m}gps_distance_m")
        ends = F.concat(F.col(f"{m}{C.DEPARTURE}timestamp").cast("string"), F.lit("_"), F.col(f"{m}{C.ARRIVAL}timestamp").cast("string"))
        missions = missions.withColumns({f"{m}straightness": F.when((line == 0) | (gps == 0), 0.0).otherwise(F.try_divide(line, gps)), f"{m}id": F.concat(F.col(oid), F.lit("#"), ends)})
        return missions.drop("__mission", "__away")
