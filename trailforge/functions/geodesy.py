"""Geodesics on WGS84 as staged SQL expressions (Vincenty's inverse method).

Each stage refers to the columns of those before it, so that no expression is
repeated; Catalyst keeps the stages apart where joining them would compute
something twice.  Five rounds settle legs of everyday length to well below a
micrometre; nearly antipodal pairs don't converge and are out of scope.  The
stages are plain SQL that other engines run unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXIS = 6378137.0
FLATTENING = 1 / 298.257223563
MINOR = AXIS * (1 - FLATTENING)
ROUNDS = 5


def stages(lat1: str, lon1: str, lat2: str, lon2: str, distance: str | None, bearing: str | None) -> list[dict[str, str]]:
    """Layers of ``{column: expression}``; helper columns start with ``__g``."""
    f = repr(FLATTENING)
    out = [
        {"__gl": f"radians({lon2} - {lon1})", "__gu": f"atan((1 - {f}) * tan(radians({lat1})))", "__gv": f"atan((1 - {f}) * tan(radians({lat2})))"},
        {"__gsu": "sin(__gu)", "__gcu": "cos(__gu)", "__gsv": "sin(__gv)", "__gcv": "cos(__gv)", "__gx0": "__gl"},
    ]
    for k in range(ROUNDS):
        x = f"__gx{k}"
        out += [
            {"__gsx": f"sin({x})", "__gcx": f"cos({x})"},
            {"__gss": "sqrt((__gcv * __gsx) * (__gcv * __gsx) + (__gcu * __gsv - __gsu * __gcv * __gcx) * (__gcu * __gsv - __gsu * __gcv * __gcx))", "__gcs": "__gsu * __gsv + __gcu * __gcv * __gcx"},
            {"__gs": "atan2(__gss, __gcs)", "__gsa": "CASE WHEN __gss = 0 THEN 0.0e0 ELSE __gcu * __gcv * __gsx / __gss END"},
            {"__gca": "1 - __gsa * __gsa"},
            {"__gcm": "CASE WHEN __gca <= 0 THEN 0.0e0 ELSE __gcs - 2 * __gsu * __gsv / __gca END", "__gc": f"{f} / 16 * __gca * (4 + {f} * (4 - 3 * __gca))"},
            {f"__gx{k + 1}": f"__gl + (1 - __gc) * {f} * __gsa * (__gs + __gc * __gss * (__gcm + __gc * __gcs * (2 * __gcm * __gcm - 1)))"},
        ]
    if distance:
        ratio = repr((AXIS**2 - MINOR**2) / MINOR**2)
        out += [
            {"__gq": f"__gca * {ratio}"},
            {"__ga": "1 + __gq / 16384 * (4096 + __gq * (__gq * (320 - 175 * __gq) - 768))", "__gb": "__gq / 1024 * (256 + __gq * (__gq * (74 - 47 * __gq) - 128))"},
            {"__gd": "__gb * __gss * (__gcm + __gb / 4 * (__gcs * (2 * __gcm * __gcm - 1) - __gb / 6 * __gcm * (4 * __gss * __gss - 3) * (4 * __gcm * __gcm - 3)))"},
            {distance: f"{MINOR!r} * __ga * (__gs - __gd)"},
        ]
    if bearing:
        x = f"__gx{ROUNDS}"
        out += [
            {"__gt": f"degrees(atan2(__gcv * sin({x}), __gcu * __gsv - __gsu * __gcv * cos({x})))"},
            {bearing: "CASE WHEN __gt < 0 THEN __gt + 360 ELSE __gt END"},
        ]
    return out


def with_geodesic(df: DataFrame, lat1: str, lon1: str, lat2: str, lon2: str, distance: str | None = None, bearing: str | None = None) -> DataFrame:
    """``df`` with the length (m) and the initial bearing (0 to 360) from the first point to the second; null for null points."""
    keep = df.columns + [c for c in (distance, bearing) if c and c not in df.columns]
    for layer in stages(lat1, lon1, lat2, lon2, distance, bearing):
        df = df.withColumns({k: F.expr(v) for k, v in layer.items()})
    return df.select(*(f"`{c}`" for c in keep))


def sql(source: str, lat1: str, lon1: str, lat2: str, lon2: str, distance: str | None = None, bearing: str | None = None) -> str:
    """The same over a subquery, as SQL text with the helper columns left in."""
    for i, layer in enumerate(stages(lat1, lon1, lat2, lon2, distance, bearing)):
        made = ", ".join(f"{v} AS {k}" for k, v in layer.items())
        again = [k for k in layer if k in ("__gsx", "__gcx", "__gss", "__gcs", "__gs", "__gsa", "__gca", "__gcm", "__gc") and i > 7]
        rest = f"* EXCLUDE ({', '.join(again)})" if again else "*"
        source = f"(SELECT {rest}, {made} FROM {source})"
    return source
