"""Enrichment by web services: addresses of places, and routes matched to trails.

Rows are sent from the executors in Arrow batches; a partition asks once for
each distinct request, of the latest ones that it remembers.  The fetcher is a parameter, so that services can be
replaced, throttled or recorded.
"""

from __future__ import annotations

import json
import logging
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .. import columns as C
from ..core import Transformer
from ..functions import wkt

Fetcher = Callable[[str], "str | None"]


class ServiceUnavailable(RuntimeError):
    """The service can't be reached at all."""


def fetch(url: str, timeout: float = 60.0, must_reach: bool = False) -> str | None:
    """The body of a GET; None on failure (logged), or an error with ``must_reach`` if the host is unknown or silent."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:
            return answer.read().decode("utf-8")
    except (TimeoutError, OSError) as error:
        reason = getattr(error, "reason", error)
        silent = isinstance(error, TimeoutError) or isinstance(reason, (TimeoutError, ConnectionError)) or type(reason).__name__ == "gaierror"
        if must_reach and silent:
            raise ServiceUnavailable(f"no answer from {url}") from error
        logging.getLogger(__name__).warning("GET %s failed: %s", url, error)
        return None


def fetch_or_fail(url: str) -> str | None:
    return fetch(url, must_reach=True)


def place_url(pattern: str, lat: float, lon: float, zoom: int) -> str:
    """``pattern`` with six decimals for ``{lat}`` and ``{lon}``, and ``{zoom}``."""
    return pattern.format(lat=f"{lat:.6f}", lon=f"{lon:.6f}", zoom=zoom)


def trail_url(pattern: str, trail: str) -> str:
    """``pattern`` with ``{points}``: latitude and longitude of each vertex."""
    return pattern.format(points="&".join(f"point={y:.6f},{x:.6f}" for x, y in wkt.vertices(trail)))


class _Remembered:
    """Answers by URL, of which the latest ``most`` requests are kept."""

    def __init__(self, ask: Callable, most: int = 50_000) -> None:
        self.ask, self.most, self.known = ask, most, {}

    def __call__(self, url: str):
        if url not in self.known:
            if len(self.known) >= self.most:
                del self.known[next(iter(self.known))]
            self.known[url] = self.ask(url)
        return self.known[url]


class Addresses(Transformer):
    """Address fields of a place, by reverse geocoding.

    Rows whose condition isn't true keep the fields they have; a failed request
    gives nulls; an unreachable service fails the job.
    """

    def __init__(self, pattern: str, lat: str, lon: str, prefix: str = "", condition: str | None = None, zoom: int = 10, fetcher: Fetcher = fetch_or_fail) -> None:
        self.pattern, self.lat, self.lon, self.prefix, self.condition, self.zoom, self.fetcher = pattern, lat, lon, prefix, condition, zoom, fetcher

    def required(self) -> list[str]:
        return [self.lat, self.lon, *([self.condition] if self.condition else [])]

    def build(self, df: DataFrame) -> DataFrame:
        pattern, lat, lon, prefix, condition, zoom, get = self.pattern, self.lat, self.lon, self.prefix, self.condition, self.zoom, self.fetcher
        new = [prefix + f for f in C.ADDRESS_FIELDS if prefix + f not in df.columns]
        schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.StringType()) for c in new)])

        def ask(url: str) -> dict:
            body = get(url)
            try:
                return (json.loads(body) if body else {}).get("address") or {}
            except ValueError:
                return {}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            answers = _Remembered(ask)
            for batch in batches:
                asked = batch[condition].to_pylist() if condition else [True] * batch.num_rows
                rows = []
                for a, b, go in zip(batch[lat].to_pylist(), batch[lon].to_pylist(), asked, strict=True):
                    known = a is not None and b is not None and a == a and b == b
                    rows.append(None if not go else answers(place_url(pattern, a, b, zoom)) if known else {})
                columns = dict(zip(batch.schema.names, batch.columns, strict=True))
                for f in C.ADDRESS_FIELDS:
                    old = columns[prefix + f].to_pylist() if prefix + f in columns else [None] * len(rows)
                    columns[prefix + f] = pa.array([o if r is None else r.get(f) for r, o in zip(rows, old, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([columns[c] for c in schema.names], names=schema.names)

        return df.mapInArrow(run, schema)


class Routes(Transformer):
    """A trail matched to roads: ``routing_trail``, ``routing_distance_m`` and ``routing_duration_s``.

    On failure, and where the condition isn't true, the trail stays and the
    others are null.
    """

    def __init__(self, pattern: str, trail: str, condition: str | None = None, fetcher: Fetcher = fetch) -> None:
        self.pattern, self.trail, self.condition, self.fetcher = pattern, trail, condition, fetcher

    def required(self) -> list[str]:
        return [self.trail, *([self.condition] if self.condition else [])]

    def build(self, df: DataFrame) -> DataFrame:
        pattern, trail, condition, get = self.pattern, self.trail, self.condition, self.fetcher
        schema = T.StructType(list(df.schema.fields)).add("routing_trail", "string").add("routing_distance_m", "double").add("routing_duration_s", "long")

        def route(url: str) -> tuple | None:
            try:
                best = json.loads(get(url) or "{}")["paths"][0]
                return wkt.line([(c[0], c[1]) for c in best["points"]["coordinates"]]), float(best["distance"]), round(best["time"] / 1000)
            except (ValueError, KeyError, IndexError, TypeError):
                return None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            answers = _Remembered(route)
            for batch in batches:
                asked = batch[condition].to_pylist() if condition else [True] * batch.num_rows
                rows = [(go and t and answers(trail_url(pattern, t))) or (t, None, None) for t, go in zip(batch[trail].to_pylist(), asked, strict=True)]
                made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

        return df.mapInArrow(run, schema)
