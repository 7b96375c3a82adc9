"""The data model of observations, periods and hidden Markov models."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class DataModel:
    """Which columns hold the object, the time and the place, and how times are written."""

    id: str = "id"
    timestamp: str = "timestamp"
    lat: str = "lat"
    lon: str = "lon"
    time_format: str = "yyyy-MM-dd'T'HH:mm:ssXXX"


@dataclass(frozen=True)
class Period:
    """A closed period; an open end is None."""

    start: datetime | None = None
    stop: datetime | None = None


def period(start: str, stop: str) -> Period:
    """A period from two ISO texts with an offset."""
    return Period(datetime.fromisoformat(start), datetime.fromisoformat(stop))


@dataclass(frozen=True)
class HmmModel:
    """A hidden Markov model over binned scalars: ``k`` edges make ``k + 1`` bins."""

    states: tuple[str, ...]
    edges: tuple[float, ...]
    emission: dict[str, tuple[float, ...]] = field(hash=False)
    transition: dict[str, dict[str, float]] = field(hash=False)
    initial: dict[str, float] = field(hash=False)

    @classmethod
    def parse(cls, text: str) -> HmmModel:
        raw = json.loads(text)
        emission = {s: tuple(map(float, v)) for s, v in raw["emission_probability"].items()}
        return cls(tuple(raw["states"]), tuple(map(float, raw["bin_edges"])), emission, raw["transition_probability"], raw["init_probability"])

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> HmmModel:
        """From a JSON file that Spark can read; a missing one is an error that names it."""
        try:
            return cls.parse(spark.read.text(path, wholetext=True).first()[0])
        except Exception as error:
            raise FileNotFoundError(f"HMM model not found: {path}") from error
