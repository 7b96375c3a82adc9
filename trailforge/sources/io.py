"""Readers and writers of tables, and filters on periods."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import columns as C
from ..model import DataModel, Period

BLOCK = 256 * 1024 * 1024


def read_csv(spark: SparkSession, *paths: str, delimiter: str = ";", header: bool = True, schema: T.StructType | None = None) -> DataFrame:
    """CSV files; all columns are texts unless a schema is given."""
    reader = spark.read.option("sep", delimiter).option("header", header)
    return (reader.schema(schema) if schema else reader).csv(list(paths))


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_cassandra(spark: SparkSession, table: str) -> DataFrame:
    """``keyspace.table`` through the Cassandra connector, which must be on the class path."""
    keyspace, name = table.split(".", 1)
    return spark.read.format("org.apache.spark.sql.cassandra").options(keyspace=keyspace, table=name).load()


def write_parquet(df: DataFrame, path: str, mode: str = "append", partition: str = C.PARTITION, files_per_day: int = 1) -> None:
    """Parquet by day; ``files_per_day`` spreads each day over so many tasks, so that a hot day isn't one."""
    salt = [F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns if c != partition)), F.lit(files_per_day))] if files_per_day > 1 else []
    dealt = df.repartition(partition, *salt)
    dealt.write.mode(mode).option("compression", "snappy").option("parquet.block.size", BLOCK).partitionBy(partition).parquet(path)


def with_array_texts(df: DataFrame) -> DataFrame:
    """Array columns as ``[a,b]``; a null array is ``[]``."""
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    text = lambda c: F.concat(F.lit("["), F.concat_ws(",", F.col(c).cast("array<string>")), F.lit("]"))
    return df.withColumns({c: text(c) for c in arrays}) if arrays else df


def write_csv(df: DataFrame, path: str, delimiter: str = ";", single_file: bool = True, mode: str = "overwrite") -> None:
    """CSV with a header; one file only where asked for, as it is written by one task."""
    out = with_array_texts(df)
    (out.coalesce(1) if single_file else out).write.mode(mode).option("sep", delimiter).option("header", True).csv(path)


def with_document_id(df: DataFrame, model: DataModel, timestamp: str = C.TIMESTAMP) -> DataFrame:
    """``doc_key`` (``<object>#<time>``) and ``location`` (``lat,lon``) for a document store."""
    text = lambda c: F.col(c).cast("string")
    return df.withColumns({"location": F.concat(text(model.lat), F.lit(","), text(model.lon)), "doc_key": F.concat(text(model.id), F.lit("#"), text(timestamp))})


def write_documents(df: DataFrame, target: str, id_column: str = "doc_key", excluded: tuple[str, ...] = (), index_column: str | None = None, sink: str = "es", mode: str = "append") -> None:
    """To a document store's connector; with ``index_column`` the target's ``{}`` is filled by that column in each row."""
    resource = target.replace("{}", "{" + index_column + "}") if index_column else target
    options = {"es.mapping.id": id_column} | ({"es.mapping.exclude": ",".join(excluded)} if excluded else {})
    df.write.format(sink).options(**options).mode(mode).save(resource)


def _seconds(at: datetime) -> int:
    return int(at.timestamp())


def _day(at: datetime, beside: int) -> int:
    """The day beside that of ``at``: days of partitions are those of a session's zone, so the bound leaves room for any."""
    return int((at.astimezone(timezone.utc) + timedelta(days=beside)).strftime("%Y%m%d"))


def from_start(df: DataFrame, start: datetime | None, timestamp: str = C.TIMESTAMP, partition: str = C.PARTITION) -> DataFrame:
    """Rows at or after ``start``, by day (which prunes partitions) and second."""
    return df if start is None else df.where((F.col(partition) >= _day(start, -1)) & (F.col(timestamp) >= _seconds(start)))


def until_stop(df: DataFrame, stop: datetime | None, timestamp: str = C.TIMESTAMP, partition: str = C.PARTITION) -> DataFrame:
    return df if stop is None else df.where((F.col(partition) <= _day(stop, 1)) & (F.col(timestamp) <= _seconds(stop)))


def within(df: DataFrame, period: Period, timestamp: str = C.TIMESTAMP, partition: str = C.PARTITION) -> DataFrame:
    """Rows of a closed period; an open end doesn't filter."""
    return until_stop(from_start(df, period.start, timestamp, partition), period.stop, timestamp, partition)
