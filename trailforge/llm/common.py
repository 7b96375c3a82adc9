"""Shared storage for intermediate tables, and small helpers of the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Where none is named, a temporary one does in local mode; a cluster's
    executors share the warehouse, so a folder in it is taken there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        local = spark.sparkContext.master.split("[")[0] == "local"
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="trailforge-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate")
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


_FOLDERS: set[str] = set()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    Cuts the lineage: executors that are lost later cost no recomputation of
    what lies before, and no part of the plan above runs twice.  Tables live as
    long as the application, whose folder is deleted when the driver ends.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    path = f"{folder}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_RESIDENT: dict = {}


def resident(key, make: Callable):
    """What a worker holds for ``key``; it holds one thing at a time, as workers outlive the stages that they serve."""
    if key not in _RESIDENT:
        if _RESIDENT:
            _RESIDENT.clear()
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):  # not with every C library
                ctypes.CDLL(None).malloc_trim(0)
        _RESIDENT[key] = make()
    return _RESIDENT[key]


_NO_ID = -(1 << 63)


def held_id(docs: DataFrame, name: str) -> Column:
    """The id column as ``doc_id``; a null integer travels as the least long, as pandas would turn a batch with nulls into doubles."""
    whole = docs.schema[name].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    return (F.coalesce(F.col(name).cast("bigint"), F.lit(_NO_ID)) if whole else F.col(name)).alias("doc_id")


def freed_id(df: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """``df`` with the ids that ``held_id`` held, in the type they had."""
    kind = docs.schema[name].dataType
    if df.schema["doc_id"].dataType.simpleString() != "bigint":
        return df
    return df.withColumn("doc_id", F.nullif("doc_id", F.lit(_NO_ID)).cast(kind))


def id_kind(docs: DataFrame, name: str) -> str:
    """The type in which ids travel."""
    kind = docs.schema[name].dataType.simpleString()
    return "bigint" if kind in ("tinyint", "smallint", "int") else kind


def whole_text(name: str = "text") -> Column:
    """The text, null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def split_frames(batches: Iterator[pd.DataFrame], text: str = "text", chars: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Cut Arrow batches into frames of about ``chars`` characters, so that long documents don't add up in memory."""
    for pdf in batches:
        if not len(pdf):
            continue
        group = (pdf[text].str.len().cumsum() // chars).to_numpy()
        if group[-1] == 0:
            yield pdf
        else:
            for _, part in pdf.groupby(group, sort=True):
                yield part


def sql_type(docs: DataFrame, name: str) -> str:
    return docs.schema[name].dataType.simpleString()


def row_slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches of about ``size`` bytes of text each, without a copy."""
    for batch in batches:
        if not batch.num_rows:
            continue
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        group = (upto - 1) // size
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def with_columns(docs: DataFrame, text_col: str, new: dict[str, str], make: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """``docs``, all columns, with those of ``new`` (name: type), which ``make`` gives for slices of the texts; older ones of these names go."""
    held = docs.drop(*(x for x in new if x != text_col))
    added = [x for x in new if x != text_col]
    schema = T.StructType([*held.schema.fields, *(T.StructField(x, T._parse_datatype_string(new[x])) for x in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, text_col):
            made = dict(zip(new, make(batch[text_col]), strict=True))
            columns = [made.get(x, c) if x == text_col else c for x, c in zip(batch.schema.names, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, *(made[x] for x in added)], names=[*batch.schema.names, *added])

    return held.mapInArrow(run, schema)
