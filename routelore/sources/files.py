"""Table files: checked reads, fixed-schema and typed writes, chunked results, and overwrite protection."""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from routelore.functions import scalars as S
from routelore.schemas import PAIRWISE_SAMPLES
from routelore.sources.nested import count_paths, path_exists

#: Partitions of a written table that a task keeps open at a time, more than there are splits.
OPEN_PARTITIONS = 4


def require_columns(df: DataFrame, required: Sequence[str], label: str) -> DataFrame:
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise ValueError(f"{label} lacks required columns: {lacking}")
    return df


def read_csv(spark: SparkSession, path: str, schema: T.StructType, required: Sequence[str] = ()) -> DataFrame:
    """CSV with header and declared schema; a missing file or required column is an error."""
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    names = spark.read.option("header", True).csv(path).columns
    lacking = [c for c in required if c not in names]
    if lacking:
        raise ValueError(f"{path} lacks required columns: {lacking}")
    fields = {f.name: f for f in schema.fields}
    full = T.StructType([fields.get(n, T.StructField(n, T.StringType())) for n in names])
    return spark.read.schema(full).option("header", True).csv(path).select(*[n for n in names if n in fields])


def read_optional_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    if not path_exists(spark, path):
        warnings.warn(f"optional input not found: {path}", stacklevel=2)
        return None
    return read_csv(spark, path, schema)


def read_columns(spark: SparkSession, folder: str, split: str, columns: Sequence[str], file_format: str = "auto") -> DataFrame:
    """Wanted columns of one split's samples; auto prefers Parquet. Only those columns are read from disk."""
    base = f"{folder}/{split}_pairwise_samples"
    chosen = file_format if file_format != "auto" else ("parquet" if path_exists(spark, f"{base}.parquet") else "csv")
    path = f"{base}.{chosen}"
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    if chosen == "parquet":
        df = spark.read.parquet(path)
    else:
        df = read_csv(spark, path, PAIRWISE_SAMPLES)
    lacking = [c for c in columns if c not in df.columns]
    if len(lacking) == len(columns):
        raise ValueError(f"{path} has none of the wanted columns")
    if lacking:
        warnings.warn(f"{path} lacks columns: {lacking}", stacklevel=2)
    return df.select(*[c for c in columns if c in df.columns])


def to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns: unknown ones dropped, missing ones null, all cast; nested leftovers as JSON."""
    nested = (T.StructType, T.ArrayType, T.MapType)

    def column(f: T.StructField):
        if f.name not in df.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        kind = df.schema[f.name].dataType
        c = F.col(f.name)
        if isinstance(kind, nested) and isinstance(f.dataType, T.StringType):
            c = S.sorted_map_json(c) if isinstance(kind, T.MapType) else F.to_json(c)
        return c.cast(f.dataType).alias(f.name)

    return df.select(*[column(f) for f in schema.fields])


def guard(spark: SparkSession, path: str, overwrite: bool) -> str:
    """Write mode for a target: an existing one is refused unless overwriting is allowed."""
    if path_exists(spark, path) and not overwrite:
        raise FileExistsError(f"{path} exists; allow overwriting to replace it")
    return "overwrite" if overwrite else "errorifexists"


def write_csv(df: DataFrame, path: str, schema: T.StructType, overwrite: bool = False) -> int:
    """Fixed-schema CSV with header; returns the number of rows written."""
    mode = guard(df.sparkSession, path, overwrite)
    counted = Observation()
    S.sanitize(to_schema(df, schema)).observe(counted, F.count(F.lit(1)).alias("rows")).write.mode(mode).option("header", True).csv(path)
    return counted.get["rows"]


@contextmanager
def open_partitions(spark: SparkSession, writers: int = OPEN_PARTITIONS) -> Iterator[None]:
    """Within it a task that writes partitioned files keeps up to ``writers`` of them open and sorts its rows only beyond that."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, "0")
    spark.conf.set(name, str(max(int(before), writers)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_samples(df: DataFrame, folder: str, compression: str = "snappy", overwrite: bool = False) -> None:
    """Typed samples, one folder per split, in the rows' own order: a sort by split would spill all of them."""
    mode = guard(df.sparkSession, folder, overwrite)
    typed = to_schema(df, PAIRWISE_SAMPLES)
    with open_partitions(df.sparkSession):
        typed.write.mode(mode).partitionBy("split").option("compression", compression).parquet(folder)


def write_splits(splits: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Split table partitioned by split: each partition is that split's id list."""
    splits.write.mode(guard(splits.sparkSession, folder, overwrite)).partitionBy("split").parquet(folder)


def write_summary(one_row: DataFrame, path: str, overwrite: bool = False) -> None:
    """One-row summary as JSON; non-finite numbers become null and are written as such."""
    mode = guard(one_row.sparkSession, path, overwrite)
    S.sanitize(one_row).write.mode(mode).option("ignoreNullFields", False).json(path)


def read_chunks(spark: SparkSession, pattern: str, schema: T.StructType, expected: int | None = None) -> DataFrame:
    """Union of chunk folders with the folder's name as ``chunk``; optionally their number is checked."""
    found = count_paths(spark, pattern)
    if expected is not None and found != expected:
        raise ValueError(f"expected {expected} chunks, found {found}")
    return spark.read.schema(schema).parquet(pattern).withColumn(
        "chunk", F.element_at(F.split(F.input_file_name(), "/"), -2)
    )
