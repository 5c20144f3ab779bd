"""Stored tables: factor values, libraries, experiment logs, reports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD_SCHEMA = T.StructType([
    T.StructField("session_id", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("category", T.StringType()), T.StructField("template", T.StringType()),
    T.StructField("params_grid", T.MapType(T.StringType(), T.ArrayType(T.DoubleType()))),
    T.StructField("params_explored", T.LongType()), T.StructField("params_total", T.LongType()),
    T.StructField("best_params", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("exhausted", T.BooleanType()), T.StructField("parent_templates", T.ArrayType(T.StringType())),
    T.StructField("note", T.StringType()), T.StructField("evolution_note", T.StringType())])


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder.

    Only a local session, whose tasks run in the driver's own process, may do without that setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quantloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table that is used several times once, and read it back.

    Cuts the lineage with files in the shared folder, so lost executors do not recompute it.
    """
    path = f"{scratch(df.sparkSession, name)}/t"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# -- factor values ----------------------------------------------------------------------------------------
def save_factors(values: DataFrame, path: str, *, mode: str = "append") -> None:
    """``(factor, lookback, symbol, ts, value)`` in folders per factor and lookback."""
    # symbols are spread, so that a large year of one factor is several tasks and files
    (values.repartition("factor", "lookback", F.year("ts"), F.pmod(F.hash("symbol"), F.lit(16))).sortWithinPartitions("symbol", "ts")
     .write.mode(mode).partitionBy("factor", "lookback").parquet(path))


def load_factors(spark: SparkSession, path: str, factor: str, lookback: int, start=None, end=None) -> DataFrame:
    """One factor's values; folder filters prune files, time filters reach the scan."""
    x = spark.read.parquet(path).filter((F.col("factor") == factor) & (F.col("lookback") == lookback))
    if start is not None:
        x = x.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        x = x.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    return x


def has_factor(spark: SparkSession, path: str, factor: str, lookback: int) -> bool:
    """Whether values of the factor and lookback are stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/factor={factor}/lookback={lookback}")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def clear_factors(spark: SparkSession, path: str, factor: str | None = None, lookback: int | None = None) -> None:
    """Delete all stored values, those of a factor, or those of a factor and lookback."""
    folder = "/".join([path.rstrip("/"), *([f"factor={factor}"] if factor else ["factor=*"]),
                       *([f"lookback={lookback}"] if lookback is not None else [])])
    pattern = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.globStatus(pattern) or []:
        fs.delete(found.getPath(), True)


def list_factors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("factor", "lookback").distinct()


# -- logs and libraries -------------------------------------------------------------------------------------
def append_records(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All parsable lines of a JSON-lines log; broken lines are left out (see :func:`broken_records`)."""
    return _lines(spark, path).filter(F.col("_broken").isNull()).drop("_broken")


def broken_records(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).filter(F.col("_broken").isNotNull()).select("_broken")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*RECORD_SCHEMA.fields, T.StructField("_broken", T.StringType())])
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    return spark.read.text(path).select(parsed.alias("r")).select("r.*")


def save_library(library: DataFrame, path: str) -> None:
    library.write.mode("overwrite").json(path)


def load_library_folder(spark: SparkSession, path: str, schema: T.StructType, key: str = "alpha_id") -> DataFrame:
    """All JSON files of a folder; of equal keys the one from the first file name wins."""
    x = spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_name").alias("_file"))
    fields = [f.name for f in schema.fields if f.name != key]
    return x.groupBy(key).agg(F.min(F.struct("_file", *fields)).alias("_r")).select(
        key, *[F.col("_r")[f].alias(f) for f in fields])


def save_report(result: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A result table (metrics, trades, walk-forward windows) as parquet or CSV."""
    writer = result.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)
