"""Reading and writing: projected scans, JSON lines, CSV, partitioned checkpoints, side tables, parameters, models."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import RAW, RETAIL


def scan(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def scan_json_lines(spark: SparkSession, path: str, schema: T.StructType = RAW, partitions: int | None = None) -> DataFrame:
    """JSON lines by a declared schema. A gzip file is one task, so its rows are dealt out at once if asked for."""
    df = spark.read.schema(schema).json(path)
    return df.repartition(partitions) if partitions else df


def scan_csv(spark: SparkSession, path: str, columns: list[str] | None = None, schema: T.StructType = RETAIL, multi_line: bool = False) -> DataFrame:
    """A CSV with quotes doubled inside quotes. ``multi_line`` reads line breaks inside values, but each file in one task."""
    df = spark.read.csv(path, schema=schema, header=True, multiLine=multi_line, quote='"', escape='"')
    return df.select(*columns) if columns else df


def convert(spark: SparkSession, source: str, target: str, schema: T.StructType = RAW, rows_a_file: int = 100_000) -> None:
    """JSON lines to Parquet files of at most ``rows_a_file`` rows."""
    scan_json_lines(spark, source, schema).write.option("maxRecordsPerFile", rows_a_file).mode("overwrite").parquet(target)


def checkpoint(df: DataFrame, path: str, by: str = "main_cat") -> int:
    """Overwrites ``path`` with the rows partitioned by a column, and tells the number of its files.

    Rows of a value meet in as few files as AQE's partitions allow; a hot value is split by the rebalance.
    """
    df.hint("rebalance", by).write.mode("overwrite").partitionBy(by).parquet(path)
    return len(df.sparkSession.read.parquet(path).inputFiles())  # from the listing, without reading a row


def read_checkpoint(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A partitioned table with its partition values as they were written: ``007`` stays a string."""
    return spark.read.schema(schema).parquet(path)


def write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def save_cache(series: DataFrame, path: str) -> None:
    """A two-column side table (key, value)."""
    series.write.mode("overwrite").parquet(path)


def _file(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def save_parameters(spark: SparkSession, values: list, path: str) -> None:
    """A parameter list as a JSON file, wherever Hadoop's file systems reach it; it is a parameter, not data."""
    fs, p = _file(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(values, ensure_ascii=False).encode()))
    out.close()


def load_parameters(spark: SparkSession, path: str) -> list:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def remove(spark: SparkSession, path: str) -> bool:
    """Deletes a checkpoint, wherever Hadoop's file systems reach it."""
    fs, p = _file(spark, path)
    return fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file(spark, path)
    return fs.exists(p)


def rename_retail(df: DataFrame) -> DataFrame:
    """The retail file's columns under the names of the other tables: lower case, without blanks."""
    names = {"Product Name": "title"}
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c.lower().replace(" ", "_"))) for c in df.columns])
