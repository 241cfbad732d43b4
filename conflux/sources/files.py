"""Tables and relations in files, read whole or as a stream of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from conflux.functions.columns import checked_cast


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``<folder>/<name>.parquet``, one file or a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_stream(
    spark: SparkSession,
    folder: str,
    name: str,
    max_files: int | None = None,
    row_id: str | None = None,
) -> DataFrame:
    """The same table as a stream of its files."""
    # A path with a pattern may stand for a file as well as for a folder; [x] matches just x.
    path = f"{folder}/[{name[0]}]{name[1:]}.parquet"
    return file_stream(spark, path, table(spark, folder, name).schema, max_files=max_files, row_id=row_id)


def file_stream(
    spark: SparkSession,
    path: str,
    schema: StructType,
    format: str = "parquet",
    max_files: int | None = None,
    row_id: str | None = None,
    **options: str,
) -> DataFrame:
    """A stream of the files in a folder, at most ``max_files`` of them per micro-batch.

    ``row_id`` names a column to add that numbers the rows by file and position (Parquet only): it
    tells copies of a row apart and is the same each time the file is read.
    """
    reader = spark.readStream.format(format).schema(schema).options(**options)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    df = reader.load(path)
    if row_id:
        where = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
        df = df.select("*", where.alias(row_id))
    return df


def delimited_table(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    columns: Sequence[str] | None = None,
    sep: str = "|",
    closed: bool = True,
) -> DataFrame:
    """A delimited file with the given fields; bad values fail the query.

    ``closed`` says that lines end in a separator, as .tbl files do. Only the chosen ``columns`` are
    parsed.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    fields = list(schema.fields)
    if closed:
        fields.append(StructField("__rest", StringType()))
    df = (
        spark.read.schema(StructType(fields))
        .options(sep=sep, quote="", mode="FAILFAST", enforceSchema="true")
        .csv(path)
    )
    return df.select(*(columns or schema.names))


def text_lines(spark: SparkSession, path: str, stream: bool = False, max_files: int | None = None) -> DataFrame:
    """Lines of text in a column ``value``."""
    if not stream:
        return spark.read.text(path)
    return file_stream(spark, path, StructType([StructField("value", StringType())]), "text", max_files)


def int_relation(
    spark: SparkSession, path: str, key: str = "key", stream: bool = False, max_files: int | None = None
) -> DataFrame:
    """A relation of integers, one per line, stamped with the time of arrival; duplicates are kept."""
    lines = text_lines(spark, path, stream, max_files)
    return lines.select(checked_cast(F.col("value"), "int").alias(key), F.current_timestamp().alias("arrival_ts"))
