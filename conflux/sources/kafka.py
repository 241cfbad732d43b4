"""Kafka topics as streams and as sinks. Running them takes Spark's Kafka connector on the class path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from conflux.functions.columns import row_message


def kafka_options(
    servers: str,
    topics: Sequence[str],
    group: str | None = None,
    earliest: bool = False,
    max_offsets: int | None = None,
) -> dict[str, str]:
    """Reader options: where to read, under which consumer group, from which end of the topic."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": ",".join(topics),
        "startingOffsets": "earliest" if earliest else "latest",
    }
    if group:
        options["kafka.group.id"] = group
    if max_offsets:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    return options


def message_text(messages: DataFrame, row_id: str | None = None) -> DataFrame:
    """The text of each message as ``value``; ``row_id`` adds a number made of its place in the topic."""
    columns = [F.col("value").cast("string").alias("value")]
    if row_id:
        columns.append(F.xxhash64("topic", "partition", "offset").alias(row_id))
    return messages.select(*columns)


def kafka_stream(
    spark: SparkSession,
    servers: str,
    topics: Sequence[str],
    group: str | None = None,
    earliest: bool = False,
    max_offsets: int | None = None,
    row_id: str | None = None,
) -> DataFrame:
    options = kafka_options(servers, topics, group, earliest, max_offsets)
    return message_text(spark.readStream.format("kafka").options(**options).load(), row_id)


def to_kafka(df: DataFrame, servers: str, topic: str) -> None:
    """Write each row of a batch as a message."""
    row_message(df).write.format("kafka").options(**{"kafka.bootstrap.servers": servers, "topic": topic}).save()


def to_kafka_stream(df: DataFrame, servers: str, topic: str) -> DataStreamWriter:
    """A writer that sends each row of a stream as a message; give it a checkpoint and start it."""
    return (
        row_message(df)
        .writeStream.format("kafka")
        .options(**{"kafka.bootstrap.servers": servers, "topic": topic})
    )
