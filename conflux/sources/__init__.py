from conflux.sources.files import delimited_table, file_stream, int_relation, table, table_stream, text_lines
from conflux.sources.generators import random_key, random_keys
from conflux.sources.kafka import kafka_options, kafka_stream, message_text, to_kafka, to_kafka_stream
from conflux.sources.schemas import TPCH

__all__ = [
    "TPCH",
    "delimited_table",
    "file_stream",
    "int_relation",
    "kafka_options",
    "kafka_stream",
    "message_text",
    "random_key",
    "random_keys",
    "table",
    "table_stream",
    "text_lines",
    "to_kafka",
    "to_kafka_stream",
]
