from conflux.functions.columns import (
    Side,
    arrow_predicate,
    csv_line,
    earliest,
    prefixed,
    python_predicate,
    row_message,
    split_field,
    stamped,
)

__all__ = [
    "Side",
    "arrow_predicate",
    "csv_line",
    "earliest",
    "prefixed",
    "python_predicate",
    "row_message",
    "split_field",
    "stamped",
]
