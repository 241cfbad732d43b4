from conflux.streaming.joins import stored_interval_join, stored_join, stored_theta_join, stream_join, stream_window_counts
from conflux.streaming.keyed import KeyedStore
from conflux.streaming.lateness import in_time_order, measured_lateness
from conflux.streaming.progress import PROGRESS_COLUMNS, flatten_progress, observed, observed_reports, progress_table
from conflux.streaming.run import CutShort, Run, run_batches, run_to_console, run_to_table
from conflux.streaming.store import BatchFolder, latest, store_stream

__all__ = [
    "BatchFolder",
    "CutShort",
    "KeyedStore",
    "PROGRESS_COLUMNS",
    "Run",
    "flatten_progress",
    "in_time_order",
    "latest",
    "measured_lateness",
    "observed",
    "observed_reports",
    "progress_table",
    "run_batches",
    "run_to_console",
    "run_to_table",
    "store_stream",
    "stored_interval_join",
    "stored_join",
    "stored_theta_join",
    "stream_join",
    "stream_window_counts",
]
