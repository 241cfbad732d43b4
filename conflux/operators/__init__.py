from conflux.operators.equi import equi_join
from conflux.operators.inequality import inequality_join, running_extremes, running_totals
from conflux.operators.interval import interval_chain, interval_join, window_counts
from conflux.operators.split import Split, grid_shape, measure
from conflux.operators.summary import chain_summary, equi_join_summary, join_summary
from conflux.operators.theta import cross_join, grid_join, theta_join

__all__ = [
    "Split",
    "chain_summary",
    "cross_join",
    "equi_join",
    "equi_join_summary",
    "grid_join",
    "grid_shape",
    "inequality_join",
    "interval_chain",
    "interval_join",
    "join_summary",
    "measure",
    "running_extremes",
    "running_totals",
    "theta_join",
    "window_counts",
]
