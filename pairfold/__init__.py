"""pairfold: match-then-aggregate analytics on Spark DataFrames."""

from .functions.aggregates import avg, avg_trunc, count, custom, fold, max_, min_, sum0, sum_
from .functions.theta import band, eq, ge, gt, le, lt, ne, theta
from .operators.api import exists, match_aggregate, not_exists

__all__ = ["avg", "avg_trunc", "band", "count", "custom", "eq", "exists", "fold", "ge", "gt", "le", "lt", "match_aggregate", "max_", "min_", "ne", "not_exists", "sum0", "sum_", "theta"]
