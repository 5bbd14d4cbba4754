"""Ways to keep a plan balanced when one key holds a large share of the rows."""

from glosswork.plans.spread import (
    attach,
    bounded,
    bucket_of,
    forget,
    hot_lookup,
    quantile_bounds,
    rank_in_buckets,
    rank_in_groups,
    scratch_folder,
    sum_in_groups,
    written,
)

__all__ = [
    "attach",
    "bounded",
    "bucket_of",
    "forget",
    "hot_lookup",
    "quantile_bounds",
    "rank_in_buckets",
    "rank_in_groups",
    "scratch_folder",
    "sum_in_groups",
    "written",
]
