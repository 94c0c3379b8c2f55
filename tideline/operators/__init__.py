"""Operators: steps for ``flow >> step``, and joins of two DataFrames."""

from .elementwise import flat_mapping, maf, mapping, minibatch, on_error, or_default, ordering_flat_mapping, repeater, sort, take, take_while, where, where_stateful
from .hierarchy import breadth_first, deep_first, descendants, reachable
from .joins import auto_join, cartesian, ordered_join, overlap_join, prefix_join, prefix_join_inner, prefix_join_semi, unordered_join, zip_longest, zip_short
from .sets import auto_diff, diff, distinct_adjacent, distinct_auto, distinct_first, distinct_last_kept, distinct_sorted, ordered_diff, union_all, union_merge

__all__ = [
    "auto_diff", "auto_join", "breadth_first", "cartesian", "deep_first", "descendants", "diff", "distinct_adjacent", "distinct_auto", "distinct_first", "distinct_last_kept", "distinct_sorted",
    "flat_mapping", "maf", "mapping", "minibatch", "on_error", "or_default", "ordered_diff", "ordered_join", "ordering_flat_mapping", "overlap_join", "prefix_join", "prefix_join_inner", "prefix_join_semi",
    "reachable", "repeater", "sort", "take", "take_while", "union_all", "union_merge", "unordered_join", "where", "where_stateful", "zip_longest", "zip_short",
]
