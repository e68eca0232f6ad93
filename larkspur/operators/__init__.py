from larkspur.operators.relational import aggregate, hash_join, merge_sorted, range_selection, selection, sort, sort_merge_join, sort_partitions, sorted_rows, union_scan

__all__ = ["aggregate", "hash_join", "merge_sorted", "range_selection", "selection", "sort", "sort_merge_join", "sort_partitions", "sorted_rows", "union_scan"]
