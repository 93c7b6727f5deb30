"""Table-level operators: line machines, matching, dedup, store, ranking, rendering."""
