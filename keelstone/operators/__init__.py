"""Table, lookup, union, cursor and snapshot operators."""
