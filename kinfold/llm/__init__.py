"""Training-data operators: quality, duplicates, contamination, mixing, packing.

Nothing else in the library imports this package. Each ``opN_*`` module has the
operator; ``queries`` binds the operators to the tables of a data folder.
"""
