"""Reads, cursors and maintenance as functions from DataFrames to DataFrames.

A mutation log has the columns ``k`` (binary key), ``seq`` (long, unique), ``op``
(1 a value, 0 a deletion) and ``v`` (binary value). A read at sequence S sees of each
key the version with the greatest ``seq <= S``, unless that is a deletion.
"""
