"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; ``queries.py`` registers
its queries, and the entry module adds them only if the folder is present.
"""
