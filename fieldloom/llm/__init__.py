"""Operators for training-data pipelines: search, scans, classifiers, near-duplicate joins and packing over text tables.

Nothing outside this subpackage imports it.
"""
