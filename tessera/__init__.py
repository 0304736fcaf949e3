"""Parallel-corpus preparation, translation and evaluation as Spark DataFrame operators.

Subpackages: ``functions`` (column expressions), ``sources`` (readers and sinks),
``operators`` (dictionary, translation, filters, splits, encodings, metrics,
reports), ``plans`` (plan helpers, registered queries, SQL twins), ``streaming``.
"""
