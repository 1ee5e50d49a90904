"""Operators of a training-data pipeline: filters, classifiers, deduplication, tokenisation, formatting.

Nothing outside this subpackage imports it.  Tables come in and go out as DataFrames; what has to be
kept between two jobs is written to the folder named by ``spark.checkpoint.dir`` (see ``runtime``).
"""
