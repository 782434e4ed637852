"""Retrieval analytics over text corpora, expressed with Spark DataFrames.

``functions`` holds column expressions, ``operators`` DataFrame-to-DataFrame
operators, ``sources`` readers and writers, ``plans`` whole query plans with
their SQL twins, and ``streaming`` incremental ingestion.
"""
