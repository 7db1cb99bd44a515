"""Retrieval and grounding over tables and streams of documents, as Spark DataFrame code.

Layout: ``functions`` hold column expressions, ``operators`` map DataFrames to DataFrames,
``sources`` read and write, ``plans`` compose whole jobs, ``streaming`` runs the same jobs
on streams.
"""

from groundwell.settings import Settings

__all__ = ["Settings"]
