"""Whole jobs: ingest, retrieval, grounded answers, evaluation."""
