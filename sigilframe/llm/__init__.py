"""Operators of a training-data pipeline. Nothing outside this package imports it, but for the entry module and corpus_pipeline."""
