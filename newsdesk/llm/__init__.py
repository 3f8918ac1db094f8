"""Operators for large-scale training-text pipelines.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
