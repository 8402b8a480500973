"""Operators for large training-data corpora.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
