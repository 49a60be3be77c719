"""Operators of a training-data pipeline.

Nothing else in the package imports this subpackage; it can be removed
whole, together with ``tests/llm`` and ``corpus_pipeline.py``.
"""
