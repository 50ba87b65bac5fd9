"""Operators for building language-model training corpora.

Nothing outside this subpackage (apart from ``corpus_pipeline.py`` and the guarded
registration in ``__spark_entry__.py``) imports it.
"""
